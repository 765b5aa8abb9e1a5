import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seed import AS_OF
from stewardspark.operators import catalog
from stewardspark.operators import metrics as m
from stewardspark.operators import views as v
from stewardspark.plans.dashboard import home_page
from stewardspark.plans.nightly_sync import batch_id, record_row_counts_once, sync
from stewardspark.session import cut_lineage, scratch_path, shared_folder
from stewardspark.sources import snapshots, tables


def test_declared_model(spark):
    assert len(tables.SCHEMAS) == 35 and len(tables.PRIMARY_KEYS) == 31
    assert len(tables.FOREIGN_KEYS) == 42
    assert sum(len(c) for c in tables.NOT_NULL.values()) == 18
    for name, cols in tables.PRIMARY_KEYS.items():
        assert set(cols) <= set(tables.schema(name).names)
    for child, c, parent, p in tables.FOREIGN_KEYS:
        assert c in tables.schema(child).names and p in tables.schema(parent).names
    for (t, c) in tables.VOCABULARIES:
        assert c in tables.schema(t).names
    assert tables.schema("control_registry")["tolerance_pct"].dataType == T.DecimalType(9, 6)


def test_append_and_read(spark, rows):
    root = scratch_path(spark, "registry")
    df = spark.createDataFrame([("D", "Retail")], "domain_id string, domain_name string")
    snapshots.append(df, root, "dim_domain")
    snapshots.append(df.withColumn("domain_id", F.lit("E")), root, "dim_domain")
    got = snapshots.read_table(spark, root, "dim_domain")
    assert got.schema.simpleString() == tables.schema("dim_domain").simpleString()
    assert rows(got, "domain_id", "criticality") == [("D", None), ("E", None)]


def test_publish_switches_the_view(spark, rows):
    name = "snap_" + scratch_path(spark, "x")[-8:]
    first = snapshots.publish_snapshot(spark.range(2).toDF("id"), name, "v1")
    assert first.count() == 2
    # The next snapshot is computed from the current one, which stays readable meanwhile.
    snapshots.publish_snapshot(spark.table(name).selectExpr("id + 10 AS id"), name, "v2")
    assert rows(spark.table(name)) == [(10,), (11,)]
    assert rows(spark.table(f"{name}__v1")) == [(0,), (1,)]
    with pytest.raises(Exception):
        snapshots.publish_snapshot(spark.range(1).toDF("id"), name, "v2")


def test_publish_into_a_given_folder(spark, rows):
    folder, name = scratch_path(spark, "published"), "snap_" + scratch_path(spark, "x")[-8:]
    snapshots.publish_snapshot(spark.range(3).toDF("id"), name, "v1", folder)
    assert spark.read.parquet(f"{folder}/{name}__v1").count() == 3 == spark.table(name).count()


def test_daily_write_replaces_only_its_days(spark, rows):
    path = scratch_path(spark, "daily")
    ddl = "metric_date date, domain_name string, n int"
    day = lambda d: dt.date(2024, 1, d)
    snapshots.write_daily(spark.createDataFrame([(day(1), "b", 1), (day(2), "a", 1)], ddl), path)
    snapshots.write_daily(spark.createDataFrame([(day(2), "a", 2)], ddl), path)
    got = spark.read.parquet(path)
    assert rows(got, "metric_date", "n") == [(day(1), 1), (day(2), 2)]


def test_shared_folder_is_the_sessions_own(spark):
    assert shared_folder(spark) == shared_folder(spark)


def registry(spark, seed):
    def empty(name, *drop):
        df = spark.createDataFrame([], tables.schema(name))
        return df.drop(*drop)

    return {
        "dim_dataset": seed["dim_dataset"],
        "map_dataset_attribute": empty("map_dataset_attribute"),
        "lineage_node": empty("lineage_node"),
        "dq_result": empty("dq_result"),
        "process": empty("process"),
        "process_run": empty("process_run"),
        "control_test": empty("control_test"),
    }


def test_nightly_sync(spark, seed, rows):
    data = {
        ("DW", "RAW_A", "PEOPLE"): spark.createDataFrame(
            [(1, "x"), (2, "y")], "CUSTOMER_ID bigint, Email string"
        ),
        ("DW", "dbt_mart", "TOTALS"): spark.createDataFrame([], "born date, AMOUNT double"),
        ("DW", "OTHER", "SKIPPED"): spark.range(1),
    }
    meta = catalog.describe_tables(spark, data)
    cols = catalog.describe_columns(spark, data)
    counted = {"dbt_DW_RAW_A_PEOPLE": data["DW", "RAW_A", "PEOPLE"]}
    out = sync(registry(spark, seed), meta, cols, counted, AS_OF)
    new = out["dim_dataset"].where("system_id = 'DBT_PROD'")
    assert rows(new, "dataset_id", "dv_layer", "object_type", "domain_id") == [
        ("dbt_DW_RAW_A_PEOPLE", "BRONZE", "TABLE", "ANALYTICS")
    ]
    assert rows(out["map_dataset_attribute"], "column_name", "semantic_type", "quality_critical") == [
        ("CUSTOMER_ID", "IDENTIFIER", True), ("Email", "EMAIL", False)
    ]
    assert rows(out["lineage_node"], "node_id") == [("DS-001",), ("dbt_DW_RAW_A_PEOPLE",)]
    summary = out["summary"].first()
    assert summary.batch_id == batch_id(AS_OF) == "dbt_sync_20240310_120000"
    assert (summary.datasets_synced, summary.attributes_synced) == (2, 2)
    assert (summary.nodes_created, summary.quality_checks_run) == (2, 1)
    assert rows(out["control_test"], "test_id") == [
        ("dbt_sync_20240310_120000_complete",), ("dbt_sync_20240310_120000_start",)
    ]
    (run,) = out["process_run"].collect()
    assert (run.ended_at - run.started_at) == dt.timedelta(minutes=30)
    # A second sync of the same day changes no key and overwrites the count.
    again = sync(out, meta, cols, counted, AS_OF)
    for name in ("dim_dataset", "map_dataset_attribute", "lineage_node", "dq_result", "process"):
        assert rows(again[name]) == rows(out[name]), name
    once = record_row_counts_once(out["dq_result"], counted, AS_OF)
    assert once.count() == 1


def test_registration_styles(spark, rows):
    meta = spark.createDataFrame(
        [("DW", "gold", "T", "VIEW", None, "D", "", "pii", True)],
        catalog.TABLE_META + ", dataset_id string, domain string, classification string, contains_pii boolean",
    )
    old = catalog.dataset_rows(meta, "2024-01-01").withColumn("domain_id", F.lit("KEEP"))
    new = catalog.register_datasets(
        meta, old.withColumn("classification", F.lit("OLD")), "2024-02-01",
        catalog.HOOK_UPDATES, tracked_only=False,
    )
    assert rows(new, "dataset_id", "domain_id", "classification", "is_cde", "dv_layer") == [
        ("D", "KEEP", "PII", True, "GOLD")
    ]
    etl = catalog.register_datasets(
        meta, old.withColumn("dv_layer", F.lit("OLD")), "2024-02-01", catalog.ETL_UPDATES,
        tracked_only=False, short_layer=True,
    )
    assert rows(etl, "dv_layer") == [("OLD",)]
    assert rows(catalog.dataset_rows(meta, "2024-01-01", short_layer=True), "dv_layer") == [("SILVER",)]


def test_home_page(spark, seed, rows):
    t = seed | {
        "dim_term": spark.range(3),
        "role_page_access": spark.createDataFrame(
            [("analyst", "home", "ALLOW")], "role_name string, page_name string, access_level string"
        ),
    }
    page = home_page(t, "ANALYST", AS_OF, domain="DOM-001", system="(All)")
    assert rows(page["decision"], "allowed", "reason") == [(False, "rule=ALLOW")]
    assert rows(page["kpis"]) == [(8, 3, 5, 2)]
    assert page["datasets"].count() == 2 and page["risks"].count() == 3
    assert sum(r["count"] for r in page["outcomes"].collect()) == 4
    assert rows(home_page(t, "GUEST", AS_OF)["decision"], "allowed") == [(True,)]


# --- plans ---------------------------------------------------------------------------------


def plan(df) -> str:
    return df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(
        df._jdf.queryExecution(), "formatted"
    )


def test_no_python_and_no_product_joins_in_any_query(spark):
    from stewardspark.sources.projections import Tables
    from stewardspark.workload import QUERIES

    t = Tables(spark, "/root/testdata/sf0.001")
    for key, fn in QUERIES.items():
        if key.startswith("stream_"):
            continue
        text = plan(fn(t))
        for word in ("PythonUDF", "EvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert word not in text, f"{key}: {word}"


def test_filters_and_columns_reach_the_scan(spark):
    from stewardspark.sources.projections import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    text = plan(m.daily_quality_metrics(t.dq_result, t.dim_dataset, t.dim_domain, "2024-02-05"))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts," in text
    assert "props" not in text and "value" not in text
    from stewardspark.functions.policies import row_access

    labelled = t.orders.where(row_access("PRIVACY_OFFICER", None, "o_orderpriority"))
    assert "PushedFilters: [In(o_orderpriority, [Internal,PII,Public])]" in plan(labelled)


def test_one_scan_for_many_rules(spark):
    from stewardspark.operators import quality as q
    from stewardspark.sources.projections import Tables
    from stewardspark.workload.quality import LINE_RULES

    lineitem = Tables(spark, "/root/testdata/sf0.001").lineitem
    rules = [q.Rule(i, kind, "lineitem", c, cfg) for i, kind, c, cfg, _ in LINE_RULES]
    assert len(rules) >= 20
    text = plan(q.run_rules(rules, {"lineitem": lineitem}))
    assert text.count("Scan parquet") // 2 == 1 and "Exchange hashpartitioning" not in text


def test_only_one_row_per_key_and_task_is_shuffled_for_the_newest(spark):
    from stewardspark.sources.projections import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    assert "WindowGroupLimit" in plan(v.latest_results(t.dq_result, t.dq_run))


def test_as_of_join_shuffles_facts_once(spark):
    from stewardspark.operators.lifecycle import result_owner_as_of
    from stewardspark.sources.projections import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    facts = t.events.selectExpr("event_id", "'DS-1' AS dataset_id", "ts AS created_at")
    text = plan(result_owner_as_of(facts, t.map_dataset_owner))
    carrying = [
        line for line in text.splitlines() if line.startswith("Input") and "event_id" in line
    ]
    assert carrying
    blocks = text.split("\n\n")
    moved = [b for b in blocks if " Exchange" in b.split("\n")[0] and "event_id" in b]
    assert len(moved) == 1


def test_as_of_join_with_a_limit_moves_a_fact_once_too(spark):
    """Hot keys are a short list; it comes to the facts, the facts are not moved for it."""
    from stewardspark.operators.lifecycle import result_owner_as_of
    from stewardspark.sources.projections import Tables

    t = Tables(spark, "/root/testdata/sf0.001")
    facts = t.events.selectExpr("event_id", "'DS-1' AS dataset_id", "ts AS created_at")
    key = "spark.sql.autoBroadcastJoinThreshold"
    try:
        spark.conf.set(key, "-1")  # as for rows of a size that Spark would not broadcast
        text = plan(result_owner_as_of(facts, t.map_dataset_owner, bucket="month", split_rows=1000))
    finally:
        spark.conf.unset(key)
    moved = [b for b in text.split("\n\n") if " Exchange" in b.split("\n")[0] and "event_id" in b]
    assert len(moved) == 1


def joins_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_all_columns_are_not_broadcast(spark):
    """Ten columns a dataset, made from one row: their size is not seen by Spark."""
    from stewardspark.sources.projections import Tables
    from stewardspark.workload import QUERIES

    text = joins_of(QUERIES["stable_keys"](Tables(spark, "/root/testdata/sf0.001")))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_registered_columns_are_not_broadcast(spark):
    from stewardspark.sources.projections import Tables
    from stewardspark.workload.catalog import column_meta

    t = Tables(spark, "/root/testdata/sf0.001")
    text = joins_of(catalog.attribute_rows(column_meta(t), t.dim_dataset, AS_OF))
    assert text.count("SortMergeJoin") == 2 and "Broadcast" not in text


def test_a_sync_does_not_broadcast_the_nodes(spark, seed):
    """Whatever the sync merges into the nodes, no side of it passes the driver."""
    from stewardspark.plans import nightly_sync

    seen = {}

    def store(name, df):
        seen[name] = joins_of(df)
        return cut_lineage(df)

    nodes = spark.range(40).select(
        F.concat(F.lit("DS-"), "id").alias("node_id"), F.lit("old").alias("name"), F.lit(AS_OF).cast("timestamp_ntz").alias("updated_at")
    )
    known = registry(spark, seed) | {"lineage_node": nodes}
    meta = spark.range(20).selectExpr(
        "'DW' AS table_catalog", "'RAW' AS table_schema", "'T' || id AS table_name", "'VIEW' AS table_type", "'' AS comment"
    )
    cols = meta.selectExpr("table_catalog", "table_schema", "table_name", "'a' AS column_name", "'int' AS data_type", "comment")
    out = nightly_sync.sync(known, meta, cols, {}, AS_OF, store)
    assert out["lineage_node"].count() == 40 + 20 + 1
    assert "FullOuter" in seen["lineage_node"]


def test_hot_key_joins_are_split_at_run_time(spark, rows):
    """A dataset with most rows: the merge join splits its partition, results stay whole."""
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, val in conf.items():
            spark.conf.set(k, val)
        facts = spark.range(0, 60000, 1, 8).selectExpr(
            "CAST(id AS STRING) AS test_id", "IF(id % 3 < 2, 'hot', CAST(id % 500 AS STRING)) AS control_id",
            "'r' AS run_id", "TIMESTAMP_NTZ '2024-01-01' AS executed_at", "'PASS' AS outcome",
            "sha2(CAST(id AS STRING), 256) AS details",
        )
        control = spark.range(500).selectExpr(
            "IF(id = 0, 'hot', CAST(id AS STRING)) AS control_id", "'c' AS control_name",
            "'LOW' AS severity", "'DATASET' AS scope_type", "'s' AS scope_id", "'p' AS owner_party_id",
        )
        party = spark.createDataFrame([("p", "n", "e")], "party_id string, party_name string, email string")
        df = v.control_results_enriched(facts, control, party)
        total = df.agg(F.count("control_name"), F.count_distinct("test_id"))
        (got,) = total.collect()
        assert tuple(got) == (59960, 60000)
        assert "skew=true" in plan(total) or "isSkew" in plan(total)
    finally:
        for k, val in old.items():
            spark.conf.unset(k) if val is None else spark.conf.set(k, val)
