import datetime as dt

import pytest

from stewardspark.operators import lineage as g


def reach(spark, edges, seeds, **kw):
    df = spark.createDataFrame(
        [(s, t, True) for s, t in edges], "src_node_id string, tgt_node_id string, active_flag boolean"
    )
    start = spark.createDataFrame([(s,) for s in seeds], "node_id string")
    return {r.node_id: r.depth for r in g.reachable(df, start, **kw).collect()}


def test_downstream_and_upstream_with_a_cycle(spark, seed):
    one = spark.createDataFrame([("LN-007",)], "node_id string")
    down = {r.node_id: r.depth for r in g.reachable(seed["lineage_edge"], one).collect()}
    assert down == {"LN-001": 1, "LN-006": 2, "LN-404": 3}
    report = spark.createDataFrame([("LN-006",)], "node_id string")
    up = {r.node_id: r.depth for r in g.reachable(seed["lineage_edge"], report, "upstream").collect()}
    assert up == {"LN-001": 1, "LN-002": 1, "LN-007": 2, "LN-004": 2, "LN-005": 2}


def test_inactive_edges_and_one_hop(spark, seed):
    one = spark.createDataFrame([("LN-007",)], "node_id string")
    got = g.reachable(seed["lineage_edge"], one, max_depth=1, active_only=False)
    assert {r.node_id for r in got.collect()} == {"LN-001", "LN-002"}


def test_long_chain_self_loop_and_two_seeds(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(19)] + [("n0", "n0")]
    got = reach(spark, chain, ["n0"])
    assert got == {f"n{i}": i for i in range(1, 20)}
    assert reach(spark, chain, ["n0", "n3"], max_depth=2) == {"n1": 1, "n2": 2, "n4": 1, "n5": 2}


def test_wrong_direction(spark):
    with pytest.raises(ValueError):
        reach(spark, [("a", "b")], ["a"], direction="sideways")


def test_impact_counts_parallel_edges(seed, rows):
    got = g.impact_one_hop(seed["lineage_node"], seed["lineage_edge"], "LN-007")
    assert rows(got) == [("DATASET", 2, 2.0, "Accounts, Accounts")]


def test_edges_from_dependencies(spark, rows):
    models = spark.createDataFrame(
        [("DB", "S", "M", ["model.p.a", "source.p.x.b", "lonely", "model.p.a"])],
        "database_name string, schema_name string, object_name string, depends_on array<string>",
    )
    known = spark.createDataFrame(
        [("edge_dbt_DB_S_a_to_dbt_DB_S_M", "dbt_DB_S_a", "dbt_DB_S_M", "LOADS", "old", False)],
        "edge_id string, src_node_id string, tgt_node_id string, edge_type string, "
        "logic_ref string, active_flag boolean",
    )
    got = g.lineage_edges(models, known, "2024-01-01")
    assert rows(got, "src_node_id", "edge_type", "logic_ref", "active_flag") == [
        ("dbt_DB_S_a", "LOADS", "dbt_model_M", True),
        ("dbt_DB_S_b", "TRANSFORMS", "dbt_model_M", True),
    ]


def test_graph_audits(seed, rows):
    assert rows(g.lineage_dangling(seed["lineage_node"], seed["lineage_edge"])) == [
        ("LE-9", "TARGET", "LN-404")
    ]
    places = dict(rows(g.lineage_roots_leaves(seed["lineage_node"], seed["lineage_edge"]), "node_id", "position"))
    assert places == {"LN-004": "ROOT", "LN-005": "ROOT", "LN-007": "ROOT", "LN-008": "ISOLATED"}


def test_manager_chain_and_cycles(spark, seed, rows):
    got = rows(g.manager_chain(seed["dim_party"]))
    assert got == [
        ("PTY-001", "PTY-003", 1), ("PTY-001", "PTY-100", 2), ("PTY-002", "PTY-003", 1),
        ("PTY-002", "PTY-100", 2), ("PTY-003", "PTY-100", 1),
    ]
    loop = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d")], "party_id string, manager_party_id string"
    )
    assert rows(g.manager_chain(loop)) == [
        ("a", "b", 1), ("a", "c", 2), ("b", "a", 2), ("b", "c", 1), ("c", "a", 1), ("c", "b", 2)
    ]
    assert rows(g.manager_chain(loop, max_depth=1)) == [("a", "b", 1), ("b", "c", 1), ("c", "a", 1)]


def test_run_events(spark, rows):
    t = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame(
        [
            ("r1", "START", t, "p", "airflow", None, None),
            ("r1", "START", t + dt.timedelta(minutes=1), "p", "airflow", None, None),
            ("r1", "COMPLETE", t + dt.timedelta(minutes=5), None, None, "FAILED", "boom"),
            ("r1", "COMPLETE", t + dt.timedelta(minutes=9), None, None, "SUCCESS", None),
            ("r2", "START", t, "p", "talend", None, None),
            ("r3", "COMPLETE", t, None, None, "SUCCESS", None),
        ],
        "run_id string, event string, event_at timestamp_ntz, process_id string, "
        "system_name string, status string, error_message string",
    )
    runs = spark.createDataFrame(
        [],
        "run_id string, process_id string, system_id string, started_at timestamp_ntz, "
        "ended_at timestamp_ntz, status string, error_message string",
    )
    got = g.apply_run_events(runs, events)
    assert rows(got, "run_id", "system_id", "started_at", "ended_at", "status", "error_message") == [
        ("r1", "AIRFLOW", t, t + dt.timedelta(minutes=9), "SUCCESS", None),
        ("r2", "TALEND", t, None, "STARTED", None),
    ]
    systems = spark.createDataFrame([("AIRFLOW", "Airflow", "DB")], "system_id string, system_name string, system_type string")
    assert rows(g.systems_from_events(systems, events)) == [
        ("AIRFLOW", "Airflow", "DB"), ("TALEND", "talend", "ETL_TOOL")
    ]


def test_nodes_of_the_day(seed, rows):
    nodes = seed["lineage_node"]
    got = g.lineage_nodes(seed["dim_dataset"], nodes, "2024-03-10")
    assert got.count() == nodes.count() + 1
    assert rows(got.where("node_id = 'DS-001'"), "node_type", "name") == [("DATASET", "DW.CORE.T1")]
