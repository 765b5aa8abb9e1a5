"""Data-quality rules, reconciliation, controls and constraint audits on the driver tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import audits as au
from ..operators import digests
from ..operators import quality as q
from ..operators.quality import Rule
from ..sources import tables as declared
from ..sources.projections import PROJECTIONS
from .registry import AS_OF, query

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def judged_sql(rule_id, rule_type, dataset, column, rows, failed, source, threshold=100.0):
    """One rule as SQL: counts of rows and of broken rows, rate and outcome."""
    return f"""SELECT '{rule_id}' AS rule_id, '{rule_type}' AS rule_type, '{dataset}' AS dataset_id,
  '{column}' AS column_name, row_count, failed_count, round(rate, 6) AS rate, {threshold}::DOUBLE AS threshold,
  CASE WHEN rate IS NULL OR rate >= {threshold} THEN 'PASS' WHEN rate >= {threshold} - 5 THEN 'WARN' ELSE 'FAIL' END AS outcome
FROM (SELECT *, 100.0::DOUBLE * (row_count - failed_count) / nullif(row_count, 0) AS rate
  FROM (SELECT CAST({rows} AS BIGINT) AS row_count, CAST({failed} AS BIGINT) AS failed_count FROM {source}))"""


def row_rule_sql(rule_id, rule_type, dataset, column, broken, threshold=100.0):
    return judged_sql(
        rule_id, rule_type, dataset, column, "count(*)", f"count(*) FILTER ({broken})", dataset,
        threshold,
    )


def unique_sql(rule_id, dataset, columns, threshold=100.0):
    keyed = " AND ".join(f"{c} IS NOT NULL" for c in columns.split(","))
    return judged_sql(
        rule_id, "UNIQUENESS", dataset, columns, "coalesce(sum(n), 0)", "coalesce(sum(n - 1), 0)",
        f"(SELECT count(*) AS n FROM {dataset} WHERE {keyed} GROUP BY {columns})", threshold,
    )


def fk_sql(rule_id, dataset, column, parent, parent_column, threshold=100.0):
    return judged_sql(
        rule_id, "CONSISTENCY", dataset, column, "count(*)",
        f"count(*) FILTER (NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_column} = c.{column}))",
        f"{dataset} c WHERE c.{column} IS NOT NULL", threshold,
    )


def _rated(df):
    return df.withColumn("rate", F.round("rate", 6))


# --- row counts and reconciliation -------------------------------------------------------


@query(
    "dq_row_count",
    "",
    "\nUNION ALL ".join(
        f"SELECT 'row_count_check' AS rule_id, '{t}' AS dataset_id, "
        f"CASE WHEN count(*) >= 0 THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS row_count FROM {t}"
        for t in DRIVER_TABLES
    ),
)
def _(t):
    return q.row_count_check({name: t[name] for name in DRIVER_TABLES})


@query(
    "dq_row_count_results",
    "",
    "\nUNION ALL ".join(
        f"SELECT '{t}_rowcount_2024-02-05' AS run_id, 'row_count_check' AS rule_id, '{t}' AS dataset_id, "
        f"CASE WHEN count(*) >= 1000 THEN 'PASS' ELSE 'FAIL' END AS outcome, "
        f"CAST(count(*) AS VARCHAR) AS row_count, 'volume' AS check_type FROM {t}"
        for t in DRIVER_TABLES
    ),
)
def _(t):
    rows = q.row_count_check({name: t[name] for name in DRIVER_TABLES}, 1000, AS_OF)
    return rows.select(
        "run_id", "rule_id", "dataset_id", "outcome",
        F.get_json_object("metrics_summary", "$.row_count").alias("row_count"),
        F.get_json_object("metrics_summary", "$.check_type").alias("check_type"),
    )


SESSIONS = """WITH l AS (SELECT CAST(o.o_orderdate AS DATE) AS load_day, l_returnflag FROM lineitem JOIN orders o ON o_orderkey = l_orderkey),
s AS (SELECT load_day, count(*) AS source_count, count(*) FILTER (l_returnflag = 'R') AS error_count FROM l GROUP BY 1),
t AS (SELECT CAST(o_orderdate AS DATE) AS load_day, count(*) AS target_count FROM orders GROUP BY 1)"""


def _sessions(t):
    day = t.orders.select(F.col("o_orderkey").alias("l_orderkey"),
                          F.to_date("o_orderdate").alias("load_day"))
    lines = t.lineitem.select("l_orderkey", "l_returnflag").join(day, "l_orderkey")
    return lines, day


@query(
    "dq_reconcile_counts",
    "",
    SESSIONS
    + """
SELECT load_day, source_count, target_count, error_count,
  CASE WHEN target_count = source_count - error_count THEN 'PASS'
    WHEN error_count < source_count * 0.05 THEN 'WARN' ELSE 'FAIL' END AS outcome,
  round(100.0::DOUBLE * target_count / nullif(source_count, 0), 6) AS success_rate
FROM (SELECT load_day, coalesce(source_count, 0) AS source_count, coalesce(target_count, 0) AS target_count,
  coalesce(error_count, 0) AS error_count FROM s FULL JOIN t USING (load_day))""",
)
def _(t):
    lines, orders = _sessions(t)
    return q.reconcile_counts(
        lines, orders, F.col("l_returnflag") == "R", ["load_day"]
    ).withColumn("success_rate", F.round("success_rate", 6))


@query(
    "dq_validate_reported_counts",
    "",
    """WITH r AS (SELECT l_orderkey AS k, max(l_linenumber)::BIGINT AS reported_count FROM lineitem GROUP BY 1),
a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT r.k AS l_orderkey, reported_count, coalesce(n, 0) AS target_count,
  CASE WHEN coalesce(n, 0) = reported_count THEN 'PASS' ELSE 'FAIL' END AS outcome FROM r LEFT JOIN a USING (k)""",
)
def _(t):
    reported = t.lineitem.groupBy("l_orderkey").agg(
        F.max("l_linenumber").cast("bigint").alias("reported_count")
    )
    arrived = t.lineitem.where("l_linestatus = 'F'")
    return q.validate_reported_counts(reported, arrived, ["l_orderkey"])


# --- single rules ------------------------------------------------------------------------


@query(
    "dq_completeness",
    "dim_party",
    "WITH doc_labels AS (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)\n"
    + row_rule_sql("labelled", "COMPLETENESS", "doc_labels", "quality", "quality IS NULL", 35.0)
    + "\nUNION ALL "
    + row_rule_sql("email", "COMPLETENESS", "dim_party", "email", "email IS NULL", 95.0),
)
def _(t):
    docs = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    a = q.completeness(docs, "quality", 35.0, "labelled", "doc_labels")
    return _rated(a.unionByName(q.completeness(t.dim_party, "email", 95.0, "email", "dim_party")))


@query(
    "dq_uniqueness",
    "",
    unique_sql("line", "lineitem", "l_orderkey,l_linenumber")
    + "\nUNION ALL "
    + unique_sql("event", "events", "event_id"),
)
def _(t):
    a = q.uniqueness(t.lineitem, ["l_orderkey", "l_linenumber"], 100.0, "line", "lineitem")
    return _rated(a.unionByName(q.uniqueness(t.events, "event_id", 100.0, "event", "events")))


@query(
    "dq_validity_range",
    "",
    row_rule_sql(
        "discount", "VALIDITY", "lineitem", "l_discount", "l_discount < 0 OR l_discount > 0.05"
    ),
)
def _(t):
    return _rated(
        q.validity_range(t.lineitem, "l_discount", 0, 0.05, 100.0, "discount", "lineitem")
    )


@query(
    "dq_validity_min",
    "",
    row_rule_sql("balance", "VALIDITY", "customer", "c_acctbal", "c_acctbal < 0", 90.0),
)
def _(t):
    return _rated(
        q.validity_range(t.customer, "c_acctbal", 0, None, 90.0, "balance", "customer")
    )


@query(
    "dq_validity_decimal",
    "",
    row_rule_sql(
        "price", "VALIDITY", "part", "p_retailprice",
        "round(p_retailprice, 2) <> p_retailprice OR abs(p_retailprice) >= 10000",
    )
    + "\nUNION ALL "
    + row_rule_sql("value", "VALIDITY", "events", "value", "round(value, 1) <> value OR abs(value) >= 10000"),
)
def _(t):
    a = q.validity_decimal(t.part, "p_retailprice", 6, 2, 100.0, "price", "part")
    b = q.validity_decimal(t.events, "value", 5, 1, 100.0, "value", "events")
    return _rated(a.unionByName(b))


@query(
    "dq_validity_set",
    "",
    row_rule_sql("status", "VALIDITY", "orders", "o_orderstatus", "o_orderstatus NOT IN ('F', 'O')"),
)
def _(t):
    return _rated(
        q.validity_in_set(t.orders, "o_orderstatus", ["F", "O"], 100.0, "status", "orders")
    )


@query(
    "dq_validity_regex",
    "",
    row_rule_sql("url", "VALIDITY", "pages", "url", "NOT regexp_matches(url, '^http://')"),
)
def _(t):
    return _rated(q.validity_regex(t.pages, "url", "^http://", 100.0, "url", "pages"))


@query(
    "dq_consistency_fk",
    "dq_result dq_run dim_dataset",
    "\nUNION ALL ".join(
        [
            fk_sql("line_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
            fk_sql("label_doc", "labels", "doc_id", "documents", "doc_id"),
            fk_sql("result_run", "dq_result", "run_id", "dq_run", "run_id"),
            fk_sql("result_dataset", "dq_result", "dataset_id", "dim_dataset", "dataset_id"),
        ]
    ),
)
def _(t):
    checks = [
        q.consistency_fk(t.lineitem, t.orders, [("l_orderkey", "o_orderkey")], 100.0,
                         "line_order", "lineitem"),
        q.consistency_fk(t.labels, t.documents, "doc_id", 100.0, "label_doc", "labels"),
        q.consistency_fk(t.dq_result, t.dq_run, "run_id", 100.0, "result_run", "dq_result"),
        q.consistency_fk(t.dq_result, t.dim_dataset, "dataset_id", 100.0, "result_dataset",
                         "dq_result"),
    ]
    return _rated(q.union_all(checks))


@query(
    "dq_accuracy_reconcile",
    "",
    """WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders),
b AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY 1),
j AS (SELECT a.k AS ka, b.k AS kb, a.v AS va, b.v AS vb FROM a FULL JOIN b ON a.k = b.k),
c AS (SELECT count(*) AS row_count, count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL) AS compared,
  count(*) FILTER (kb IS NULL) AS missing_in_source, count(*) FILTER (ka IS NULL) AS missing_in_actual,
  count(*) FILTER (ka IS NOT NULL AND kb IS NOT NULL AND NOT (abs(va - vb) <= 1000 OR abs(va - vb) * 100 <= abs(vb) * 5)) AS mismatched FROM j)
SELECT *, round(100.0::DOUBLE * (row_count - mismatched - missing_in_source - missing_in_actual) / row_count, 6) AS rate,
  CASE WHEN row_count = 0 OR mismatched + missing_in_source + missing_in_actual = 0 THEN 'PASS'
    WHEN (mismatched + missing_in_source + missing_in_actual) * 20 <= row_count THEN 'WARN' ELSE 'FAIL' END AS outcome FROM c""",
)
def _(t):
    total = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    source = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(total).alias("v"))
    actual = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    return _rated(q.accuracy_vs_source(actual, source, ["k"], "v", 1000.0, 5.0))


def _edited_orders(t):
    """The orders and a copy with a few prices changed, some rows gone and some new."""
    old = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    k = F.col("o_orderkey")
    price = F.when(k % 997 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    new = old.where(k % 1499 != 2).withColumn("o_totalprice", price)
    added = old.where(k % 1999 == 3).withColumn("o_orderkey", -k)
    return old, new.unionByName(added)


_EDITED = """SELECT o_orderkey AS k, CASE WHEN o_orderkey % 997 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders
  WHERE o_orderkey % 1499 <> 2 UNION ALL SELECT -o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 1999 = 3"""


@query(
    "dq_changed_rows",
    "",
    f"""WITH n AS ({_EDITED})
SELECT coalesce(o_orderkey, k) AS o_orderkey, CASE WHEN o_orderkey IS NULL THEN 'MISSING_LEFT' WHEN k IS NULL THEN 'MISSING_RIGHT'
  ELSE 'DIFFERENT' END AS change FROM orders FULL JOIN n ON k = o_orderkey WHERE v IS DISTINCT FROM o_totalprice""",
)
def _(t):
    old, new = _edited_orders(t)
    return digests.changed_rows(old, new, ["o_orderkey"], ["o_custkey", "o_totalprice", "o_orderstatus"])


@query(
    "dq_accuracy_by_digests",
    "",
    f"""WITH n AS ({_EDITED}),
c AS (SELECT count(*) AS row_count, count(k) FILTER (o_orderkey IS NOT NULL) AS compared, count(*) FILTER (k IS NULL) AS missing_in_source,
  count(*) FILTER (o_orderkey IS NULL) AS missing_in_actual, count(*) FILTER (abs(v - o_totalprice) > 0.5) AS mismatched
  FROM orders FULL JOIN n ON k = o_orderkey)
SELECT *, round(100.0::DOUBLE * (row_count - mismatched - missing_in_source - missing_in_actual) / row_count, 6) AS rate, 'WARN' AS outcome FROM c""",
)
def _(t):
    old, new = _edited_orders(t)
    return _rated(
        digests.accuracy_by_digests(
            old.withColumnRenamed("o_totalprice", "v"), new.withColumnRenamed("o_totalprice", "v"), ["o_orderkey"], "v", 0.5
        )
    )


@query(
    "dq_timeliness",
    "",
    """SELECT event_type AS item, max(ts) AS newest, CAST(date_diff('day', max(ts), TIMESTAMP '2024-02-05') AS INTEGER) AS age_days,
  CASE WHEN date_diff('day', max(ts), TIMESTAMP '2024-02-05') <= 6 THEN 'PASS' ELSE 'FAIL' END AS outcome FROM events GROUP BY 1
UNION ALL SELECT 'orders', newest, CAST(age AS INTEGER), CASE WHEN age <= 6 OR rows = 0 THEN 'PASS' ELSE 'FAIL' END
FROM (SELECT max(o_orderdate) AS newest, date_diff('day', max(o_orderdate), TIMESTAMP '2024-02-05') AS age, count(*) AS rows FROM orders)""",
)
def _(t):
    events = q.timeliness(t.events, "ts", 6, AS_OF, ["event_type"]).withColumnRenamed(
        "event_type", "item"
    )
    orders = q.timeliness(t.orders, "o_orderdate", 6, AS_OF).withColumn("item", F.lit("orders"))
    return events.unionByName(orders)


@query(
    "dq_schema_drift",
    "map_dataset_attribute",
    """WITH a AS (SELECT dataset_id, CASE WHEN column_name = 'NOTES' AND term_id IS NULL THEN 'REMARKS' ELSE column_name END AS column_name,
  CASE WHEN cde_id IS NOT NULL THEN 'NUMBER(38,4)' ELSE data_type END AS data_type FROM map_dataset_attribute)
SELECT * FROM (SELECT coalesce(e.dataset_id, a.dataset_id) AS dataset_id, coalesce(e.column_name, a.column_name) AS column_name,
  CASE WHEN e.dataset_id IS NULL THEN 'ADDED' WHEN a.dataset_id IS NULL THEN 'REMOVED' WHEN e.data_type <> a.data_type THEN 'RETYPED' END AS change,
  e.data_type AS expected_type, a.data_type AS actual_type
FROM map_dataset_attribute e FULL JOIN a ON a.dataset_id = e.dataset_id AND a.column_name = e.column_name) WHERE change IS NOT NULL""",
)
def _(t):
    expected = t.map_dataset_attribute
    renamed = (F.col("column_name") == "NOTES") & F.col("term_id").isNull()
    retyped = F.when(F.col("cde_id").isNotNull(), "NUMBER(38,4)").otherwise(F.col("data_type"))
    actual = expected.select(
        "dataset_id",
        F.when(renamed, "REMARKS").otherwise(F.col("column_name")).alias("column_name"),
        retyped.alias("data_type"),
    )
    return q.schema_drift(expected, actual, ["dataset_id", "column_name"])


# --- many rules, one pass ----------------------------------------------------------------

# rule id, column, configuration, and the broken row as SQL
LINE_RULES = [
    *[(f"nn_{c}", "COMPLETENESS", c, {}, f"{c} IS NULL") for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
    )],
    ("qty_range", "VALIDITY", "l_quantity", {"min_value": 2, "max_value": 49, "threshold": 95},
     "l_quantity < 2 OR l_quantity > 49"),
    ("qty_whole", "VALIDITY", "l_quantity", {"precision": 3, "scale": 0},
     "round(l_quantity, 0) <> l_quantity OR abs(l_quantity) >= 1000"),
    ("price_min", "VALIDITY", "l_extendedprice", {"min_value": 1000},
     "l_extendedprice < 1000"),
    ("price_max", "VALIDITY", "l_extendedprice", {"max_value": 90000.0, "threshold": 90},
     "l_extendedprice > 90000"),
    ("price_cents", "VALIDITY", "l_extendedprice", {"precision": 7, "scale": 2},
     "round(l_extendedprice, 2) <> l_extendedprice OR abs(l_extendedprice) >= 100000"),
    ("discount_max", "VALIDITY", "l_discount", {"max_value": 0.08, "threshold": 85},
     "l_discount > 0.08"),
    ("tax_range", "VALIDITY", "l_tax", {"min_value": 0, "max_value": 0.07},
     "l_tax < 0 OR l_tax > 0.07"),
    ("flag_set", "VALIDITY", "l_returnflag", {"allowed": ["A", "N", "R"]},
     "l_returnflag NOT IN ('A', 'N', 'R')"),
    ("status_set", "VALIDITY", "l_linestatus", {"allowed": ["F"], "threshold": 50},
     "l_linestatus NOT IN ('F')"),
    ("flag_pattern", "VALIDITY", "l_returnflag", {"pattern": "^[AN]$", "threshold": 66},
     "NOT regexp_matches(l_returnflag, '^[AN]$')"),
    ("line_range", "VALIDITY", "l_linenumber", {"min_value": 1, "max_value": 6},
     "l_linenumber < 1 OR l_linenumber > 6"),
]
MIXED_RULES = [
    *[Rule(i, kind, "lineitem", c, cfg) for i, kind, c, cfg, _ in LINE_RULES],
    Rule("ship_age", "TIMELINESS", "lineitem", "l_shipdate", {"max_age_days": 3650}),
    Rule("order_age", "TIMELINESS", "orders", "o_orderdate", {"max_age_days": 30}),
    Rule("order_status", "VALIDITY", "orders", "o_orderstatus", {"allowed": ["F", "O", "P"]}),
    Rule("line_key", "UNIQUENESS", "lineitem", "l_orderkey, l_linenumber", {"threshold": 80}),
    Rule("line_part", "CONSISTENCY", "lineitem", "l_partkey",
         {"parent": "part", "parent_column": "p_partkey"}),
    Rule("off", "COMPLETENESS", "lineitem", "l_tax", {}, enabled_flag=False),
]


def _age_sql(rule_id, dataset, column, days):
    late = f"CASE WHEN date_diff('day', max({column}), TIMESTAMP '2024-02-05') > {days} THEN 1 ELSE 0 END"
    return judged_sql(rule_id, "TIMELINESS", dataset, column, "1", late, dataset)


RUN_RULES_SQL = "\nUNION ALL ".join(
    [row_rule_sql(i, kind, "lineitem", c, sql, float(cfg.get("threshold", 100)))
     for i, kind, c, cfg, sql in LINE_RULES]
    + [
        _age_sql("ship_age", "lineitem", "l_shipdate", 3650),
        _age_sql("order_age", "orders", "o_orderdate", 30),
        row_rule_sql("order_status", "VALIDITY", "orders", "o_orderstatus",
                     "o_orderstatus NOT IN ('F', 'O', 'P')"),
        unique_sql("line_key", "lineitem", "l_orderkey, l_linenumber", 80.0),
        fk_sql("line_part", "lineitem", "l_partkey", "part", "p_partkey"),
    ]
)


def _run_rules(t):
    names = ("lineitem", "orders", "part")
    return q.run_rules(MIXED_RULES, {n: t[n] for n in names}, AS_OF)


@query("dq_run_rules", "", RUN_RULES_SQL)
def _(t):
    return _rated(_run_rules(t))


# A registry table: every declared type, and rules that cannot run.
REGISTRY = [
    *[(r.rule_id, r.rule_type, r.dataset_id, r.column_name, json.dumps(dict(r.config)), r.enabled_flag) for r in MIXED_RULES],
    ("order_total", "ACCURACY", "order_values", "value",
     '{"source": "line_values", "keys": ["k"], "tol_abs": 1000, "tol_pct": 5}', True),
    ("order_shape", "SCHEMA_DRIFT", "order_values", None, '{"columns": {"k": "bigint", "value": "decimal(18,2)", "note": "string"}}', True),
    ("lost_table", "COMPLETENESS", "nowhere", "x", None, True),
    ("lost_column", "VALIDITY", "orders", "nothing", '{"min_value": 1}', True),
    ("odd_config", "VALIDITY", "orders", "o_totalprice", "[1]", True),
]
_REGISTRY_DDL = (
    "rule_id string, rule_type string, dataset_id string, column_name string, config_json string, enabled_flag boolean"
)


@query(
    "dq_run_registry",
    "",
    f"""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders),
b AS (SELECT l_orderkey AS k, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS v FROM lineitem GROUP BY 1),
j AS (SELECT a.v AS x, b.v AS y FROM a FULL JOIN b USING (k))
{RUN_RULES_SQL}
UNION ALL {judged_sql("order_total", "ACCURACY", "order_values", "value", "count(*)",
    "count(*) FILTER (x IS NULL OR y IS NULL OR (abs(x - y) > 1000 AND abs(x - y) * 100 > abs(y) * 5))", "j")}
UNION ALL SELECT 'order_shape', 'SCHEMA_DRIFT', 'order_values', NULL, 3, 2, round(100.0::DOUBLE / 3, 6), 100.0::DOUBLE, 'FAIL'
UNION ALL SELECT *, NULL, NULL, NULL, NULL, 'ERROR' FROM (VALUES ('lost_table', 'COMPLETENESS', 'nowhere', 'x'),
  ('lost_column', 'VALIDITY', 'orders', 'nothing'), ('odd_config', 'VALIDITY', 'orders', 'o_totalprice'))""",
)
def _(t):
    value = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    tables = {n: t[n] for n in ("lineitem", "orders", "part")} | {
        "order_values": t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value")),
        "line_values": t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sum(value).alias("value")),
    }
    rules = q.load_rules(t.spark.createDataFrame(REGISTRY, _REGISTRY_DDL))
    return _rated(q.run_rules(rules, tables, AS_OF))


@query(
    "dq_record_results",
    "",
    f"""SELECT 'RUN-X' AS run_id, rule_id, dataset_id, outcome, 'evidence/' || rule_id || '/run-x.json' AS evidence_ref,
  CAST(failed_count AS VARCHAR) AS failed_text,
  CASE rule_type WHEN 'COMPLETENESS' THEN 'null_count' WHEN 'VALIDITY' THEN 'out_of_range_count'
    WHEN 'UNIQUENESS' THEN 'duplicate_count' WHEN 'CONSISTENCY' THEN 'orphan_count' ELSE 'late_count' END AS metric,
  TIMESTAMP '2024-02-05' AS created_at FROM ({RUN_RULES_SQL})""",
)
def _(t):
    rows = q.as_dq_results(_run_rules(t), "RUN-X", AS_OF)
    names = [failed for failed, _ in q.METRIC_NAMES.values()]
    fields = F.array(
        *[
            F.struct(F.lit(n).alias("name"), F.get_json_object("metrics_summary", f"$.{n}").alias("v"))
            for n in names
        ]
    )
    found = F.element_at(F.filter(fields, lambda x: x["v"].isNotNull()), 1)
    return rows.select(
        "run_id", "rule_id", "dataset_id", "outcome", "evidence_ref", "created_at",
        found["v"].alias("failed_text"), found["name"].alias("metric"),
    )


@query(
    "dq_outcome_mapping",
    "dq_result",
    """SELECT evidence_ref, CASE WHEN rate >= 300 THEN 'PASS' WHEN rate >= 250 THEN 'WARN' ELSE 'FAIL' END AS mapped
FROM dq_result""",
)
def _(t):
    return t.dq_result.select("evidence_ref", q.outcome("rate", 300.0, 50.0).alias("mapped"))


@query(
    "control_tolerance",
    "control_registry control_test",
    """WITH m AS (SELECT 'CTL-' || CAST(l_partkey AS VARCHAR) AS control_id, max(CAST(l_extendedprice AS DECIMAL(18,6))) AS actual
  FROM lineitem GROUP BY 1),
p AS (SELECT 'CTL-' || CAST(p_partkey AS VARCHAR) AS control_id, CAST(p_retailprice * 60 AS DECIMAL(18,6)) AS expected FROM part),
j AS (SELECT c.control_id, m.actual, p.expected, c.tolerance_abs * 1000 AS ta, c.tolerance_pct * 10 AS tp, c.materiality_abs * 100 AS ma,
  abs(m.actual - p.expected) AS d FROM control_registry c JOIN m ON m.control_id = c.control_id JOIN p ON p.control_id = c.control_id)
SELECT control_id, CASE WHEN d <= ta AND d * 100 <= tp * abs(expected) THEN 'PASS' WHEN d <= ma THEN 'WARN' ELSE 'FAIL' END AS outcome FROM j""",
)
def _(t):
    key = lambda c: F.concat(F.lit("CTL-"), F.col(c).cast("string"))
    actual = t.lineitem.groupBy(key("l_partkey").alias("control_id")).agg(
        F.max(F.col("l_extendedprice").cast("decimal(18,6)")).alias("actual")
    )
    expected = t.part.select(
        key("p_partkey").alias("control_id"),
        (F.col("p_retailprice") * 60).cast("decimal(18,6)").alias("expected"),
    )
    controls = t.control_registry.select(
        "control_id",
        (F.col("tolerance_abs") * 1000).cast("decimal(18,6)").alias("tolerance_abs"),
        (F.col("tolerance_pct") * 10).alias("tolerance_pct"),
        (F.col("materiality_abs") * 100).alias("materiality_abs"),
    )
    joined = controls.join(actual, "control_id").join(expected, "control_id")
    return q.control_outcome(joined).select("control_id", "outcome")


# --- audits of the declared constraints ----------------------------------------------------

GOVERNED = [t for t in declared.SCHEMAS if t in PROJECTIONS]


def _governed(t):
    return {name: t[name] for name in GOVERNED}


def _known(table, *columns):
    return table in PROJECTIONS and set(columns) <= set(PROJECTIONS[table].columns)


def _audit_sql(entries, found, absent):
    """One row per declared constraint; one that no table holds has no counts."""
    parts = [
        f"SELECT *, 'AUDITED' AS status FROM ({found(*e)})" if known else f"SELECT {absent(*e)}, 'ABSENT' AS status"
        for e, known in entries
    ]
    return "\nUNION ALL BY NAME ".join(parts)


def _pk(t, cols):
    some = " OR ".join(f"{c} IS NULL" for c in cols)
    return f"""SELECT '{t}' AS table_name, '{",".join(cols)}' AS key_columns, CAST(coalesce(sum(n), 0) AS BIGINT) AS row_count,
  CAST(coalesce(sum(n) FILTER ({some}), 0) AS BIGINT) AS null_key_rows, count(*) FILTER (n > 1 AND NOT ({some})) AS repeated_keys,
  CAST(coalesce(sum(n - 1) FILTER (NOT ({some})), 0) AS BIGINT) AS surplus_rows
FROM (SELECT {", ".join(cols)}, count(*) AS n FROM {t} GROUP BY {", ".join(cols)})"""


PK_SQL = _audit_sql(
    [((t, cols), _known(t, *cols)) for t, cols in declared.PRIMARY_KEYS.items()],
    _pk, lambda t, cols: f"'{t}' AS table_name, '{','.join(cols)}' AS key_columns",
)


@query("audit_primary_key", " ".join(GOVERNED), PK_SQL)
def _(t):
    return au.audit_registry(t.spark, _governed(t), "primary_key")


def _fk(c, cc, p, pc):
    return f"""SELECT '{c}' AS child_table, '{cc}' AS child_columns, '{p}' AS parent_table, count({cc}) AS keyed_rows,
  count({cc}) FILTER ({cc} NOT IN (SELECT {pc} FROM {p} WHERE {pc} IS NOT NULL)) AS orphan_rows FROM {c}"""


FK_SQL = _audit_sql(
    [((c, cc, p, pc), _known(c, cc) and _known(p, pc)) for c, cc, p, pc in declared.FOREIGN_KEYS],
    _fk, lambda c, cc, p, pc: f"'{c}' AS child_table, '{cc}' AS child_columns, '{p}' AS parent_table",
)


@query("audit_foreign_key", " ".join(GOVERNED), FK_SQL)
def _(t):
    return au.audit_registry(t.spark, _governed(t), "foreign_key")


@query(
    "audit_not_null",
    " ".join(GOVERNED),
    _audit_sql(
        [((t, c), _known(t, c)) for t, cols in declared.NOT_NULL.items() for c in cols],
        lambda t, c: f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, "
        f"count(*) FILTER ({c} IS NULL) AS null_rows FROM {t}",
        lambda t, c: f"'{t}' AS table_name, '{c}' AS column_name",
    ),
)
def _(t):
    return au.audit_registry(t.spark, _governed(t), "not_null")


def _quoted(values):
    return ", ".join(f"'{v}'" for v in values)


@query(
    "audit_vocabulary",
    " ".join(GOVERNED),
    _audit_sql(
        [((t, c, allowed), _known(t, c)) for (t, c), allowed in declared.VOCABULARIES.items()],
        lambda t, c, allowed: f"SELECT '{t}' AS table_name, '{c}' AS column_name, count({c}) AS labelled_rows, "
        f"count(*) FILTER (NOT list_contains([{_quoted(allowed)}], {c})) AS unknown_rows FROM {t}",
        lambda t, c, allowed: f"'{t}' AS table_name, '{c}' AS column_name",
    ),
)
def _(t):
    return au.audit_registry(t.spark, _governed(t), "vocabulary")
