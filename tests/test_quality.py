import datetime as dt

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import audits, quality as q


@pytest.mark.parametrize(
    "rate, expected", [(100.0, "PASS"), (98.0, "PASS"), (97.9, "WARN"), (93.0, "WARN"),
                       (92.9, "FAIL"), (None, "PASS")]
)
def test_outcome(spark, rate, expected):
    df = spark.createDataFrame([(rate,)], "r double")
    assert df.select(q.outcome("r", 98.0)).first()[0] == expected


def one(df):
    (row,) = df.collect()
    return row


def test_validity_ignores_nulls_and_bounds_are_inclusive(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (5.1,), (None,), (-1.0,)], "x double")
    both = one(q.validity_range(df, "x", 0, 5))
    assert (both.row_count, both.failed_count, both.rate, both.outcome) == (5, 2, 60.0, "FAIL")
    assert one(q.validity_range(df, "x", lo=0)).failed_count == 1
    assert one(q.completeness(df, "x", 80.0)).outcome == "PASS"


def test_validity_decimal(spark):
    df = spark.createDataFrame([(1.25,), (99.99,), (100.0,), (-100.5,), (1.255,)], "x double")
    assert one(q.validity_decimal(df, "x", 4, 2)).failed_count == 3


def test_uniqueness_counts_surplus_rows_without_null_keys(spark):
    df = spark.createDataFrame(
        [("a", 1), ("a", 1), ("a", 1), ("a", 2), (None, 1), (None, 1)], "x string, y int"
    )
    row = one(q.uniqueness(df, "x, y"))
    assert (row.row_count, row.failed_count, row.rate) == (4, 2, 50.0)


def test_empty_tables_pass(spark):
    df = spark.createDataFrame([], "x double")
    for check in (q.completeness(df, "x"), q.uniqueness(df, "x"), q.validity_range(df, "x", 0)):
        row = one(check)
        assert (row.row_count, row.failed_count, row.rate, row.outcome) == (0, 0, None, "PASS")
    assert one(q.row_count_check({"t": df}, 1)).outcome == "FAIL"
    assert one(q.row_count_check({"t": df}, 0)).outcome == "PASS"


def test_consistency(spark):
    child = spark.createDataFrame([("a",), ("a",), ("z",), ("z",), (None,)], "p string")
    parent = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    row = one(q.consistency_fk(child, parent, [("p", "id")]))
    assert (row.row_count, row.failed_count) == (4, 2)


def test_rules_share_one_scan_and_skip_disabled(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    rules = [
        q.Rule("r1", "COMPLETENESS", "t", "s"),
        q.Rule("r2", "VALIDITY", "t", "n", {"allowed": [1]}),
        q.Rule("r3", "VALIDITY", "t", "s", {"pattern": "^b"}),
        q.Rule("r4", "UNIQUENESS", "t", "n"),
        q.Rule("off", "COMPLETENESS", "t", "s", enabled_flag=False),
    ]
    got = {r.rule_id: r.failed_count for r in q.run_rules(rules, {"t": df}).collect()}
    assert got == {"r1": 1, "r2": 1, "r3": 1, "r4": 0}


def test_many_rules_are_split_into_aggregates(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "n int")
    rules = [
        q.Rule(f"r{i}", "VALIDITY", "t", "n", {"max_value": i % 10}) for i in range(230)
    ]
    got = {r.rule_id: r.failed_count for r in q.run_rules(rules, {"t": df}).collect()}
    assert got == {f"r{i}": 9 - i % 10 for i in range(230)}


def test_a_registry_with_all_types_and_broken_rules(spark):
    ddl = "rule_id string, rule_type string, dataset_id string, column_name string, config_json string, enabled_flag boolean"
    t = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None)], "k int, v double")
    other = spark.createDataFrame([(1, 1.0), (2, 9.0)], "k int, v double")
    registry = spark.createDataFrame(
        [
            ("ok", "COMPLETENESS", "t", "v", None, True),
            ("acc", "ACCURACY", "t", "v", '{"source": "other", "keys": ["k"]}', True),
            ("drift", "SCHEMA_DRIFT", "t", None, '{"columns": {"k": "int", "v": "string", "w": "int"}}', True),
            ("no table", "COMPLETENESS", "missing", "v", None, True),
            ("no column", "VALIDITY", "t", "zz", '{"min_value": 0}', True),
            ("no check", "VALIDITY", "t", "v", "{}", True),
            ("bad json", "VALIDITY", "t", "v", "{", True),
            ("no parent", "CONSISTENCY", "t", "k", "{}", True),
            ("no type", "MAGIC", "t", "k", None, True),
            ("no time", "TIMELINESS", "t", "v", '{"max_age_days": 1}', True),
        ],
        ddl,
    )
    got = {r.rule_id: (r.row_count, r.failed_count, r.outcome) for r in
           q.run_rules(q.load_rules(registry), {"t": t, "other": other}).collect()}
    assert got == {
        "ok": (3, 1, "FAIL"), "acc": (3, 2, "FAIL"), "drift": (3, 2, "FAIL"),
        **{k: (None, None, "ERROR") for k in ("no table", "no column", "no check", "bad json", "no parent", "no type", "no time")},
    }


def test_load_rules_reads_the_registry(spark):
    registry = spark.createDataFrame(
        [("a", "VALIDITY", "t", "n", '{"min_value": 2}', True),
         ("b", "COMPLETENESS", "t", "n", None, True),
         ("c", "COMPLETENESS", "t", "n", None, False)],
        "rule_id string, rule_type string, dataset_id string, column_name string, "
        "config_json string, enabled_flag boolean",
    )
    df = spark.createDataFrame([(1,), (None,)], "n int")
    got = {r.rule_id: r.failed_count for r in q.run_rules(q.load_rules(registry), {"t": df}).collect()}
    assert got == {"a": 1, "b": 1}


def test_reconcile(spark):
    def many(**loads):
        return spark.createDataFrame([(k,) for k, n in loads.items() for _ in range(n)], "k string")

    got = q.reconcile_counts(
        many(a=100, b=100, c=100), many(a=97, b=97, c=80, d=1), many(a=3, b=4, c=6), ["k"]
    )
    found = {r.k: (r.outcome, r.success_rate) for r in got.collect()}
    assert found == {
        "a": ("PASS", 97.0), "b": ("WARN", 97.0), "c": ("FAIL", 80.0), "d": ("FAIL", None)
    }


def test_accuracy(spark):
    ddl = "k string, v double"
    a = spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", None), ("d", 1.0), ("e", None)], ddl)
    b = spark.createDataFrame([("a", 10.4), ("b", 12.0), ("c", None), ("x", 1.0), ("e", 5.0)], ddl)
    row = one(q.accuracy_vs_source(a, b, ["k"], "v", tol_abs=0.5, tol_pct=1.0))
    assert (row.row_count, row.compared, row.mismatched) == (6, 4, 2)
    assert (row.missing_in_source, row.missing_in_actual, row.outcome) == (1, 1, "FAIL")


def test_control_outcome(spark):
    df = spark.createDataFrame(
        [("in", 100, 101, 2, 5, 1), ("pct", 100, 110, 20, 5, 50), ("out", 100, 200, 1, 1, 50),
         ("strict", 100, 101, None, None, 0), ("same", 100, 100, None, None, None)],
        "id string, expected int, actual int, tolerance_abs int, tolerance_pct int, materiality_abs int",
    )
    dec = df.select("id", *[F.col(c).cast("decimal(18,6)") for c in df.columns[1:]])
    got = {r.id: r.outcome for r in q.control_outcome(dec).collect()}
    assert got == {"in": "PASS", "pct": "WARN", "out": "FAIL", "strict": "FAIL", "same": "PASS"}


def test_timeliness_and_drift(spark, rows):
    df = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 1, 23, 59)), ("b", dt.datetime(2024, 1, 9))],
        "g string, t timestamp_ntz",
    )
    none = spark.createDataFrame([], df.schema)
    unknown = spark.createDataFrame([("a", None)], df.schema)
    rule = q.Rule("r", "TIMELINESS", "t", "t", {"max_age_days": 2})
    for frame, state in ((none, "PASS"), (unknown, "FAIL")):
        assert one(q.timeliness(frame, "t", 2, "2024-01-10")).outcome == state
        assert one(q.run_rules([rule], {"t": frame}, "2024-01-10")).outcome == state
    got = q.timeliness(df, "t", 2, "2024-01-10", ["g"])
    assert rows(got, "g", "age_days", "outcome") == [("a", 9, "FAIL"), ("b", 1, "PASS")]
    old = spark.createDataFrame([("x", "int"), ("y", "int"), ("z", "int")], "column_name string, data_type string")
    new = spark.createDataFrame([("x", "int"), ("y", "string"), ("w", "int")], "column_name string, data_type string")
    assert rows(q.schema_drift(old, new), "column_name", "change") == [
        ("w", "ADDED"), ("y", "RETYPED"), ("z", "REMOVED")
    ]


def test_recorded_results_name_their_metrics(spark):
    df = spark.createDataFrame([(1,), (None,)], "n int")
    row = one(q.as_dq_results(q.completeness(df, "n", rule_id="R1", dataset_id="D"), "RUN-1", "2024-01-01"))
    assert row.metrics_summary == '{"completeness_rate":50.0,"null_count":1,"row_count":2}'
    assert row.evidence_ref == "evidence/r1/run-1.json"


def test_audits(spark, rows):
    t = spark.createDataFrame([("a", 1), ("a", 1), ("b", None), (None, 2)], "k string, p int")
    empty = spark.createDataFrame([], "k string")
    keys = [audits.KeySpec("t", t, ["k"]), audits.KeySpec("t2", t, ["k", "p"]),
            audits.KeySpec("none", empty, ["k"])]
    assert rows(audits.audit_primary_keys(keys)) == [
        ("none", "k", 0, 0, 0, 0), ("t", "k", 4, 1, 1, 1), ("t2", "k,p", 4, 2, 1, 1)
    ]
    parent = spark.createDataFrame([(1,), (1,)], "id int")
    refs = [audits.ReferenceSpec("t", t, ["p"], "parent", parent, ["id"]),
            audits.ReferenceSpec("t", t, ["k"], "t", t, ["k"])]
    assert rows(audits.audit_foreign_keys(refs)) == [
        ("t", "k", "t", 3, 0), ("t", "p", "parent", 3, 1)
    ]
    assert rows(audits.audit_not_null([audits.KeySpec("t", t, ["k", "p"])])) == [
        ("t", "k", 4, 1), ("t", "p", 4, 1)
    ]
    words = [audits.VocabularySpec("t", t, "k", ["a"])]
    assert rows(audits.audit_vocabulary(words)) == [("t", "k", 3, 1)]


def test_a_composite_key_is_not_confused_by_separators(spark):
    t = spark.createDataFrame([("a,b", "c"), ("a", "b,c"), ('a","b', "c")], "x string, y string")
    row = one(audits.audit_primary_keys([audits.KeySpec("t", t, ["x", "y"])]))
    assert row.repeated_keys == 0


def test_absent_constraints_are_reported(spark, rows):
    tables = {"dim_term": spark.createDataFrame([("T", None, "Draft")], "term_id string, term_name string, status string")}
    shown = {w: audits.audit_registry(spark, tables, w) for w in ("primary_key", "foreign_key", "not_null", "vocabulary")}
    sizes = {w: (df.count(), df.where("status = 'AUDITED'").count()) for w, df in shown.items()}
    assert sizes == {"primary_key": (31, 1), "foreign_key": (42, 0), "not_null": (18, 1), "vocabulary": (35, 1)}
    assert rows(shown["not_null"].where("status = 'AUDITED'")) == [("dim_term", "term_name", 1, 1, "AUDITED")]
    assert rows(shown["vocabulary"].where("table_name = 'dim_cde'")) == []
    assert shown["primary_key"].where("status = 'ABSENT' AND row_count IS NULL").count() == 30


def test_every_declared_reference_is_reported(spark):
    parent = spark.createDataFrame([("P",)], "party_id string")
    child = spark.createDataFrame([("P",), ("Q",), (None,)], "owner_party_id string")
    found = audits.audit_registry(spark, {"dim_party": parent, "risk_item": child}, "foreign_key").collect()
    assert len(found) == 42
    (one_,) = [r for r in found if r.status == "AUDITED"]
    assert (one_.child_table, one_.keyed_rows, one_.orphan_rows) == ("risk_item", 2, 1)


def test_a_bad_rule_does_not_stop_the_others(spark):
    """Faults that only show when rows are read: patterns, text where numbers or times are asked for."""
    df = spark.createDataFrame(
        [("1", "2024-01-31", 1, "2024-01-01"), ("x", "soon", 2, "2024-02-01"), (None, None, 3, None)],
        "n string, seen string, k int, day string",
    ).withColumn("day", F.col("day").cast("date"))
    parent = spark.createDataFrame([("1",), ("2",), ("b",)], "k string")
    rules = [
        q.Rule("good", "COMPLETENESS", "t", "n"),
        q.Rule("bad pattern", "VALIDITY", "t", "n", {"pattern": "(["}),
        q.Rule("pattern", "VALIDITY", "t", "n", {"pattern": "^[0-9]$"}),
        q.Rule("number pattern", "VALIDITY", "t", "k", {"pattern": "^[12]$"}),
        q.Rule("text range", "VALIDITY", "t", "n", {"min_value": 0, "max_value": 5}),
        q.Rule("text precision", "VALIDITY", "t", "n", {"precision": 3, "scale": 0}),
        q.Rule("text allowed", "VALIDITY", "t", "n", {"allowed": [1, 2]}),
        q.Rule("number allowed", "VALIDITY", "t", "k", {"allowed": ["1", "b"]}),
        q.Rule("date range", "VALIDITY", "t", "day", {"min_value": "2024-01-15"}),
        q.Rule("bad date", "VALIDITY", "t", "day", {"min_value": "never"}),
        q.Rule("bad bound", "VALIDITY", "t", "k", {"min_value": "many"}),
        q.Rule("text time", "TIMELINESS", "t", "seen", {"max_age_days": 5}),
        q.Rule("number time", "TIMELINESS", "t", "k", {"max_age_days": 5}),
        q.Rule("kinds", "CONSISTENCY", "t", "k", {"parent": "p", "parent_column": "k"}),
        q.Rule("text accuracy", "ACCURACY", "t", "n", {"source": "t", "keys": ["k"]}),
        q.Rule("no column", "TIMELINESS", "t", None, {"max_age_days": 5}),
    ]
    found = q.run_rules(rules, {"t": df, "p": parent}, "2024-02-02").collect()
    assert {r.rule_id: r.failed_count for r in found if r.outcome != "ERROR"} == {
        "good": 1, "pattern": 1, "number pattern": 1, "text range": 1, "text precision": 1, "text allowed": 1,
        "number allowed": 2, "date range": 1, "text time": 0, "kinds": 1,
    }
    assert {r.rule_id for r in found if r.outcome == "ERROR"} == {
        "bad pattern", "bad date", "bad bound", "number time", "text accuracy", "no column",
    }


def test_no_enabled_rule_gives_no_rows(spark):
    df = spark.createDataFrame([(1,)], "n int")
    off = q.Rule("off", "COMPLETENESS", "t", "n", enabled_flag=False)
    some = q.run_rules([q.Rule("on", "COMPLETENESS", "t", "n")], {"t": df})
    for rules, tables in (([], {"t": df}), ([off], {"t": df}), ([off], {})):
        none = q.run_rules(rules, tables)
        assert none.collect() == [] and none.dtypes == some.dtypes
