import functools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stewardspark.operators import upsert as u

DDL = "k string, a int, b string"


@pytest.fixture(params=[False, True], ids=["small source", "large source"])
def merge(request):
    return functools.partial(u.upsert, large_source=request.param)


def frame(spark, data, ddl=DDL):
    return spark.createDataFrame(data, ddl)


def test_update_takes_listed_columns_only(spark, rows, merge):
    target = frame(spark, [("x", 1, "old"), ("y", 2, "old")])
    source = frame(spark, [("x", 9, "new"), ("z", 8, "new")])
    got = merge(target, source, ["k"], update_cols=["a"], insert_cols=["k", "b"])
    assert rows(got) == [("x", 9, "old"), ("y", 2, "old"), ("z", None, "new")]


def test_insert_only_keeps_old_rows(spark, rows, merge):
    target = frame(spark, [("x", 1, "old")])
    source = frame(spark, [("x", 9, "new"), ("z", 8, "new")])
    assert rows(merge(target, source, ["k"], update_cols=[])) == [
        ("x", 1, "old"), ("z", 8, "new")
    ]


def test_null_values_overwrite_and_null_keys_insert(spark, rows, merge):
    target = frame(spark, [("x", 1, "old"), (None, 5, "old")])
    source = frame(spark, [("x", None, None), (None, 7, "new")])
    assert rows(merge(target, source, ["k"])) == [
        (None, 5, "old"), (None, 7, "new"), ("x", None, None)
    ]


def test_case_folded_key(spark, rows, merge):
    target = frame(spark, [("Home", 1, "old")])
    source = frame(spark, [("HOME", 2, "new"), ("risk", 3, "new")])
    got = merge(target, source, ["k"], update_cols=["a"], key_expr=F.upper)
    assert rows(got) == [("Home", 2, "old"), ("risk", 3, "new")]


def test_two_source_rows_for_a_matched_key_fail(spark, merge):
    target = frame(spark, [("x", 1, "old")])
    source = frame(spark, [("x", 2, "p"), ("x", 3, "q")])
    with pytest.raises(Exception, match="more than one source row"):
        merge(target, source, ["k"]).collect()
    assert u.check_merge_source(source, ["k"]).collect()[0].n == 2


def test_the_guard_survives_column_pruning(spark, merge):
    target = frame(spark, [("x", 1, "old")])
    source = frame(spark, [("x", 2, "p"), ("x", 3, "q")])
    with pytest.raises(Exception, match="more than one source row"):
        merge(target, source, ["k"]).select("k").collect()


def test_repeated_source_keys_without_a_target_row_are_all_inserted(spark, rows, merge):
    target = frame(spark, [("a", 1, "t"), ("b", 2, "t")])
    source = frame(spark, [("c", 3, "s"), ("c", 4, "s"), ("a", 5, "s")])
    assert rows(merge(target, source, ["k"], update_cols=["a"])) == [
        ("a", 5, "t"), ("b", 2, "t"), ("c", 3, "s"), ("c", 4, "s")
    ]


def test_insert_only_never_fails(spark, rows, merge):
    target = frame(spark, [("a", 1, "t")])
    source = frame(spark, [("a", 2, "s"), ("a", 3, "s"), ("b", 4, "s"), ("b", 4, "s")])
    assert rows(merge(target, source, ["k"], update_cols=[])) == [
        ("a", 1, "t"), ("b", 4, "s"), ("b", 4, "s")
    ]


def test_several_target_rows_take_one_source_row(spark, rows, merge):
    target = frame(spark, [("x", 1, "p"), ("x", 2, "q")])
    source = frame(spark, [("x", 9, "new")])
    assert rows(merge(target, source, ["k"], update_cols=["a"])) == [("x", 9, "p"), ("x", 9, "q")]


KEYS = st.sampled_from(["p", "q", "r", "s", None])


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(KEYS, st.integers(0, 9)), max_size=6),
    st.dictionaries(KEYS, st.integers(10, 19), max_size=5),
)
def test_upsert_against_dictionary_and_idempotent(spark, rows, merge, old, new):
    target = frame(spark, [(k, a, "t") for k, a in old])
    source = frame(spark, [(k, a, "s") for k, a in new.items()])
    once = merge(target, source, ["k"], update_cols=["a"])
    known = {k for k, _ in old if k is not None}
    expect = [(k, new[k] if k in new and k is not None else a, "t") for k, a in old]
    expect += [(k, a, "s") for k, a in new.items() if k is None or k not in known]
    assert rows(once) == sorted(expect, key=lambda r: tuple((v is not None, str(v)) for v in r))
    if None not in new:
        assert rows(merge(once, source, ["k"], update_cols=["a"])) == rows(once)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.tuples(KEYS, st.integers(0, 9)), max_size=6),
    st.lists(st.tuples(KEYS, st.integers(10, 19)), max_size=6),
    st.booleans(),
)
def test_both_plans_agree_on_any_input(spark, rows, old, new, updating):
    target = frame(spark, [(k, a, "t") for k, a in old])
    source = frame(spark, [(k, a, "s") for k, a in new])
    known = {k for k, _ in old if k is not None}
    keys = [k for k, _ in new if k in known]
    fails = updating and len(keys) != len(set(keys))
    for large in (False, True):
        got = u.upsert(target, source, ["k"], ["a"] if updating else [], large_source=large)
        if fails:
            with pytest.raises(Exception, match="more than one source row"):
                got.select("b").collect()
            continue
        given = dict(new) if updating else {}
        expect = [(k, given.get(k, a) if k is not None else a, "t") for k, a in old]
        expect += [(k, a, "s") for k, a in new if k is None or k not in known]
        assert rows(got) == sorted(expect, key=lambda r: tuple((v is not None, str(v)) for v in r))


def test_insert_if_absent_keeps_batch_duplicates(spark, rows):
    ddl = "k string, at timestamp_ntz, n int"
    d = __import__("datetime").datetime
    target = frame(spark, [("x", d(2024, 1, 1, 5), 0)], ddl)
    source = frame(
        spark,
        [("x", d(2024, 1, 1, 9), 1), ("x", d(2024, 1, 2), 2), ("y", d(2024, 1, 1), 3),
         ("y", d(2024, 1, 1), 3)],
        ddl,
    )
    got = u.insert_if_absent(target, source, ["k"], "at")
    assert [r[2] for r in rows(got)] == [0, 2, 3, 3]


def test_update_where_reads_the_old_row(spark, rows):
    df = frame(spark, [("x", 1, "p"), ("y", None, "q")])
    got = u.update_where(df, F.col("a") == 1, {"a": F.lit(5), "b": F.col("a").cast("string")})
    assert rows(got) == [("x", 5, "1"), ("y", None, "q")]


def test_purge_keeps_rows_without_time(spark):
    d = __import__("datetime").datetime
    df = spark.createDataFrame(
        [(d(2024, 1, 1),), (d(2024, 1, 11),), (None,)], "ts timestamp_ntz"
    )
    assert u.purge_older_than(df, "ts", 10, "2024-01-20").count() == 2
