"""Versioned tables: equal to the whole merges, and untouched files keep their names."""

import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stewardspark.operators import upsert as u
from stewardspark.session import scratch_path
from stewardspark.sources import versioned

DDL = "k string, a int, b string"


def table(spark, rows, ddl=DDL, files=4):
    root = scratch_path(spark, "versioned")
    versioned.create(spark.createDataFrame(rows, ddl).repartitionByRange(files, "k"), root)
    return root


def files_of(spark, root, version=None):
    return {r["file"] for r in versioned.manifest(spark, root, version).collect()}


ROWS = [(f"k{i:03d}", i, "old") for i in range(100)]


def test_only_touched_files_are_rewritten(spark, rows):
    root = table(spark, ROWS)
    before = files_of(spark, root)
    assert len(before) == 4
    source = spark.createDataFrame([("k002", -1, "new"), ("k003", -2, "new"), ("new", 0, "new")], DDL)
    assert versioned.merge(root, source, ["k"]) == 1
    after = files_of(spark, root)
    assert len(before & after) == 3
    want = u.upsert(spark.createDataFrame(ROWS, DDL), source, ["k"])
    assert rows(versioned.read(spark, root)) == rows(want)
    # The earlier version stays as it was.
    assert rows(versioned.read(spark, root, 0)) == sorted(ROWS)
    assert versioned.versions(spark, root) == [0, 1]


def test_insert_only_keeps_every_file(spark, rows):
    root = table(spark, ROWS)
    before = files_of(spark, root)
    source = spark.createDataFrame([("k002", -1, "new"), ("x", 0, "new"), (None, 1, "new")], DDL)
    versioned.merge(root, source, ["k"], update_cols=[])
    assert before < files_of(spark, root)
    assert rows(versioned.read(spark, root)) == rows(u.upsert(spark.createDataFrame(ROWS, DDL), source, ["k"], []))


def test_a_merge_that_touches_nothing_leaves_all_files(spark, rows):
    root = table(spark, ROWS)
    before = files_of(spark, root)
    versioned.merge(root, spark.createDataFrame([], DDL), ["k"])
    assert files_of(spark, root) == before
    assert rows(versioned.read(spark, root)) == sorted(ROWS)


def test_update_and_delete_by_predicate(spark, rows):
    root = table(spark, ROWS)
    before = files_of(spark, root)
    versioned.update(spark, root, F.col("a") < 5, {"b": F.lit("low")})
    middle = files_of(spark, root)
    assert len(before & middle) == 3
    versioned.delete(spark, root, F.col("a") >= 90)
    assert len(middle & files_of(spark, root)) == 3
    assert rows(versioned.read(spark, root)) == [(k, a, "low" if a < 5 else b) for k, a, b in ROWS if a < 90]
    versioned.delete(spark, root, F.lit(True))
    assert versioned.read(spark, root).collect() == [] and versioned.read(spark, root).columns == ["k", "a", "b"]
    versioned.merge(root, spark.createDataFrame([("z", 1, "again")], DDL), ["k"])
    assert rows(versioned.read(spark, root)) == [("z", 1, "again")]


def test_purge_drops_whole_files_and_keeps_rows_without_a_time(spark):
    root = scratch_path(spark, "versioned")
    log = spark.range(100).selectExpr("id", "IF(id = 7, NULL, TIMESTAMP'2024-01-01' + make_dt_interval(id)) AS ts")
    versioned.create(log.repartitionByRange(5, "ts"), root)
    before = files_of(spark, root)
    versioned.purge(spark, root, "ts", 30, "2024-04-01")
    want = u.purge_older_than(log, "ts", 30, "2024-04-01")
    assert sorted(r.id for r in versioned.read(spark, root).collect()) == sorted(r.id for r in want.collect())
    assert len(before & files_of(spark, root)) >= 1


def test_a_repeated_source_key_fails_and_leaves_the_table(spark, rows):
    root = table(spark, ROWS)
    source = spark.createDataFrame([("k001", 1, "p"), ("k001", 2, "q")], DDL)
    with pytest.raises(Exception, match="more than one source row"):
        versioned.merge(root, source, ["k"])
    assert versioned.versions(spark, root) == [0]
    assert rows(versioned.read(spark, root)) == sorted(ROWS)


def test_the_second_writer_of_a_version_fails(spark):
    root = table(spark, ROWS)
    versioned._commit(spark, root, 1, versioned.read(spark, root).schema, [])
    with pytest.raises(Exception, match="(?i)already exists"):
        versioned._commit(spark, root, 1, versioned.read(spark, root).schema, [])


def test_expired_versions_go_and_the_newest_stays(spark, rows):
    root = table(spark, ROWS)
    for n in range(3):
        versioned.merge(root, spark.createDataFrame([("k002", n, "new")], DDL), ["k"])
    versioned.expire(spark, root)
    assert versioned.versions(spark, root) == [3]
    assert rows(versioned.read(spark, root)) == sorted([("k002", 2, "new")] + [r for r in ROWS if r[0] != "k002"])


KEY = st.sampled_from(["a", "b", "c", "d", "A", None])
ROW = st.tuples(KEY, st.integers(0, 3) | st.none(), st.sampled_from(["x", "y", None]))


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(target=st.lists(ROW, max_size=6), source=st.lists(ROW, max_size=4, unique_by=lambda r: (r[0] or "").upper()), fold=st.booleans())
def test_equals_the_whole_merge(spark, rows, target, source, fold):
    expr = F.upper if fold else None
    old, new = spark.createDataFrame(target, DDL), spark.createDataFrame(source, DDL)
    root = scratch_path(spark, f"versioned-{uuid.uuid4().hex}")
    versioned.create(old.repartition(3, "k"), root)
    versioned.merge(root, new, ["k"], key_expr=expr)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = u.upsert(old, new, ["k"], key_expr=expr)
    assert sorted(map(tuple, versioned.read(spark, root).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_rows_carry_a_number_for_their_file(spark, tmp_path):
    """The join that finds touched files sorts every row: a path in each would be most of it."""
    root, kinds = str(tmp_path / "t"), []
    versioned.create(spark.range(100).repartitionByRange(4, "id"), root)
    before = set(r["file"] for r in versioned.manifest(spark, root).collect())

    def touching(rows):
        kinds.append(dict(rows.dtypes)["_file"])
        return rows.where("id < 3")

    versioned._rewrite(spark, root, touching, lambda rows: rows.where("id <> 1"))
    after = set(r["file"] for r in versioned.manifest(spark, root).collect())
    assert kinds == ["bigint"] and len(before & after) == 3
    assert sorted(r[0] for r in versioned.read(spark, root).collect()) == [i for i in range(100) if i != 1]
