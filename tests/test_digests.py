"""Reconciliation by digests: the same answers as whole joins, and equal ranges stay where they are."""

import random

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import digests as d
from stewardspark.operators import quality as q

DDL = "k int, j string, v double, w string"


@pytest.fixture
def sides(spark, monkeypatch):
    monkeypatch.setattr(d, "RANGES", 16)
    monkeypatch.setattr(d, "LEAVES", 16)
    draw = random.Random(1)
    left = [(i, "a" if i % 2 else "b", float(draw.randrange(5)) if i % 7 else None, draw.choice(["x", "", None])) for i in range(500)]
    right = [r for r in left if r[0] % 101 != 3]
    right = [(*r[:2], (r[2] or 0.0) + 3.0, r[3]) if r[0] % 90 == 1 else (*r[:3], None) if r[0] % 120 == 5 else r for r in right]
    right += [(1000 + i, "n", 1.0, None) for i in range(3)]
    extra = [(None, "a", 1.0, "x"), (7000, None, 2.0, None)]
    return left + extra, right + extra


def plain(left, right):
    whole = lambda r: None not in r[:2]
    a, b = ({r[:2]: r[2:] for r in side if whole(r)} for side in (left, right))
    out = [(*k, "DIFFERENT") for k in a.keys() & b.keys() if a[k] != b[k]]
    out += [(*k, "MISSING_RIGHT") for k in a.keys() - b.keys()] + [(*k, "MISSING_LEFT") for k in b.keys() - a.keys()]
    out += [(*r[:2], "MISSING_RIGHT") for r in left if not whole(r)] + [(*r[:2], "MISSING_LEFT") for r in right if not whole(r)]
    return sorted(out, key=str)


def test_changed_rows(spark, sides):
    left, right = sides
    a, b = spark.createDataFrame(left, DDL).repartition(3), spark.createDataFrame(right, DDL)
    assert sorted(map(tuple, d.changed_rows(a, b, ["k", "j"], ["v", "w"]).collect()), key=str) == plain(left, right)
    assert d.changed_rows(a.where("k IS NOT NULL AND j IS NOT NULL"), a.where("k IS NOT NULL AND j IS NOT NULL"), ["k", "j"], ["v", "w"]).collect() == []
    none = a.where(F.lit(False))
    assert d.changed_rows(none, none, ["k", "j"], ["v", "w"]).collect() == []
    assert d.changed_rows(none, b, ["k", "j"], ["v", "w"]).count() == len(right)


def test_rows_of_equal_ranges_are_not_moved(spark):
    """Of 20,000 rows with one change hardly any are left to be joined, and a filter drops the others."""
    a = spark.range(20_000).selectExpr("id AS k", "id * 2 AS v")
    b = a.withColumn("v", F.when(F.col("k") == 777, -1).otherwise(F.col("v")))
    left, right, agreed = d.differing(a, b, ["k"], ["v"])
    assert left.count() == right.count() <= 5 and agreed == 20_000 - left.count()
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftSemi") < plan.index("Filter") and "pmod(xxhash64(" in plan


def test_accuracy_by_digests(spark, sides):
    left, right = sides
    a, b = spark.createDataFrame(left, DDL), spark.createDataFrame(right, DDL).withColumn("v", F.col("v").cast("float"))
    for tolerance in ((0.0, 0.0), (3.0, 0.0), (0.5, 200.0)):
        want = q.accuracy_vs_source(a, b, ["k", "j"], "v", *tolerance).collect()
        found = d.accuracy_by_digests(a, b, ["k", "j"], "v", *tolerance)
        assert found.select(*want[0].__fields__).collect() == want
