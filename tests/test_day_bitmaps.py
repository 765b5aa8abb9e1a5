"""Distinct counts from bitmaps: exact over any days, groups and batches."""

import datetime as dt
import random

from stewardspark.operators import day_bitmaps as b
from stewardspark.session import scratch_path


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_counts_of_days_and_groups(spark, monkeypatch):
    draw = random.Random(2)
    rows = [(day(draw.choice([0, 1, 2, 5, 9])), f"v{draw.randrange(400)}") for _ in range(900)]
    folder = scratch_path(spark, "bitmaps")
    odd = [(None, "v1"), (day(3), None)]
    for name, some in (("a", rows[:500]), ("b", rows[500:]), ("a", rows[:500])):
        b.take(folder, name, spark.createDataFrame(some + odd, "metric_date date, value string").repartition(3))
    values = {v for _, v in rows}
    ids = {r["value"]: r["id"] for r in b.known_ids(spark, folder).collect()}
    assert set(ids) == values and sorted(ids.values()) == list(range(1, len(values) + 1))
    for days in (1, 3, 30):
        want = {d: len({v for e, v in rows if 0 <= (d - e).days < days}) for d in {d for d, _ in rows}}
        assert {tuple(r) for r in b.rolling_distinct(spark, folder, days).collect()} == set(want.items())
    members = [(f"g{i % 3}" if i % 5 else None, f"v{i}") for i in range(0, 450, 2)] + [("empty", "unseen")]
    found = b.distinct_by_group(spark, folder, spark.createDataFrame(members, "grp string, value string"), "grp", day(1), day(5))
    seen = {v for d, v in rows if day(1) <= d <= day(5)}
    want = {g: len({v for h, v in members if h == g} & seen) for g in {g for g, _ in members}}
    assert {tuple(r) for r in found.collect()} == {(g, n) for g, n in want.items() if n}


def test_many_values_take_several_bitmaps(spark):
    folder = scratch_path(spark, "bitmaps")
    rows = spark.range(70_000).selectExpr("DATE'2024-01-01' AS metric_date", "CAST(id AS STRING) AS value")
    b.take(folder, "one", rows)
    assert b.by_day(spark, folder).count() == 3
    assert [r["distinct_values"] for r in b.rolling_distinct(spark, folder, 2).collect()] == [70_000]


def test_nothing(spark):
    folder = scratch_path(spark, "bitmaps")
    b.take(folder, "none", spark.createDataFrame([], "metric_date date, value string"))
    assert b.rolling_distinct(spark, folder, 7).collect() == [] and b.known_ids(spark, folder).collect() == []
