"""Daily metrics from day states: equal to the full run after any order of batches."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import day_states as s
from stewardspark.operators import metrics as m
from stewardspark.session import scratch_path

AS_OF = "2024-02-05"


@pytest.fixture(scope="module")
def logs(spark):
    draw = random.Random(1)
    at = lambda: dt.datetime(2024, 1, draw.randrange(1, 7), draw.randrange(24), draw.randrange(60))
    runs = [(f"r{i}", (t := at()), t + dt.timedelta(minutes=draw.randrange(90)) if i % 5 else None, draw.choice(["SUCCESS", "FAILED", "PARTIAL"])) for i in range(60)]
    runs += [("none", None, None, "SUCCESS")]
    results = [(f"e{i}", draw.choice(["d1", "d2", "d3", "d9"]), draw.choice(["PASS", "FAIL", "WARN"]), at() if i else None) for i in range(80)]
    tests = [(f"t{i}", draw.choice(["c1", "c2", "c3"]), draw.choice(["PASS", "FAIL", "WARN"]), at()) for i in range(40)]
    return (
        spark.createDataFrame(runs, "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz, status string"),
        spark.createDataFrame(results, "id string, dataset_id string, outcome string, created_at timestamp_ntz"),
        spark.createDataFrame(tests, "id string, control_id string, outcome string, executed_at timestamp_ntz"),
    )


@pytest.fixture(scope="module")
def registries(spark):
    control = spark.createDataFrame([("c1", "DATASET", "d1"), ("c2", "SYSTEM", "s")], "control_id string, scope_type string, scope_id string")
    ds = spark.createDataFrame([("d1", "o1"), ("d2", "o2"), ("d3", None)], "dataset_id string, domain_id string")
    domain = spark.createDataFrame([("o1", "Risk"), ("o2", "Sales")], "domain_id string, domain_name string")
    return control, ds, domain


def part(df, n):
    return df.where(F.pmod(F.xxhash64(df.columns[0]), F.lit(2)) == n)


def in_order(df):
    names = sorted(df.columns)
    return sorted((tuple(r[c] for c in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("batches", [(0, 1), (1, 0, 1)])
def test_equals_the_full_run(spark, logs, registries, batches):
    control, ds, domain = registries
    folder = scratch_path(spark, "states")
    for n in batches:
        s.refresh(folder, f"b{n}", *[part(df, n) for df in logs], control, ds, domain, AS_OF)
    run, res, test = logs
    want = in_order(m.governance_metrics(run, res, test, control, ds, domain, AS_OF))
    assert in_order(s.recent(spark, folder, AS_OF)) == want
    # A domain that moves shows after a rewrite, without any log.
    moved = ds.withColumn("domain_id", F.lit("o2"))
    s.rewrite(spark, folder, control, moved, domain, AS_OF)
    assert in_order(s.recent(spark, folder, AS_OF)) == in_order(m.governance_metrics(run, res, test, control, moved, domain, AS_OF))


def test_only_touched_days_are_written(spark, logs, registries):
    control, ds, domain = registries
    folder = scratch_path(spark, "states")
    s.refresh(folder, "first", *logs, control, ds, domain, AS_OF)

    def files():
        rows = spark.read.parquet(f"{folder}/metrics").select("metric_date", "_metadata.file_path").distinct().collect()
        return {day: {r[1] for r in group} for day, group in itertools.groupby(sorted(rows), key=lambda r: r[0])}

    before = files()
    late = [df.where(F.lit(False)) for df in logs]
    late[1] = spark.createDataFrame([("late", "d1", "FAIL", dt.datetime(2024, 1, 3, 5))], logs[1].schema)
    assert s.refresh(folder, "second", *late, control, ds, domain, AS_OF) == [dt.date(2024, 1, 3)]
    after = files()
    assert {day for day in before if before[day] != after[day]} == {dt.date(2024, 1, 3)}
    none = [df.where(F.lit(False)) for df in logs]
    assert s.refresh(folder, "empty", *none, control, ds, domain, AS_OF) == [] and files() == after
