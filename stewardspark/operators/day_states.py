"""Daily metrics that take in only new rows.

What a day needs of a log are sums, counts and maxima, so they can be kept per batch of rows
and merged when they are read. A batch adds its states, one folder per day and batch, and the
days that it touches, late ones too, are computed anew from their states; no log is read
again and no other day is written. A batch that is taken twice replaces its own states, so
it counts once. Domains are looked up when a day is computed.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import AsOf, day_start, minutes_crossed
from ..functions.ratios import count_where
from ..sources.snapshots import write_daily
from . import metrics as m

# Of each log: its time and the key that its rows are counted by.
_LOGS = {
    "process": ("started_at", None), "quality": ("created_at", "dataset_id"), "control": ("executed_at", "control_id"),
}
_TOTALS = {"quality": "total_dq_tests", "control": "total_control_tests"}
_SUMS = {
    "process": ("total_runs", "successful_runs", "failed_runs", "minutes", "timed_runs"),
    "quality": ("total_dq_tests", "passed", "failed", "warning"),
    "control": ("total_control_tests", "passed", "failed", "warning"),
}


def states(kind: str, rows: DataFrame) -> DataFrame:
    """The day states of some rows of a log; rows without a time belong to no day."""
    ts, key = _LOGS[kind]
    dated = rows.where(F.col(ts).isNotNull()).withColumn("metric_date", F.to_date(ts))
    if kind == "process":
        minutes = minutes_crossed("started_at", "ended_at")
        return dated.groupBy("metric_date").agg(
            F.count(F.lit(1)).alias("total_runs"),
            count_where(F.col("status") == "SUCCESS").alias("successful_runs"),
            count_where(F.col("status") == "FAILED").alias("failed_runs"),
            F.coalesce(F.sum(minutes), F.lit(0)).alias("minutes"),
            F.count(minutes).alias("timed_runs"),
            F.max(minutes).alias("max_duration_minutes"),
        )
    return dated.groupBy("metric_date", key).agg(
        F.count(F.lit(1)).alias(_TOTALS[kind]),
        *[count_where(F.col("outcome") == o).alias(n) for o, n in (("PASS", "passed"), ("FAIL", "failed"), ("WARN", "warning"))],
    )


def _schema(kind: str) -> str:
    _, key = _LOGS[kind]
    columns = [f"{key} string"] * bool(key) + [f"{c} bigint" for c in _SUMS[kind]]
    return ", ".join([*columns, "max_duration_minutes bigint"] if kind == "process" else columns)


def merged(spark: SparkSession, folder: str, kind: str, days: Sequence[dt.date] | None = None) -> DataFrame:
    """The states of a log summed over all batches, of the given days or of all."""
    _, key = _LOGS[kind]
    stored = spark.read.schema(f"{_schema(kind)}, metric_date date, batch string").parquet(f"{folder}/states/{kind}")
    if days is not None:
        stored = stored.where(F.col("metric_date").isin(list(days)))
    tops = [F.max("max_duration_minutes").alias("max_duration_minutes")] * (kind == "process")
    return stored.groupBy("metric_date", *[key] * bool(key)).agg(*[F.sum(c).alias(c) for c in _SUMS[kind]], *tops)


def add_batch(folder: str, batch: str, run: DataFrame, res: DataFrame, test: DataFrame) -> list[dt.date]:
    """Keeps the states of a batch of new rows under its name; returns the days that it touches.

    The days come to the driver: as many as a batch has days, whatever its rows.
    """
    days: set[dt.date] = set()
    for kind, rows in (("process", run), ("quality", res), ("control", test)):
        path = f"{folder}/states/{kind}"
        columns = [f"CAST({c.rsplit(' ', 1)[0]} AS {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in _schema(kind).split(", ")]
        new = states(kind, rows).selectExpr(*columns, "metric_date").withColumn("batch", F.lit(batch))
        (
            new.hint("rebalance", "metric_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("metric_date", "batch").parquet(path)
        )
        stored = rows.sparkSession.read.schema("metric_date date, batch string").parquet(path)
        days |= {r[0] for r in stored.where(F.col("batch") == batch).select("metric_date").distinct().collect()}
    return sorted(days)


def daily(
    spark: SparkSession, folder: str, control: DataFrame, ds: DataFrame, domain: DataFrame, as_of: AsOf,
    days: Sequence[dt.date] | None = None,
) -> DataFrame:
    """The rows of ``governance_metrics`` from the states, of the given days or of all."""
    runs = merged(spark, folder, "process", days).select(
        "metric_date", "total_runs", "successful_runs", "failed_runs",
        (F.col("minutes") / F.nullif("timed_runs", F.lit(0))).alias("avg_duration_minutes"),
        "max_duration_minutes", F.lit(m.ALL_DOMAINS).alias("domain_name"),
    )
    tests = m.by_domain(merged(spark, folder, "quality", days), "dataset_id", m.dataset_domains(ds, domain), "total_dq_tests")
    controls = m.by_domain(
        merged(spark, folder, "control", days), "control_id", m.control_domains(control, ds, domain), "total_control_tests"
    )
    return m.side_by_side(
        runs, tests.withColumnsRenamed(m.QUALITY_NAMES), controls.withColumnsRenamed(m.CONTROL_NAMES), as_of
    )


def refresh(
    folder: str, batch: str, run: DataFrame, res: DataFrame, test: DataFrame, control: DataFrame, ds: DataFrame,
    domain: DataFrame, as_of: AsOf,
) -> list[dt.date]:
    """Takes in a batch of new rows and writes the metrics of the days that it touches.

    ``run``, ``res`` and ``test`` hold only the new rows. Returns the days written. After a
    change of domains, ``rewrite`` brings the other days up to date.
    """
    days = add_batch(folder, batch, run, res, test)
    if days:
        rewrite(run.sparkSession, folder, control, ds, domain, as_of, days)
    return days


def rewrite(
    spark: SparkSession, folder: str, control: DataFrame, ds: DataFrame, domain: DataFrame, as_of: AsOf,
    days: Sequence[dt.date] | None = None,
) -> None:
    """Writes the metrics of the given days, or of all, from the states."""
    write_daily(daily(spark, folder, control, ds, domain, as_of, days), f"{folder}/metrics")


def recent(spark: SparkSession, folder: str, as_of: AsOf, days: int = 30) -> DataFrame:
    """The written metrics of the days since ``days`` before ``as_of``."""
    found = spark.read.parquet(f"{folder}/metrics")
    return found.where(F.col("metric_date") >= day_start(as_of, days).cast("date"))
