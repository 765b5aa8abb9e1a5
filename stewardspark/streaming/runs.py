"""Streams of run events: pairing starts with completions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .results import with_watermark

UNFINISHED = "UNFINISHED"


def stream_run_pairs(
    starts: DataFrame, ends: DataFrame, timeout: str, delay: str = "1 hour"
) -> DataFrame:
    """Runs with their completion, or UNFINISHED once ``timeout`` has passed without one.

    ``starts`` has run_id, process_id, started_at; ``ends`` has run_id, ended_at, status,
    error_message. Repeated starts of a run within the delay count once. A completion that
    comes after the timeout, or later than the delay, is dropped.
    """
    started, ended = dict(starts.dtypes)["started_at"], dict(ends.dtypes)["ended_at"]
    first = with_watermark(starts, "started_at", delay).dropDuplicatesWithinWatermark(["run_id"])
    done = with_watermark(ends, "ended_at", delay).withColumnRenamed("run_id", "ended_run_id")
    on = (
        (F.col("run_id") == F.col("ended_run_id"))
        & (F.col("ended_at") >= F.col("started_at"))
        & (F.col("ended_at") <= F.col("started_at") + F.expr(f"INTERVAL {timeout}"))
    )
    return first.join(done, on, "left").select(
        "run_id",
        "process_id",
        F.col("started_at").cast(started).alias("started_at"),
        F.col("ended_at").cast(ended).alias("ended_at"),
        F.coalesce("status", F.lit(UNFINISHED)).alias("status"),
        "error_message",
    )
