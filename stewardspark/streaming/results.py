"""Streams of quality results: enrichment, windowed counts, sessions, newest rows, dedup.

Functions that need no stream-only feature take a batch frame as well; a watermark has no
effect there, so the batch result is the reference for the finished stream. In append mode
a window is emitted once the watermark passes its end, and rows later than ``delay`` are
dropped. A stream that has come to its end is closed by a ``StreamEnd``: then every window,
session and pair is emitted, and the result equals the batch one for disorder below the delay.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.common import newest, running_max
from ..operators.views import dq_results_enriched
from ..session import drop_folder, folder_names, scratch_path

EVENT_TIME = "created_at"
# Event time of the row that ends a stream: later than any window, session or timeout.
END_TIME = "9999-01-01 00:00:00"


def with_watermark(df: DataFrame, column: str, delay: str) -> DataFrame:
    """A watermark on ``column``; zone-less times become times of the session zone."""
    return df.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


class StreamEnd:
    """The end of a stream, as one row far in the future that is read after all others.

    ``stream`` is the input followed by that row once ``write`` has been called. The row moves
    the watermark past everything before it; its own window never closes, so it shows nowhere.
    ``values`` are what it needs to pass the filters on its way, those that Spark adds for
    join keys included: a key has to be given, one that nothing else has.
    """

    def __init__(self, source: DataFrame, at: str, **values: str):
        spark = source.sparkSession
        self.folder = scratch_path(spark, "stream-end")
        given = {at: END_TIME, **values}
        self.row = spark.range(1).select(
            *[F.lit(given.get(f.name)).cast(f.dataType).alias(f.name) for f in source.schema]
        )
        self.row.where("false").write.parquet(self.folder)
        self.stream = source.unionByName(spark.readStream.schema(source.schema).parquet(self.folder))

    def write(self) -> None:
        self.row.write.mode("append").parquet(self.folder)


def drain(stream: DataFrame, label: str, ends: Sequence[StreamEnd] = ()) -> DataFrame:
    """Runs an append stream over all input at hand into Parquet in the shared folder.

    With ``ends`` it is then resumed from its checkpoint to read the end rows, which empties
    its state into the result.
    """
    spark = stream.sparkSession
    path = scratch_path(spark, label)

    def run() -> None:
        (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", f"{path}-progress")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )

    run()
    if ends:
        for end in ends:
            end.write()
        run()
    return spark.read.schema(stream.schema).parquet(path)


def stream_enrich(
    results: DataFrame, run: DataFrame, ds: DataFrame, rule: DataFrame, party: DataFrame
) -> DataFrame:
    """Results joined to static run, dataset, rule and owner tables."""
    return dq_results_enriched(results, run, ds, rule, party)


def outcome_windows(
    results: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour"
) -> DataFrame:
    """Outcome counts in tumbling or sliding windows of event time."""
    kind = dict(results.dtypes)[EVENT_TIME]
    window = F.window(EVENT_TIME, size, slide)
    return (
        with_watermark(results, EVENT_TIME, delay)
        .groupBy(window.alias("w"), "outcome")
        .agg(F.count(F.lit(1)).alias("results"))
        .select(
            F.col("w.start").cast(kind).alias("window_start"),
            F.col("w.end").cast(kind).alias("window_end"),
            "outcome",
            "results",
        )
    )


def outcome_panes(results: DataFrame, size: str, slide: str, delay: str = "1 hour") -> DataFrame:
    """The sliding windows of ``outcome_windows`` as sums of panes.

    A row is counted once, in its pane of the length of the slide; a window is the sum of the
    panes it is made of. So the state and the exchange hold a row per pane and outcome, where
    a plain sliding window takes a copy of every row for each of its windows. The size has to
    be a multiple of the slide.
    """
    lengths = results.sparkSession.sql(
        f"SELECT CAST(INTERVAL {size} AS INTERVAL DAY TO SECOND) AS size, CAST(INTERVAL {slide} AS INTERVAL DAY TO SECOND) AS slide"
    ).first()
    if lengths["size"] % lengths["slide"]:
        raise ValueError(f"a window of {size} is not made of panes of {slide}")
    kind = dict(results.dtypes)[EVENT_TIME]
    panes = (
        with_watermark(results, EVENT_TIME, delay)
        .groupBy(F.window(EVENT_TIME, slide).alias("pane"), "outcome").agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        panes.groupBy(F.window(F.window_time("pane"), size, slide).alias("w"), "outcome")
        .agg(F.sum("n").alias("results"))
        .select(
            F.col("w.start").cast(kind).alias("window_start"), F.col("w.end").cast(kind).alias("window_end"),
            "outcome", "results",
        )
    )


def failures(results: DataFrame) -> DataFrame:
    return results.where("outcome = 'FAIL'").select("rule_id", EVENT_TIME)


def stream_failure_sessions(
    results: DataFrame, gap: str, delay: str = "1 hour"
) -> DataFrame:
    """Sessions of failures per rule, closed by ``gap`` without a failure."""
    kind = dict(results.dtypes)[EVENT_TIME]
    return (
        with_watermark(failures(results), EVENT_TIME, delay)
        .groupBy("rule_id", F.session_window(EVENT_TIME, gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("failures"))
        .select(
            "rule_id",
            F.col("s.start").cast(kind).alias("session_start"),
            F.col("s.end").cast(kind).alias("session_end"),
            "failures",
        )
    )


def failure_sessions(
    results: DataFrame, gap: str, bucket: str = "day", split_rows: int | None = None
) -> DataFrame:
    """The same sessions over a finished table, with hot rules split by time.

    A failure starts a session when the one before it is further away than the gap. Both
    the failure before and the start of the current session are running maxima; ``split_rows``
    cuts the full buckets of both finer.
    """
    rows = failures(results).groupBy("rule_id", EVENT_TIME).agg(F.count(F.lit(1)).alias("n"))
    at = F.col(EVENT_TIME)
    before = running_max(rows, ["rule_id"], [EVENT_TIME], EVENT_TIME, at, "before", bucket, split_rows=split_rows)
    gap_after = F.col("before") + F.expr(f"INTERVAL {gap}")
    opens = F.col("before").isNull() | (at > gap_after)
    placed = running_max(
        before, ["rule_id"], [EVENT_TIME], EVENT_TIME, F.when(opens, at), "session_start", bucket,
        include_current=True, split_rows=split_rows,
    )
    return placed.groupBy("rule_id", "session_start").agg(
        (F.max(at) + F.expr(f"INTERVAL {gap}")).alias("session_end"),
        F.sum("n").alias("failures"),
    )


NEWEST_FIRST = ("started_at", "run_id", "rule_id", "dataset_id", "evidence_ref")


def stream_latest(
    results: DataFrame,
    run: DataFrame,
    target: str,
    checkpoint: str,
    keys: Sequence[str] = ("rule_id",),
) -> StreamingQuery:
    """Keeps the newest result per key in ``target``, one snapshot folder per micro-batch.

    Start times are compared, so a late older row never replaces a newer one. A result whose
    run is not known yet waits in the snapshot and is tried again with the next micro-batch.
    A repeated micro-batch rewrites its own folder from the one before it, which makes it
    idempotent; folders before that one are removed. Read the outcome with
    ``latest_snapshot``. The state holds one row per key and is rewritten per micro-batch.
    """
    spark = results.sparkSession
    order = [F.desc(c) for c in NEWEST_FIRST]
    started = run.select("run_id", "started_at")

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = [v for v in _versions(spark, target) if v < batch_id]
        arrived = batch
        if before:
            waiting = spark.read.schema(batch.schema).parquet(_version(target, before[-1], "waiting"))
            arrived = arrived.unionByName(waiting)
        rows = newest(arrived.join(started, "run_id"), keys, order)
        if before:
            previous = spark.read.schema(rows.schema).parquet(_version(target, before[-1]))
            rows = newest(rows.unionByName(previous), keys, order)
        held = arrived.join(started, "run_id", "left_anti").select(*batch.columns)
        held.write.mode("overwrite").parquet(_version(target, batch_id, "waiting"))
        rows.write.mode("overwrite").parquet(_version(target, batch_id))
        for old in before[:-1]:
            drop_folder(spark, f"{target}/version={old}")

    return (
        results.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _version(target: str, number: int, part: str = "rows") -> str:
    return f"{target}/version={number}/{part}"


def _versions(spark: SparkSession, target: str, last: str = "rows") -> list[int]:
    """Finished snapshots, oldest first; the part named ``last`` is written last."""
    numbers = [int(n.split("=")[1]) for n in folder_names(spark, target) if n.startswith("version=")]
    return sorted(n for n in numbers if "_SUCCESS" in folder_names(spark, _version(target, n, last)))


def latest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The newest finished snapshot of ``stream_latest``, whichever run has written it."""
    return spark.read.parquet(_version(target, _versions(spark, target)[-1]))


# Buckets of the keys; a micro-batch rewrites those that its rows fall into.
BUCKETS = 256


def stream_newest(
    results: DataFrame, run: DataFrame, target: str, checkpoint: str, keys: Sequence[str] = ("rule_id",),
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """``stream_latest`` for many keys: a micro-batch reads and writes only the buckets it touches.

    Keys are dealt into hash buckets. Each micro-batch writes the touched ones anew into its
    own folder, and an index, a row per bucket, says which folder holds each bucket now. The
    index is written last, so a micro-batch that fails shows nowhere, and a repeated one
    starts from the index before it. Folders that the last two indexes do not name are removed.
    ``buckets`` stays the same for a ``target``. Read the outcome with ``newest_snapshot``.
    """
    spark = results.sparkSession
    order = [F.desc(c) for c in NEWEST_FIRST]
    started = run.select("run_id", "started_at")
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = [v for v in _versions(spark, target, "index") if v < batch_id]
        arrived = batch
        if before:
            waiting = spark.read.schema(batch.schema).parquet(_version(target, before[-1], "waiting"))
            arrived = arrived.unionByName(waiting)
        fresh = newest(arrived.join(started, "run_id"), keys, order).withColumn("bucket", place)
        fresh.write.mode("overwrite").parquet(_version(target, batch_id, "fresh"))
        fresh = spark.read.schema(fresh.schema).parquet(_version(target, batch_id, "fresh"))
        arrived.join(started, "run_id", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(
            _version(target, batch_id, "waiting")
        )
        held = _index(spark, target, before[-1]) if before else {}
        touched = {r["bucket"] for r in fresh.select("bucket").distinct().collect()}
        old = _bucket_rows(spark, target, {b: v for b, v in held.items() if b in touched}, fresh.schema)
        newest(fresh.unionByName(old), keys, order).withColumn("bucket", place).write.mode("overwrite").partitionBy("bucket").parquet(
            _version(target, batch_id)
        )
        now = held | dict.fromkeys(touched, batch_id)
        spark.createDataFrame([(b, v, fresh.schema.json()) for b, v in now.items()] or [(None, None, fresh.schema.json())], _INDEX).coalesce(
            1
        ).write.mode("overwrite").parquet(_version(target, batch_id, "index"))
        used = {batch_id, *now.values(), *before[-1:], *held.values()}
        for name in folder_names(spark, target):
            number = int(name.split("=")[1])
            if number not in used:
                drop_folder(spark, f"{target}/{name}")

    return (
        results.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_INDEX = "bucket int, version bigint, schema string"


def _index(spark: SparkSession, target: str, number: int) -> dict[int, int]:
    """Which folder holds each bucket; at most as many entries as there are buckets."""
    rows = spark.read.schema(_INDEX).parquet(_version(target, number, "index")).where("bucket IS NOT NULL").collect()
    return {r["bucket"]: r["version"] for r in rows}


def _bucket_rows(spark: SparkSession, target: str, held: dict[int, int], schema: StructType) -> DataFrame:
    paths = [f"{_version(target, v)}/bucket={b}" for b, v in held.items()]
    if not paths:
        return spark.createDataFrame([], schema)
    inside = StructType([f for f in schema.fields if f.name != "bucket"])
    return spark.read.schema(inside).parquet(*paths).withColumn("bucket", F.lit(None).cast("int"))


def newest_snapshot(spark: SparkSession, target: str) -> DataFrame:
    """The rows that the last finished micro-batch of ``stream_newest`` has left."""
    last = _versions(spark, target, "index")[-1]
    schema = StructType.fromJson(json.loads(spark.read.schema(_INDEX).parquet(_version(target, last, "index")).first()["schema"]))
    return _bucket_rows(spark, target, _index(spark, target, last), schema).drop("bucket")


def stream_dedup_daily(results: DataFrame, delay: str = "1 day") -> DataFrame:
    """First arrival per dataset, rule and day.

    The day itself carries the watermark and is part of the key, so the state of a day is
    dropped once the watermark passes it. Which of several rows arrives first is not fixed.
    """
    return (
        results.withColumn("day", F.date_trunc("day", EVENT_TIME))
        .withWatermark("day", delay)
        .dropDuplicates(["dataset_id", "rule_id", "day"])
    )
