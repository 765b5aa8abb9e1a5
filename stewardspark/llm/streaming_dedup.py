"""Exact deduplication as a stream with disk-backed keyed state that never expires.

The state holds, per digest of the normalised text, the stable identifier (smallest document
id), the content locator of that document (file and row) and the number of documents seen.
A digest with more than one document is a hit: its full texts are then compared with the
text at the locator. Where all are the same, the state's answer stands; only the documents of
a digest that different texts share are grouped anew, by their full texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .rows import column

# A run of white space that is not a single space already.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    # Without it every state partition reserves megabytes for its log.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def _digest(norm: Column, digits: int) -> Column:
    return F.left(F.sha2(norm, 256), F.lit(digits))


def stream_state(
    stream: DataFrame, target: str, progress: str, doc_id: str = "doc_id", text: str = "text",
    digits: int = 64,
) -> None:
    """Runs the stream over all input at hand; every micro-batch appends its changed keys.

    Restarting with the same ``progress`` folder goes on from the saved state. A repeated
    micro-batch rewrites its own folder.
    """
    spark = stream.sparkSession
    seen = stream.select(
        _digest(normalised(column(text)), digits).alias("digest"),
        F.struct(
            column(doc_id).isNull().alias("unnamed"), column(doc_id).alias("doc_id"),
            F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"),
        ).alias("first"),
    )
    keyed = seen.groupBy("digest").agg(F.min("first").alias("first"), F.count("*").alias("n"))

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    before = {k: spark.conf.get(k, None) for k in STATE_SETTINGS}
    for key, value in STATE_SETTINGS.items():
        spark.conf.set(key, value)
    try:
        (
            keyed.writeStream.foreachBatch(save)
            .outputMode("update")
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def current_state(spark: SparkSession, target: str, like: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The newest saved entry per digest: ``digest``, ``keep_id``, ``locator``, ``n``."""
    kind = like.schema[doc_id].dataType.simpleString()
    schema = (
        f"digest string, first struct<unnamed: boolean, doc_id: {kind}, file: string, at: bigint>,"
        " n bigint, batch bigint"
    )
    saved = spark.read.schema(schema).parquet(target)
    newest = saved.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("e"))
    return newest.select(
        "digest",
        F.col("e.first.doc_id").alias("keep_id"),
        F.struct("e.first.file", "e.first.at").alias("locator"),
        F.col("e.n").alias("n"),
    )


def deduplicate(
    docs: DataFrame, state: DataFrame, doc_id: str = "doc_id", text: str = "text", digits: int = 64
) -> DataFrame:
    """One row per document with the id that stays, from the state and the files it was made of.

    Null text counts as empty. Without any id in a group ``keep_id`` is null. Exactly one row of
    a group is ``kept``: the one at the locator, the first by id (null last), file and row.
    ``docs`` reads the files of the stream, so that its rows have locators. Texts are compared
    whole, however long; equal ones meet as one row per task.
    """
    norm = normalised(column(text))
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    rows = docs.select(column(doc_id).alias("doc_id"), norm.alias("norm"), place.alias("locator")).withColumn(
        "text_sha256", F.sha2("norm", 256)
    ).withColumn("digest", F.left("text_sha256", F.lit(digits)))
    spark = docs.sparkSession
    path = scratch_path(spark, "checked")
    hits = rows.withColumnRenamed("locator", "own").join(state.where("n > 1").select("digest", "locator"), "digest")
    texts = hits.groupBy("digest", "norm").agg(F.bool_or(F.col("own") == F.col("locator")).alias("located"))
    differing = texts.groupBy("digest").agg(F.count("*").alias("texts"), F.bool_or("located").alias("found"))
    differing.where("texts > 1 OR NOT found").select("digest").write.parquet(path)
    clashing = spark.read.schema("digest string").parquet(path)
    answers = state.select("digest", "keep_id", F.col("n").alias("group_size"), F.col("locator").alias("kept_at"))
    plain = rows.select("doc_id", "locator", "digest", "text_sha256")
    if clashing.isEmpty():
        joined = plain.join(answers, "digest")
    else:
        apart = rows.join(clashing, "digest", "left_semi")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "locator"))
        by_content = apart.groupBy("digest", "norm").agg(first.alias("first"), F.count("*").alias("group_size"))
        anew = by_content.select(
            "digest", "norm", F.col("first.doc_id").alias("keep_id"), "group_size", F.col("first.locator").alias("kept_at")
        )
        joined = plain.join(answers.join(clashing, "digest", "left_anti"), "digest").unionByName(
            apart.join(anew, ["digest", "norm"]).drop("norm")
        )
    return joined.select(
        "doc_id", "keep_id", "group_size", (F.col("locator") == F.col("kept_at")).alias("kept"), "text_sha256",
    )
