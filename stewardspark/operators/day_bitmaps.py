"""Exact distinct counts over many days from mergeable bitmaps.

A distinct count cannot be added up over days, a bitmap can: each value has a number of its own,
and a day holds the bits of the values it saw. A count over any days is the count of bits in
the union of their bitmaps, so no log is read again. Numbers are given densely, batch by batch,
so that a bitmap of 32,768 bits holds as many values; a day has one row per bitmap that it
touches. A batch that is taken twice replaces its own bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_folder, folder_names, scratch_path

_IDS = "value string, id bigint"
_BITS = "bucket bigint, bits binary, metric_date date, batch string"


def known_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(value, id): the number of every value seen so far, from 1 without gaps."""
    if not folder_names(spark, f"{folder}/ids"):
        return spark.createDataFrame([], _IDS)
    return spark.read.schema(_IDS).parquet(f"{folder}/ids")


def register(folder: str, values: DataFrame) -> DataFrame:
    """Gives numbers to the values (``value``) that have none yet; returns all numbers.

    New values are numbered inside their partition, and partitions one after another by their
    counts, so no task ranks all of them.
    """
    spark = values.sparkSession
    known = known_ids(spark, folder)
    new = values.where("value IS NOT NULL").select("value").distinct().join(known, "value", "left_anti")
    staged = scratch_path(spark, "new-values")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("value")) - 1
    new.withColumn("part", F.spark_partition_id()).withColumn("n", inside).write.parquet(staged)
    rows = spark.read.schema("value string, part int, n int").parquet(staged)
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    top = known.agg(F.max("id")).first()[0]
    numbered = rows.join(starts, "part").select(
        "value", (F.lit(1 if top is None else top + 1) + F.col("start") + F.col("n")).cast("bigint").alias("id")
    )
    if not rows.isEmpty():
        numbered.write.mode("append").parquet(f"{folder}/ids")
    drop_folder(spark, staged)
    return known_ids(spark, folder)


def _bitmaps(rows: DataFrame, *groups: str) -> DataFrame:
    """Bitmaps of the ``id`` column per group: rows (groups, bucket, bits)."""
    bucket = F.bitmap_bucket_number("id").alias("bucket")
    return rows.groupBy(*groups, bucket).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits"))


def take(folder: str, batch: str, rows: DataFrame) -> None:
    """Takes in a batch of rows (``metric_date``, ``value``); rows without either count nowhere."""
    seen = rows.where("metric_date IS NOT NULL AND value IS NOT NULL").select("metric_date", "value").distinct()
    ids = register(folder, seen)
    made = _bitmaps(seen.join(ids, "value"), "metric_date").withColumn("batch", F.lit(batch))
    (
        made.hint("rebalance", "metric_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("metric_date", "batch").parquet(f"{folder}/bitmaps")
    )


def by_day(spark: SparkSession, folder: str) -> DataFrame:
    """(metric_date, bucket, bits) of all batches together."""
    stored = spark.read.schema(_BITS).parquet(f"{folder}/bitmaps")
    return stored.groupBy("metric_date", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def rolling_distinct(spark: SparkSession, folder: str, days: int) -> DataFrame:
    """(metric_date, distinct_values): per day with rows, the values seen in the ``days`` up to it.

    Each bitmap is sent to the windows that hold its day: rows of bitmaps, not of the log.
    """
    daily = by_day(spark, folder)
    present = daily.select("metric_date").distinct()
    sent = daily.withColumn("back", F.explode(F.sequence(F.lit(0), F.lit(days - 1)))).select(
        F.date_add("metric_date", F.col("back")).alias("metric_date"), "bucket", "bits"
    )
    union = sent.join(present, "metric_date", "left_semi").groupBy("metric_date", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return union.groupBy("metric_date").agg(F.sum(F.bitmap_count("bits")).cast("bigint").alias("distinct_values"))


def distinct_by_group(
    spark: SparkSession, folder: str, members: DataFrame, group: str, first, last
) -> DataFrame:
    """(group, distinct_values): members (``group``, ``value``) of each group seen from ``first`` to ``last``.

    What two bitmaps share is the sum of their counts less the count of their union. Groups
    without any member seen have no row.
    """
    stored = spark.read.schema(_BITS).parquet(f"{folder}/bitmaps")
    seen = stored.where(F.col("metric_date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    seen = seen.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    own = _bitmaps(members.select(group, "value").distinct().join(known_ids(spark, folder), "value"), group)
    pairs = own.join(seen.withColumnRenamed("bits", "seen"), "bucket")
    # Both bitmaps of a pair as rows: their union is an aggregate, the sum of their counts too.
    both = pairs.select(group, "bucket", F.explode(F.array("bits", "seen")).alias("one"))
    shared = both.groupBy(group, "bucket").agg(
        F.sum(F.bitmap_count("one")).alias("sum"), F.bitmap_count(F.bitmap_or_agg("one")).alias("n")
    )
    return (
        shared.groupBy(group).agg(F.sum(F.col("sum") - F.col("n")).cast("bigint").alias("distinct_values"))
        .where("distinct_values > 0")
    )
