"""Helpers of the text operators: whole rows through Arrow, fixed splits, bounded samples."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

FOLDS = 5


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, so that tasks import it wherever the driver runs."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, f"{top.name}/{file.relative_to(top)}")
    path = f"{scratch_path(spark, top.name)}.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    out.write(packed.getvalue())
    out.close()
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_table(df: DataFrame, path: str, **options: str) -> DataFrame:
    """Writes a table in between and reads it back; the write's shuffle files go with its end."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def held_out(doc_id: str) -> Column:
    """True for the fifth of documents that no model may learn from; False without an id."""
    key = F.crc32(column(doc_id).cast("string").cast("binary"))
    return F.coalesce(key % FOLDS == 0, F.lit(False))


def with_results(
    df: DataFrame, fn: Callable[[pa.StructArray], list[pa.Array]], fields: Sequence[T.StructField]
) -> DataFrame:
    """``row`` (the whole input row as a struct) beside the results of ``fn`` per Arrow batch.

    The input columns stay inside the struct, so they never clash with result names.
    """
    ship(df.sparkSession)
    packed = df.select(F.struct(*[column(c) for c in df.columns]).alias("row"))
    schema = T.StructType([T.StructField("row", packed.schema["row"].dataType), *fields])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            row = batch.column(0)
            yield pa.RecordBatch.from_arrays([row, *fn(row)], names=names)

    return packed.mapInArrow(run, schema)


def field(row: pa.StructArray, name: str) -> list:
    return row.field(name).to_pylist()


def bounded_sample(
    df: DataFrame, stratum: Column, size: int, columns: Sequence[Column], key: Column
) -> list:
    """At most about ``size`` rows, spread evenly over the strata and chosen by a hash of ``key``.

    Two passes: counts per stratum, then a filter by hash whose rate follows from them. The
    number of strata (languages, labels) has to be small.
    """
    tagged = df.withColumn("_stratum", stratum)
    counts = {r["_stratum"]: r["count"] for r in tagged.groupBy("_stratum").count().collect()}
    if not counts:
        return []
    share = size / len(counts)
    rate = F.lit(0.0)
    for name, n in counts.items():
        rate = F.when(F.col("_stratum").eqNullSafe(F.lit(name)), min(1.0, share / n)).otherwise(rate)
    draw = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    picked = tagged.where(draw < rate).select(*columns)
    return sorted(picked.limit(2 * size).collect(), key=lambda r: tuple(str(v) for v in r))
