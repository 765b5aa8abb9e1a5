"""Reading and writing governance tables as Parquet.

A table is never overwritten while a plan reads it: each new snapshot is a table of its
own, and a view of the plain name is switched to it once it is complete.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from .tables import schema


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """A registry or log table under ``root`` with its declared schema, no inference."""
    return spark.read.schema(schema(table)).parquet(f"{root}/{table}")


def append(df: DataFrame, root: str, table: str) -> None:
    """Insert sink: appends rows, with the columns of the declared schema."""
    wanted = schema(table)
    missing = {f.name: f.dataType for f in wanted.fields if f.name not in df.columns}
    columns = [
        f"CAST(NULL AS {missing[f.name].simpleString()}) AS {f.name}"
        if f.name in missing
        else f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}"
        for f in wanted.fields
    ]
    df.selectExpr(*columns).write.mode("append").parquet(f"{root}/{table}")


def publish_snapshot(
    df: DataFrame, table: str, version: str, folder: str | None = None
) -> DataFrame:
    """Writes the next snapshot of ``table`` and switches the view of that name to it.

    Files go to ``folder``, or to the session's warehouse, which then has to be shared.
    """
    spark = df.sparkSession
    stored = f"{table}__{version}"
    writer = df.write.mode("errorifexists").format("parquet")
    if folder:
        writer = writer.option("path", f"{folder}/{stored}")
    writer.saveAsTable(stored)
    spark.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM {stored}")
    return spark.table(table)


def write_daily(
    df: DataFrame, path: str, day: str = "metric_date", sort: Sequence[str] = ("domain_name",)
) -> None:
    """Materialises a daily model: one folder per day, rows sorted inside the files.

    A rewrite replaces only the days it holds. Rows are gathered by day, and a day too large
    for one task is split into several files at run time.
    """
    (
        df.hint("rebalance", day)
        .sortWithinPartitions(day, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(day)
        .parquet(path)
    )
