"""A folder of tables in between, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_folder, scratch_path
from .rows import write_table


class Work:
    """Tables that one operator writes and reads again; they go when its result is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.count = spark, label, 0
        self.folder = scratch_path(spark, label)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        return write_table(df, f"{self.folder}/{self.count}", compression="zstd")

    def end(self, result: DataFrame) -> DataFrame:
        """The result as a table of its own; the folder is removed."""
        kept = write_table(result, scratch_path(self.spark, f"{self.label}-result"), compression="zstd")
        drop_folder(self.spark, self.folder)
        return kept
