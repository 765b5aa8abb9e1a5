"""Corpus pipeline: language, repeated lines, near duplicates, benchmark passages, mixture.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
The first four return the columns of documents; the last one returns the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stewardspark.llm import decontamination, jaccard_join, language, line_dedup, mixing
from stewardspark.session import drop_folder, scratch_path
from stewardspark.sources.driver_tables import read_driver


def recognised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; the model learns from these documents."""
    return language.accepted(docs)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, later repeated runs of lines cut from their text."""
    return line_dedup.without_later_runs(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return jaccard_join.one_per_class(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontamination.decontaminate(docs, read_driver(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Which document stands where in the training mixture."""
    return mixing.mix(docs)


STAGES = [
    ("language", recognised),
    ("line_dedup", distinct_lines),
    ("jaccard_join", one_of_each),
    ("decontamination", uncontaminated),
    ("mixing", mixture),
]

# The first stage is a trained classifier, which SQL cannot express; the tests follow the
# stages with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of the documents table; every stage is written and read back.

    A stage's copy goes as soon as the next one is written. The mixture is planned from token
    counts that its stage stores, so the last copy goes as well.
    """
    docs, before = read_driver(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        kept = stage(spark, docs, sf_dir)
        kept.write.parquet(path)
        docs = spark.read.schema(kept.schema).parquet(path)
        if before:
            drop_folder(spark, before)
        before = path
    result = STAGES[-1][1](spark, docs, sf_dir)
    drop_folder(spark, before)
    return result
