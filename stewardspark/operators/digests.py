"""Reconciliation of two tables by a tree of digests.

Rows are dealt into ranges by a hash of their key; a range has an order-free digest, the count
of its rows and sums of their hashes. Digests are summed on the map side, so a table sends one
small row per range and task. Only ranges whose digests differ are cut into finer ones, and
only the rows of finer ranges that differ are moved and joined. Two tables that are nearly
alike thus cost scans instead of shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import percent
from .quality import DEFAULT_THRESHOLD, DEFAULT_WARN_MARGIN, accuracy_vs_source, outcome

# Ranges of the first level, and of each of them in the second.
RANGES = 1024
LEAVES = 1024

_SUMS = ("c", "a", "b", "x", "y")


def _prepared(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The columns with the row's range, leaf and hashes.

    A hash passes NULLs by, so which columns are NULL is hashed as well.
    """
    key = [F.col(k) for k in keys]
    nulls = F.concat(*[F.col(c).isNull().cast("string") for c in (*keys, *columns)])
    everything = [*key, *[F.col(c) for c in columns], nulls]
    return df.select(
        *keys, *columns,
        F.pmod(F.xxhash64(*key, F.lit("range")), F.lit(RANGES)).cast("int").alias("_range"),
        F.pmod(F.xxhash64(*key, F.lit("leaf")), F.lit(LEAVES)).cast("int").alias("_leaf"),
        F.xxhash64(*everything).alias("_h"), F.xxhash64(*everything, F.lit("again")).alias("_g"),
    )


def _digests(rows: DataFrame, level: Sequence[str], side: str) -> DataFrame:
    """Count and sums of the halves of two hashes per range; sums of halves do not overflow."""
    half = F.lit(0xFFFFFFFF)
    return rows.groupBy(*level).agg(
        F.count(F.lit(1)).alias(f"{side}_c"),
        F.sum(F.col("_h").bitwiseAND(half)).alias(f"{side}_a"), F.sum(F.shiftrightunsigned("_h", 32)).alias(f"{side}_b"),
        F.sum(F.col("_g").bitwiseAND(half)).alias(f"{side}_x"), F.sum(F.shiftrightunsigned("_g", 32)).alias(f"{side}_y"),
    )


def _compared(a: DataFrame, b: DataFrame, level: Sequence[str]) -> DataFrame:
    """(level, rows, equal): every range of either side."""
    both = _digests(a, level, "l").join(_digests(b, level, "r"), list(level), "full")
    equal = reduce(lambda x, y: x & y, [F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in _SUMS])
    return both.select(*level, F.coalesce("l_c", F.lit(0)).alias("rows"), equal.alias("equal"))


def _whole(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def differing(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> tuple[DataFrame, DataFrame, int]:
    """The rows of either side that may differ, and the number of rows that surely agree.

    Both sides have ``keys`` and ``columns`` of the same types. The ranges that differ come
    to the driver, at most ``RANGES`` numbers, so that rows of equal ranges are dropped by a
    filter before any exchange. Rows with a NULL in the key agree with nothing.
    """
    a, b = (_prepared(df.where(_whole(keys)), keys, columns) for df in (left, right))
    top = _compared(a, b, ["_range"]).collect()
    agreed = sum(r["rows"] for r in top if r["equal"])
    open_ranges = sorted(r["_range"] for r in top if not r["equal"])
    a, b = (df.where(F.col("_range").isin(open_ranges)) if open_ranges else df.where(F.lit(False)) for df in (a, b))
    level = ["_range", "_leaf"]
    if open_ranges:
        leaves = _compared(a, b, level)
        agreed += leaves.agg(F.sum(F.when(F.col("equal"), F.col("rows")))).first()[0] or 0
        unequal = leaves.where(~F.col("equal")).select(*level)
        a, b = (df.join(unequal, level, "left_semi") for df in (a, b))
    out = [
        kept.select(*keys, *columns).unionByName(df.where(~_whole(keys)).select(*keys, *columns))
        for kept, df in ((a, left), (b, right))
    ]
    return out[0], out[1], int(agreed)


def changed_rows(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keys, one row each on either side, whose rows are not the same: the key and ``change``.

    ``MISSING_LEFT``, ``MISSING_RIGHT`` or ``DIFFERENT``; NULL values are equal to each other.
    """
    a, b, _ = differing(left, right, keys, columns)
    x = a.select(*keys, F.struct(*columns).alias("_l"), F.lit(True).alias("_in_l"))
    y = b.select(*keys, F.struct(*columns).alias("_r"), F.lit(True).alias("_in_r"))
    change = (
        F.when(F.col("_in_l").isNull(), "MISSING_LEFT").when(F.col("_in_r").isNull(), "MISSING_RIGHT")
        .when(~F.col("_l").eqNullSafe(F.col("_r")), "DIFFERENT")
    )
    return x.join(y, list(keys), "full").select(*keys, change.alias("change")).where("change IS NOT NULL")


def accuracy_by_digests(
    actual: DataFrame, source: DataFrame, keys: Sequence[str], col: str, tol_abs: float = 0.0, tol_pct: float = 0.0,
    threshold=DEFAULT_THRESHOLD, warn_margin: float = DEFAULT_WARN_MARGIN,
) -> DataFrame:
    """The row of ``accuracy_vs_source``; only ranges that are not the same are joined."""
    kind = dict(actual.dtypes)[col]
    if dict(source.dtypes)[col] != kind:
        kind = "double"
    a, b = (df.select(*keys, F.col(col).cast(kind).alias(col)) for df in (actual, source))
    x, y, agreed = differing(a, b, keys, [col])
    counted = accuracy_vs_source(x, y, keys, col, tol_abs, tol_pct, threshold, warn_margin)
    failed = F.col("mismatched") + F.col("missing_in_source") + F.col("missing_in_actual")
    total = counted.withColumns({"row_count": F.col("row_count") + agreed, "compared": F.col("compared") + agreed})
    return total.withColumn("rate", percent(F.col("row_count") - failed, "row_count")).withColumn(
        "outcome", outcome("rate", threshold, warn_margin)
    )
