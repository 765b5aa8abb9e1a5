"""Shared building blocks: newest row per key, side-by-side counts, split running windows.

Join policy of the package: registry sides are left to Spark, which broadcasts them when
their size is below its threshold (checked from the statistics, and again at run time from
the shuffled size) and otherwise sorts and merges, splitting hot partitions of the row
side. No broadcast is forced. Wherever only totals are needed, the fact side is first
counted per join key, so a hot key is one row before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in ``order``, which has to be total for a repeatable result.

    Spark cuts each map partition to one row per key before the shuffle (the row limit
    moves below the window), so a hot key sends one row per map task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def counts_side_by_side(counts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with one count column per named frame; empty frames count zero."""
    rows = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in counts.items()]
    return union_all(rows, allow_missing=True).agg(*[F.max(n).alias(n) for n in counts])


_NO_KEY = "\u0000"


def _group_keys(keys: Sequence[str]) -> dict[str, Column]:
    """Key columns that are never NULL, so that window and join share one partitioning."""
    return {
        f"_k{i}": F.coalesce(F.col(k).cast("string"), F.lit(_NO_KEY)) for i, k in enumerate(keys)
    }


def _bucketed(
    df: DataFrame, group: Sequence[str], at: str, bucket: str, split_rows: int | None, finer: str
) -> DataFrame:
    """Adds the time bucket of each row.

    With ``split_rows``, a (key, bucket) of more rows is cut at the ``finer`` unit: rows are
    counted per (key, bucket) with partial counts, and the few full ones are joined back; that
    join is split by Spark where it is skewed. A bucket is cut for all its rows or for none,
    so buckets stay in time order.
    """
    plain = df.withColumn("_bucket", F.date_trunc(bucket, at))
    if split_rows is None:
        return plain
    full = (
        plain.groupBy(*group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > split_rows)
        .select(*group, "_bucket", F.lit(True).alias("_full"))
    )
    cut = F.when(F.col("_full"), F.date_trunc(finer, at)).otherwise(F.col("_bucket"))
    return plain.join(full, [*group, "_bucket"], "left").withColumn("_bucket", cut).drop("_full")


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    at: str,
    value: Column,
    out: str,
    bucket: str = "day",
    include_current: bool = False,
    split_rows: int | None = None,
    finer: str = "minute",
) -> DataFrame:
    """Running maximum of ``value`` per key in ``order``, split by time.

    The window runs inside (key, time bucket); the maximum of all earlier buckets comes
    from a second window over one row per (key, bucket). A key that holds most rows is
    thus spread over its buckets instead of filling one task. ``at`` leads ``order`` and
    rows without it are left out; callers that keep such rows give them a time first. The
    join of the two keeps the window's partitioning. ``split_rows`` cuts full buckets finer.
    """
    group = _group_keys(keys)
    keyed = _bucketed(
        df.where(F.col(at).isNotNull()).withColumns(group).withColumn("_value", value),
        list(group), at, bucket, split_rows, finer,
    )
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if include_current else -1)
    )
    earlier = (
        Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        keyed.groupBy(*group, "_bucket")
        .agg(F.max("_value").alias("_top"))
        .withColumn("_carry", F.max("_top").over(earlier))
        .drop("_top")
    )
    rows = keyed.withColumn("_inside", F.max("_value").over(inside))
    return (
        rows.join(carry, [*group, "_bucket"], "left")
        .withColumn(out, F.greatest("_inside", "_carry"))
        .select(*df.columns, out)
    )


def _hot_buckets(
    df: DataFrame, keys: Sequence[str], at: str, bucket: str, split_rows: int, finer: str
) -> DataFrame:
    """Adds the time bucket of each row whose key has more than ``split_rows`` rows, NULL to others.

    Rows are counted per key with partial counts. At most one key in ``split_rows`` rows is hot,
    so the hot keys, and then their full buckets, are a list that every task can hold: the rows
    are marked where they lie instead of being shuffled for it.
    """

    def over(rows: DataFrame, by: Sequence[str], mark: str) -> DataFrame:
        many = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > split_rows)
        return F.broadcast(many.select(*by, F.lit(True).alias(mark)))

    hot = over(df, keys, "_hot")
    plain = df.join(hot, list(keys), "left").withColumn(
        "_bucket", F.when(F.col("_hot"), F.date_trunc(bucket, at))
    ).drop("_hot")
    full = over(plain.where("_bucket IS NOT NULL"), [*keys, "_bucket"], "_full")
    cut = F.when(F.col("_full"), F.date_trunc(finer, at)).otherwise(F.col("_bucket"))
    return plain.join(full, [*keys, "_bucket"], "left").withColumn("_bucket", cut).drop("_full")


def last_known(
    facts: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    payload: Sequence[str],
    bucket: str = "day",
    split_rows: int | None = None,
    finer: str = "minute",
) -> DataFrame:
    """As-of join: each fact with the payload of the newest history row not after it.

    Facts and history are merged in time order inside (key, time bucket); the newest row
    of earlier buckets is carried in from one row per (key, bucket). No pairs are built
    and a hot key is split by time. Equal starts resolve to the greatest payload; a NULL
    key or time finds nothing, and such facts are passed around the shuffle. With
    ``split_rows`` only keys of more rows than that are cut into buckets, full buckets again at
    the ``finer`` unit, at the price of a count; all other keys are one bucket and need no carry.
    """
    group = [f"_k{i}" for i in range(len(keys))]
    types = dict(history.dtypes)
    whole = F.col(at).isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    apart = facts.where(~whole).select(
        *facts.columns, *[F.lit(None).cast(types[c]).alias(c) for c in payload]
    )
    facts = facts.where(whole)
    known = history.where(F.col(start).isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    # What a fact has anyhow is not moved twice: a text key and its time are read from the merged row.
    own = {k: g for k, g in zip(keys, group) if dict(facts.dtypes)[k] == types[k] == "string"}
    timed = dict(facts.dtypes)[at] == types[start]
    left = facts.withColumnsRenamed(own | ({at: "_at"} if timed else {}))
    left = left.withColumns(
        {g: F.col(k).cast("string") for k, g in zip(keys, group) if k not in own}
        | ({} if timed else {"_at": F.col(at)})
    )
    known = known.select(
        *[F.col(k).cast("string").alias(g) for k, g in zip(keys, group)],
        F.col(start).alias("_at"),
        F.struct(*payload).alias("_payload"),
    )
    merged = left.unionByName(known, allowMissingColumns=True)
    if split_rows is None:
        merged = merged.withColumn("_bucket", F.date_trunc(bucket, "_at"))
    else:
        merged = _hot_buckets(merged, group, "_at", bucket, split_rows, finer)
    is_fact = F.col("_payload").isNull()
    inside = (
        Window.partitionBy(*group, "_bucket")
        .orderBy("_at", is_fact, "_payload")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # A NULL bucket is a whole key: it finds no carry below, and needs none.
    cut = merged.where("_bucket IS NOT NULL")
    # Facts only say which buckets they need; a fact bucket sorts before its own history.
    needed = cut.where(is_fact).select(*group, "_bucket").distinct()
    newest_of_bucket = F.max(F.struct("_at", "_payload"))
    known_buckets = (
        cut.where(~is_fact).groupBy(*group, "_bucket").agg(newest_of_bucket.alias("_top"))
    )
    earlier = (
        Window.partitionBy(*group)
        .orderBy("_bucket", F.col("_top").isNotNull())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = (
        needed.unionByName(known_buckets, allowMissingColumns=True)
        .withColumn("_carry", F.last("_top", ignorenulls=True).over(earlier))
        .where("_top IS NULL")
        .select(*group, "_bucket", F.col("_carry._payload").alias("_carry"))
    )
    rows = merged.withColumn(
        "_inside", F.last("_payload", ignorenulls=True).over(inside)
    ).where(is_fact)
    found = rows.join(carry, [*group, "_bucket"], "left").withColumn(
        "_known", F.coalesce("_inside", "_carry")
    )
    names = own | ({at: "_at"} if timed else {})
    placed = found.select(
        *[F.col(names.get(c, c)).alias(c) for c in facts.columns],
        *[F.col(f"_known.{c}").alias(c) for c in payload],
    )
    return placed.unionByName(apart)
