"""Snapshot DML: old snapshot and changes in, new snapshot out.

One rule holds for repeated source keys, whatever the plan: several source rows for a target
row that is to be updated are an error; source rows without a target row are all inserted;
a merge that updates nothing never fails.

Parquet has no row-level MERGE, so each function builds the next snapshot as a plan.
Updates left-join the target to the changes: a small change set is broadcast and the
target is not shuffled. Inserts anti-join the changes to the target's *matched* keys,
found by a semi join on the key columns alone, so the target is never the build side.
A source as large as the target takes one full outer join instead.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import AsOf, moment, to_datetime

KeyExpr = Callable[[Column], Column]
CLASH = "more than one source row for a merge key"


def _key_names(keys: Sequence[str]) -> list[str]:
    return [f"_key_{i}" for i in range(len(keys))]


def _with_keys(df: DataFrame, keys: Sequence[str], key_expr: KeyExpr | None) -> DataFrame:
    expr = key_expr or (lambda c: c)
    return df.withColumns({n: expr(F.col(k)) for n, k in zip(_key_names(keys), keys)})


def unmatched(
    source: DataFrame, target: DataFrame, keys: Sequence[str], key_expr: KeyExpr | None = None
) -> DataFrame:
    """Source rows without a target row of equal keys; a NULL key never matches."""
    names = _key_names(keys)
    src = _with_keys(source, keys, key_expr)
    tgt = _with_keys(target.select(*keys), keys, key_expr).select(*names)
    present = tgt.join(src.select(*names), names, "left_semi").distinct()
    return src.join(present, names, "left_anti").select(*source.columns)


def update_from(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    key_expr: KeyExpr | None = None,
) -> DataFrame:
    """Target with ``columns`` replaced where a source row has equal keys.

    Two source rows for one matched target row are an error, raised while the plan runs,
    also when no updated column is read.
    """
    names = _key_names(keys)
    src = _with_keys(source, keys, key_expr)
    for n in names:
        src = src.where(F.col(n).isNotNull())
    changes = src.groupBy(*names).agg(
        F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*columns)).alias("_new")
    )
    joined = _with_keys(target, keys, key_expr).join(changes, names, "left")
    types = dict(target.dtypes)

    def value(c: str) -> Column:
        if c not in columns:
            return F.col(c)
        new = F.col(f"_new.{c}").cast(types[c])
        return F.when(F.col("_n") == 1, new).otherwise(F.col(c)).alias(c)

    return _guarded(joined, F.col("_n") > 1).select(*[value(c) for c in target.columns])


def _guarded(df: DataFrame, clash: Column) -> DataFrame:
    """Fails on a row with ``clash``; as a filter it survives column pruning."""
    error = F.raise_error(F.lit(CLASH)).cast("boolean")
    return df.where(F.when(clash, error).otherwise(F.lit(True)))


def _full_merge(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    updates: Sequence[str],
    inserts: Sequence[str],
    key_expr: KeyExpr | None,
) -> DataFrame:
    """The merge as one full outer join on the keys; each side moves once.

    Rows without a full key match nothing: they are passed by the join, so that they do
    not gather in one task. The source is counted per key, so the join sees a repeated key
    once; the rows of repeated keys without a target row are added from the source itself.
    """
    names = _key_names(keys)
    types = dict(target.dtypes)
    tgt, src = (_with_keys(df, keys, key_expr) for df in (target, source))
    whole = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    changes = (
        src.where(whole)
        .groupBy(*names)
        .agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*source.columns)).alias("_new"))
    )
    joined = tgt.where(whole).withColumn("_known", F.lit(True)).join(changes, names, "full")

    def inserted(c: str, value: Column) -> Column:
        return (value if c in inserts else F.lit(None)).cast(types[c])

    def merged(c: str) -> Column:
        given = F.col(f"_new.{c}") if c in source.columns else F.lit(None)
        out = F.when(F.col("_known").isNull(), inserted(c, given))
        if c in updates:
            out = out.when(F.col("_n") == 1, given.cast(types[c]))
        return out.otherwise(F.col(c)).alias(c)

    def shaped(rows: DataFrame) -> DataFrame:
        return rows.select(
            *[
                inserted(c, F.col(c) if c in source.columns else F.lit(None)).alias(c)
                for c in target.columns
            ]
        )

    known = F.col("_known").isNotNull()
    if updates:
        joined = _guarded(joined, known & (F.col("_n") > 1))
    repeated = src.where(whole).join(changes.where("_n > 1").select(*names), names, "left_semi")
    return (
        joined.where(known | (F.col("_n") == 1))
        .select(*[merged(c) for c in target.columns])
        .unionByName(tgt.where(~whole).select(*target.columns))
        .unionByName(shaped(src.where(~whole)))
        .unionByName(shaped(unmatched(repeated.select(*source.columns), target, keys, key_expr)))
    )


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    update_cols: Sequence[str] | None = None,
    insert_cols: Sequence[str] | None = None,
    key_expr: KeyExpr | None = None,
    large_source: bool = False,
) -> DataFrame:
    """MERGE: matched rows take ``update_cols``, other source rows are inserted.

    ``update_cols=[]`` only inserts and leaves every target row as it is. Columns outside
    ``insert_cols`` are NULL in inserted rows. ``key_expr`` (say ``F.upper``) is applied to
    both sides before keys are compared. ``large_source`` tells that the source is about
    as big as the target: then one full outer join is cheaper than sparing the target; it
    changes the plan only. The source plan is read up to three times, so store a costly one
    first.
    """
    known = [c for c in source.columns if c in target.columns]
    updates = [c for c in known if c not in keys] if update_cols is None else list(update_cols)
    inserts = known if insert_cols is None else list(insert_cols)
    if large_source:
        return _full_merge(target, source, keys, updates, inserts, key_expr)
    kept = update_from(target, source, keys, updates, key_expr) if updates else target
    new = unmatched(source, target, keys, key_expr)
    types = dict(target.dtypes)
    shaped = new.select(
        *[
            (F.col(c) if c in inserts else F.lit(None)).cast(types[c]).alias(c)
            for c in target.columns
        ]
    )
    return kept.unionByName(shaped)


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str], day_col: str
) -> DataFrame:
    """Appends source rows whose keys have no target row on the same day.

    Duplicates inside the source batch are all appended.
    """
    day = F.to_date(day_col)
    fresh = unmatched(
        source.withColumn("_day", day), target.withColumn("_day", day), [*keys, "_day"]
    )
    return target.unionByName(fresh.drop("_day"))


def update_where(
    df: DataFrame, predicate: Column, assignments: Mapping[str, Column]
) -> DataFrame:
    """Conditional UPDATE; all assignments read the old row."""
    types = dict(df.dtypes)
    return df.withColumns(
        {
            c: F.when(predicate, v.cast(types[c])).otherwise(F.col(c))
            for c, v in assignments.items()
        }
    )


def purge_older_than(df: DataFrame, ts: str, days: int, as_of: AsOf) -> DataFrame:
    """Retention delete: drops rows older than ``days``; rows without a time stay."""
    limit = moment(to_datetime(as_of) - dt.timedelta(days=days))
    return df.where((F.col(ts) >= limit) | F.col(ts).isNull())


def check_merge_source(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once in a merge source, with their count."""
    keyed = source
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    return keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


# The row that a maintenance pass leaves in the telemetry log.
MAINTENANCE_ROW = {
    "user_name": "SYSTEM",
    "role_name": "GOVERNANCE_ADMIN",
    "page_name": "MAINTENANCE",
    "action": "DAILY_CLEANUP",
}


def maintenance(
    datasets: DataFrame, telemetry: DataFrame, as_of: AsOf, ts: str = "ts", keep_days: int = 90
) -> tuple[DataFrame, DataFrame]:
    """Daily pass: touch stale datasets, purge old telemetry, log the pass itself.

    Every dataset older than a day is touched, so filters on "touched today" take all of
    them the next day; that is how the pass is defined.
    """
    stale = F.col("updated_at") < moment(to_datetime(as_of) - dt.timedelta(days=1))
    touched = update_where(datasets, stale, {"updated_at": moment(as_of)})
    row = telemetry.sparkSession.range(1).select(
        F.sha2(F.lit(f"maintenance {to_datetime(as_of).isoformat()}"), 256).alias("session_id"),
        *[F.lit(v).alias(k) for k, v in MAINTENANCE_ROW.items()],
        moment(as_of).alias(ts),
    )
    kept = purge_older_than(telemetry, ts, keep_days, as_of)
    return touched, kept.unionByName(row, allowMissingColumns=True)
