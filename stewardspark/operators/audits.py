"""Audits of declared constraints: primary keys, foreign keys, NOT NULL, vocabularies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ratios import count_where, zero_if_null
from .common import union_all


class KeySpec(NamedTuple):
    table: str
    df: DataFrame
    columns: Sequence[str]


class ReferenceSpec(NamedTuple):
    child: str
    child_df: DataFrame
    child_columns: Sequence[str]
    parent: str
    parent_df: DataFrame
    parent_columns: Sequence[str]


class VocabularySpec(NamedTuple):
    table: str
    df: DataFrame
    column: str
    allowed: Sequence[str]


def _as_key(columns: Sequence[str]) -> Column:
    """A key as one string, so that keys of many tables share a shuffle; NULL if a part is."""
    parts = [F.col(c).cast("string") for c in columns]
    if len(parts) == 1:
        return parts[0]
    whole = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    return F.when(whole, F.to_json(F.array(*parts)))


def _sum_where(predicate: Column, value: Column) -> Column:
    return F.sum(F.when(predicate, value).otherwise(0))


def audit_primary_keys(specs: Sequence[KeySpec]) -> DataFrame:
    """Rows, rows with a NULL key part, repeated keys and surplus rows per key.

    All tables are counted by (table, key) in one aggregation: one scan per table, partial
    counts on the map side and a single shuffle, however many tables there are.
    """
    keyed = union_all(
        [
            s.df.select(F.lit(i).alias("item"), _as_key(s.columns).alias("key"))
            for i, s in enumerate(specs)
        ]
    )
    n, no_key = F.col("n"), F.col("key").isNull()
    repeated = ~no_key & (n > 1)
    found = (
        keyed.groupBy("item", "key")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("item")
        .agg(
            F.sum(n).alias("row_count"),
            _sum_where(no_key, n).alias("null_key_rows"),
            count_where(repeated).alias("repeated_keys"),
            _sum_where(repeated, n - 1).alias("surplus_rows"),
        )
    )
    names = [(s.table, ",".join(s.columns)) for s in specs]
    return _named(found, names, ["table_name", "key_columns"])


def audit_foreign_keys(specs: Sequence[ReferenceSpec]) -> DataFrame:
    """Rows with a key and rows whose key has no parent, per reference.

    Child and parent rows are tagged and counted together by (parent, key): one shuffle with
    partial counts and no join, so a key that holds a third of the rows is one row per task.
    Each reference has a slot among those of its parent. A table is scanned once for all
    its references and once as a parent.
    """
    parents = list(dict.fromkeys((s.parent, tuple(s.parent_columns)) for s in specs))
    taken: dict[int, int] = {}
    places: list[tuple[int, int]] = []
    for s in specs:
        parent = parents.index((s.parent, tuple(s.parent_columns)))
        places.append((parent, taken.get(parent, 0)))
        taken[parent] = taken.get(parent, 0) + 1
    own_row = -1

    def references(child: str) -> DataFrame:
        group = [(place, s) for place, s in zip(places, specs) if s.child == child]
        entries = [
            F.struct(
                F.lit(parent).alias("parent"), F.lit(slot).alias("slot"),
                _as_key(s.child_columns).alias("key"),
            )
            for (parent, slot), s in group
        ]
        return group[0][1].child_df.select(F.inline(F.array(*entries)))

    def parent_keys(parent: int) -> DataFrame:
        spec = next(s for (p, _), s in zip(places, specs) if p == parent)
        return spec.parent_df.select(
            F.lit(parent).alias("parent"), F.lit(own_row).alias("slot"),
            _as_key(spec.parent_columns).alias("key"),
        )

    tagged = union_all(
        [references(c) for c in dict.fromkeys(s.child for s in specs)]
        + [parent_keys(i) for i in range(len(parents))]
    )
    slots = range(max(taken.values(), default=0))
    per_key = (
        tagged.where("key IS NOT NULL")
        .groupBy("parent", "key")
        .agg(
            F.max(F.col("slot") == own_row).alias("known"),
            *[count_where(F.col("slot") == i).alias(f"_{i}") for i in slots],
        )
    )
    totals = per_key.groupBy("parent").agg(
        *[F.sum(f"_{i}").alias(f"keyed_{i}") for i in slots],
        *[_sum_where(~F.col("known"), F.col(f"_{i}")).alias(f"orphan_{i}") for i in slots],
    )
    per_slot = totals.select(
        "parent",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("slot"), F.col(f"keyed_{i}").alias("keyed_rows"),
                        F.col(f"orphan_{i}").alias("orphan_rows"),
                    )
                    for i in slots
                ]
            )
        ),
    )
    item = F.lit(None).cast("int")
    for i, (parent, slot) in enumerate(places):
        here = (F.col("parent") == parent) & (F.col("slot") == slot)
        item = F.when(here, i).otherwise(item)
    found = per_slot.select(item.alias("item"), "keyed_rows", "orphan_rows")
    names = [(s.child, ",".join(s.child_columns), s.parent) for s in specs]
    return _named(found, names, ["child_table", "child_columns", "parent_table"])


def _named(found: DataFrame, names: Sequence[tuple], columns: Sequence[str]) -> DataFrame:
    """Names the numbered items; an item that had no row to count shows zeros."""
    entries = [
        F.struct(F.lit(i).alias("item"), *[F.lit(v).alias(c) for c, v in zip(columns, name)])
        for i, name in enumerate(names)
    ]
    items = found.sparkSession.range(1).select(F.inline(F.array(*entries)))
    numbers = [c for c in found.columns if c != "item"]
    return items.join(found, "item", "left").select(
        *columns, *[zero_if_null(c).alias(c) for c in numbers]
    )


def audit_not_null(specs: Sequence[KeySpec]) -> DataFrame:
    """NULL counts of columns declared NOT NULL; one scan per table."""

    def one(spec: KeySpec) -> DataFrame:
        counted = spec.df.agg(
            F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in spec.columns]
        )
        entries = [
            F.struct(
                F.lit(spec.table).alias("table_name"),
                F.lit(c).alias("column_name"),
                F.col("rows").alias("row_count"),
                (F.col("rows") - F.col(c)).alias("null_rows"),
            )
            for c in spec.columns
        ]
        return counted.select(F.inline(F.array(*entries)))

    return union_all([one(s) for s in specs])


def audit_vocabulary(specs: Sequence[VocabularySpec]) -> DataFrame:
    """Rows whose label is outside the declared vocabulary; NULL labels are not judged.

    Specs of one frame share its scan.
    """
    by_frame: dict[int, list[VocabularySpec]] = {}
    for s in specs:
        by_frame.setdefault(id(s.df), []).append(s)

    def one(group: list[VocabularySpec]) -> DataFrame:
        counted = group[0].df.agg(
            *[F.count(s.column).alias(f"_n{i}") for i, s in enumerate(group)],
            *[
                count_where(~F.col(s.column).isin(list(s.allowed))).alias(f"_x{i}")
                for i, s in enumerate(group)
            ],
        )
        entries = [
            F.struct(
                F.lit(s.table).alias("table_name"),
                F.lit(s.column).alias("column_name"),
                F.col(f"_n{i}").alias("labelled_rows"),
                F.col(f"_x{i}").alias("unknown_rows"),
            )
            for i, s in enumerate(group)
        ]
        return counted.select(F.inline(F.array(*entries)))

    return union_all([one(g) for g in by_frame.values()])


AUDITED, ABSENT = "AUDITED", "ABSENT"


def with_absent(audit: DataFrame, absent: Sequence[tuple], names: int) -> DataFrame:
    """An audit with a status, and a row without counts per constraint that cannot be read.

    ``names`` is the number of leading columns that name a constraint.
    """
    out = audit.withColumn("status", F.lit(AUDITED))
    if not absent:
        return out
    shape = audit.schema.fields
    entries = [
        F.struct(
            *[F.lit(v).alias(f.name) for v, f in zip(name, shape)],
            *[F.lit(None).cast(f.dataType).alias(f.name) for f in shape[names:]],
            F.lit(ABSENT).alias("status"),
        )
        for name in absent
    ]
    return out.unionByName(audit.sparkSession.range(1).select(F.inline(F.array(*entries))))


class Constraints(NamedTuple):
    """Specs that can be audited, and the names of those whose table or column is missing."""

    specs: list
    absent: list[tuple]


def registry_specs(tables: Mapping[str, DataFrame]) -> dict[str, Constraints]:
    """Declared constraints by audit: primary_key, foreign_key, not_null and vocabulary."""
    from ..sources import tables as declared

    def has(table: str, *columns: str) -> bool:
        return table in tables and set(columns) <= set(tables[table].columns)

    keys, refs = Constraints([], []), Constraints([], [])
    not_null, vocabulary = Constraints([], []), Constraints([], [])
    for t, cols in declared.PRIMARY_KEYS.items():
        if has(t, *cols):
            keys.specs.append(KeySpec(t, tables[t], cols))
        else:
            keys.absent.append((t, ",".join(cols)))
    for child, c, parent, p in declared.FOREIGN_KEYS:
        if has(child, c) and has(parent, p):
            refs.specs.append(ReferenceSpec(child, tables[child], [c], parent, tables[parent], [p]))
        else:
            refs.absent.append((child, c, parent))
    for t, cols in declared.NOT_NULL.items():
        present = [c for c in cols if has(t, c)]
        if present:
            not_null.specs.append(KeySpec(t, tables[t], present))
        not_null.absent.extend((t, c) for c in cols if c not in present)
    for (t, c), allowed in declared.VOCABULARIES.items():
        if has(t, c):
            vocabulary.specs.append(VocabularySpec(t, tables[t], c, allowed))
        else:
            vocabulary.absent.append((t, c))
    return {"primary_key": keys, "foreign_key": refs, "not_null": not_null, "vocabulary": vocabulary}


_SHAPES = {
    "primary_key": "table_name string, key_columns string, row_count bigint, null_key_rows bigint, "
    "repeated_keys bigint, surplus_rows bigint",
    "foreign_key": "child_table string, child_columns string, parent_table string, "
    "keyed_rows bigint, orphan_rows bigint",
    "not_null": "table_name string, column_name string, row_count bigint, null_rows bigint",
    "vocabulary": "table_name string, column_name string, labelled_rows bigint, unknown_rows bigint",
}


def audit_registry(spark: SparkSession, tables: Mapping[str, DataFrame], which: str) -> DataFrame:
    """One audit of all declared constraints, absent ones included, with a status column."""
    audit, names = {
        "primary_key": (audit_primary_keys, 2), "foreign_key": (audit_foreign_keys, 3),
        "not_null": (audit_not_null, 2), "vocabulary": (audit_vocabulary, 2),
    }[which]
    found = registry_specs(tables)[which]
    done = audit(found.specs) if found.specs else spark.createDataFrame([], _SHAPES[which])
    return with_absent(done, found.absent, names)
