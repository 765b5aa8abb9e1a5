"""Forests as intervals: who lies under whom becomes a range condition.

Every node points to one parent. Pointer jumping doubles the distance that each node sees, so
a forest of depth d takes about log2(d) rounds, each one join of the nodes with themselves.
Nodes are numbered in preorder, one tree after the other, without gaps: the descendants of a
node are the numbers from its own up to its own plus its size. Pointers that run in a circle have no root; the smallest node
of each circle is made one and marked ``cut``.

Pairs of points and intervals are found by an equi-join: an interval is cut into dyadic
blocks, two per level at most, and a point lies in one block per level. Each pair meets in
exactly one block, and no pair is built that is not part of the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_path

# Children of one parent that are numbered by one task.
SIBLINGS = 100_000
CLASH = "more than one parent for a node"


class Steps:
    """A folder of tables in between, removed when the result is written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.count = spark, label, 0
        self.folder = scratch_path(spark, label)

    def keep(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def together(self, counts: Sequence[int], schema) -> DataFrame:
        """The kept tables with these numbers as one."""
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{n}" for n in counts])

    def leave(self, counts: Sequence[int]) -> None:
        """Removes the kept tables but those with these numbers, which a lazy result reads."""
        for n in set(range(1, self.count + 1)) - set(counts):
            drop_folder(self.spark, f"{self.folder}/{n}")

    def end(self, *results: DataFrame) -> list[DataFrame]:
        """The results in a folder of their own."""
        folder = scratch_path(self.spark, f"{self.label}-result")
        out = []
        for n, df in enumerate(results):
            df.write.parquet(f"{folder}/{n}")
            out.append(self.spark.read.schema(df.schema).parquet(f"{folder}/{n}"))
        drop_folder(self.spark, self.folder)
        return out


def _cut_nodes(steps: Steps, links: DataFrame) -> DataFrame | None:
    """The smallest node of every circle of pointers, none if there is no circle.

    After k rounds a pointer is 2**k steps long. A node that has not met a root yet is
    followed on; if no more of them are left than a pointer is long, one more round ends all
    paths that end at all, and what is left runs in circles.
    """
    state = links.select("node", F.col("parent").alias("to"), F.col("node").alias("least"))
    length, last = 1, False
    while True:
        active = state.count()
        if active == 0:
            return None
        if last:
            circle = state.select(F.col("to").alias("node")).distinct()
            return steps.keep(state.join(circle, "node").where("least = node").select("node"))
        last = active <= length
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("least").alias("other"))
        state = steps.keep(
            state.join(ahead, "to").select("node", F.col("next").alias("to"), F.least("least", "other").alias("least"))
        )
        length *= 2


def _sizes(steps: Steps, state: DataFrame) -> DataFrame:
    """(node, parent, size): nodes under each one, itself included, from (node, parent, to, size = 1)."""
    while True:
        sent = state.where("to IS NOT NULL")
        if sent.isEmpty():
            return state.drop("to")
        more = sent.groupBy(F.col("to").alias("node")).agg(F.sum("size").alias("more"))
        ahead = state.select(F.col("node").alias("to"), F.col("to").alias("next"))
        state = steps.keep(
            state.join(ahead, "to", "left").join(more, "node", "left")
            .select("node", "parent", F.col("next").alias("to"), (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"))
        )


def _offsets(sizes: DataFrame) -> DataFrame:
    """The rows with ``step``: how far a node's number lies after its parent's.

    One more than the sizes of the siblings before it; the roots are siblings as well. Where
    they are very many, they are dealt into buckets by their number and summed by many tasks.
    Such parents are at most one in ``SIBLINGS`` nodes, so they are broadcast.
    """
    hubs = sizes.groupBy(F.col("parent").alias("_hub")).agg(F.ceil(F.count("*") / SIBLINGS).alias("_buckets")).where("_buckets > 1")
    bucket = F.pmod(F.xxhash64("node"), F.coalesce("_buckets", F.lit(1).cast("bigint")))
    dealt = sizes.join(F.broadcast(hubs), F.col("parent").eqNullSafe(F.col("_hub")), "left").withColumn("bucket", bucket)
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("parent", "bucket").orderBy("node").rowsBetween(*before)
    earlier = Window.partitionBy("_above").orderBy("_bucket").rowsBetween(*before)
    starts = (
        dealt.where("_buckets IS NOT NULL")
        .groupBy(F.col("parent").alias("_above"), F.col("bucket").alias("_bucket")).agg(F.sum("size").alias("total"))
        .select("_above", "_bucket", F.sum("total").over(earlier).alias("start"))
    )
    return (
        dealt.withColumn("own", F.sum("size").over(inside))
        .join(F.broadcast(starts), F.col("parent").eqNullSafe(F.col("_above")) & (F.col("bucket") == F.col("_bucket")), "left")
        .select(*sizes.columns, (F.coalesce("start", F.lit(0)) + F.coalesce("own", F.lit(0)) + 1).alias("step"))
    )


def _numbers(steps: Steps, state: DataFrame) -> DataFrame:
    """(node, parent, size, root, depth, pre): sums along the way to the root."""
    while True:
        active = state.where("to IS NOT NULL")
        if active.isEmpty():
            return state.drop("to")
        ahead = state.select(
            F.col("node").alias("to"), F.col("to").alias("_to"), F.col("root").alias("_root"),
            F.col("depth").alias("_depth"), F.col("pre").alias("_pre"),
        )
        moved = active.join(ahead, "to").select(
            "node", "parent", "size", F.col("_to").alias("to"), F.col("_root").alias("root"),
            (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("pre") + F.col("_pre")).alias("pre"),
        )
        state = steps.keep(moved.unionByName(state.where("to IS NULL")))


def forest(links: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """One row per node: ``node``, ``parent``, ``root``, ``depth``, ``pre``, ``size`` and ``cut``.

    Nodes are all that occur on either side; a NULL parent, a NULL node and a node that is its
    own parent link nothing. Repeated links count once; two parents of a node are an error.
    ``cut`` is the parent that was taken from a node to open a circle, NULL for all others.
    The nodes under a node have the same root and numbers ``pre`` from its own + 1 to its
    own + size - 1.
    """
    steps = Steps(links.sparkSession, "forest")
    named = links.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    linked = F.when(F.col("node") != F.col("parent"), F.col("parent"))
    every = named.withColumn("parent", linked).unionByName(named.select(F.col("parent").alias("node")), allowMissingColumns=True)
    clash = F.raise_error(F.lit(CLASH)).cast("boolean")
    tree = steps.keep(
        every.where("node IS NOT NULL").groupBy("node").agg(F.min("parent").alias("parent"), F.max("parent").alias("other"))
        .where(F.when(F.col("parent") != F.col("other"), clash).otherwise(F.lit(True))).drop("other")
    )
    whole = tree.where("parent IS NOT NULL")
    cut = _cut_nodes(steps, whole)
    if cut is not None:
        opened = whole.join(cut, "node").select("node", F.col("parent").alias("cut"))
        tree = steps.keep(
            tree.join(opened, "node", "left").select("node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"))
        )
    one = F.lit(1).cast("bigint")
    sizes = _sizes(steps, tree.select("node", "parent", F.col("parent").alias("to"), one.alias("size")))
    top = F.col("parent").isNull()
    start = steps.keep(
        _offsets(sizes).select(
            "node", "parent", "size", F.col("parent").alias("to"), F.when(top, F.col("node")).alias("root"),
            F.when(top, 0).otherwise(1).cast("bigint").alias("depth"), F.when(top, F.col("step") - 1).otherwise(F.col("step")).alias("pre"),
        )
    )
    found = _numbers(steps, start)
    if cut is None:
        found = found.withColumn("cut", F.lit(None).cast(tree.schema["parent"].dataType))
    else:
        found = found.join(opened, "node", "left")
    return steps.end(found.select("node", "parent", "root", "depth", "pre", "size", "cut"))[0]


# -- dense numbers --------------------------------------------------------------------------

# Numbers that one task sums up, and rows that are looked up together: as powers of two.
STRETCH, BLOCK = 16, 8


def running(rows: DataFrame, at: str, amount: str, name: str) -> DataFrame:
    """The rows with the sum of ``amount`` over all rows before, in the order of ``at`` and ``amount``.

    ``at`` is a number from dense ones. They are summed in stretches, then a row per stretch.
    """
    dealt = rows.withColumn("_part", F.call_function("shiftright", F.col(at), F.lit(STRETCH)))
    before = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy(at, amount).rowsBetween(*before)
    earlier = Window.orderBy("_part").rowsBetween(*before)
    starts = dealt.groupBy("_part").agg(F.sum(amount).alias("_sum")).select(
        "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start")
    )
    summed = dealt.withColumn(name, F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return summed.join(F.broadcast(starts), "_part").withColumn(name, F.col(name) + F.col("_start")).drop("_part", "_start")


def blocks(rows: DataFrame, number: str) -> DataFrame:
    """Rows with dense numbers from 0 for ``between``: those of a block in one row."""
    block = F.call_function("shiftright", F.col(number), F.lit(BLOCK)).alias("_block")
    row = F.struct(number, *[c for c in rows.columns if c != number])
    return rows.groupBy(block).agg(F.sort_array(F.collect_list(row)).alias("_rows"))


def between(spans: DataFrame, low: str, high: str, kept: DataFrame) -> DataFrame:
    """Each span with each row (``_row``) numbered from ``low`` to before ``high``; ``kept`` is from ``blocks``.

    A span is moved once per block that it touches, not once per row.
    """
    def block(c: Column) -> Column:
        return F.call_function("shiftright", c, F.lit(BLOCK))

    spread = spans.where(F.col(low) < F.col(high)).withColumn(
        "_block", F.explode(F.sequence(block(F.col(low)), block(F.col(high) - 1)))
    )
    begin = F.call_function("shiftleft", F.col("_block"), F.lit(BLOCK))
    first = F.greatest(F.col(low) - begin, F.lit(0)).cast("int")
    last = F.least(F.col(high) - begin, F.lit(1 << BLOCK)).cast("int")
    met = spread.join(kept.hint("merge"), "_block")
    return met.select(*spans.columns, F.explode(F.slice("_rows", first + 1, last - first)).alias("_row"))


# -- points in intervals --------------------------------------------------------------------


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The dyadic blocks (level, block) that make up the numbers from ``low`` to before ``high``."""

    def at(k: Column) -> Column:
        k = k.cast("int")
        one = F.lit(1).cast("bigint")
        first = F.call_function("shiftright", low + F.call_function("shiftleft", one, k) - 1, k)
        last = F.call_function("shiftright", high, k)
        left = F.when((first < last) & (first % 2 == 1), F.array(F.struct(k.alias("level"), first.alias("block"))))
        right = F.when((first < last) & (last % 2 == 1), F.array(F.struct(k.alias("level"), (last - 1).alias("block"))))
        return F.concat(F.coalesce(left, F.array()), F.coalesce(right, F.array()))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def covered(
    points: DataFrame, at: str, spans: DataFrame, low: str, high: str, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Each point with each span of the same ``keys`` that holds it (``low`` <= ``at`` < ``high``).

    The numbers are not negative; the other columns of the two sides have names of their own.
    ``how`` may be ``left_anti``: the points that no span holds, which then have to be distinct.

    Both joins are sorted and merged: Spark judges a cut side by the rows before the cut, and a
    broadcast by that size would gather many times as much in the driver.
    """
    longest = spans.agg(F.max(F.col(high) - F.col(low))).first()[0]
    levels = max(0, int(longest or 0).bit_length())
    cut = spans.withColumn("_b", F.explode(_blocks(F.col(low), F.col(high), levels)))
    cut = cut.select(*spans.columns, F.col("_b.level").alias("_level"), F.col("_b.block").alias("_block"))
    spread = points.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    spread = spread.withColumn("_block", F.call_function("shiftright", F.col(at), F.col("_level")))
    met = spread.join(cut.hint("merge"), [*keys, "_level", "_block"])
    if how == "inner":
        return met.drop("_level", "_block")
    return points.join(met.select(*points.columns).distinct().hint("merge"), points.columns, "left_anti")


def ancestors(tree: DataFrame) -> DataFrame:
    """(node, above, distance): every node with all nodes above it, circles included.

    A node whose way up enters a circle has all nodes of that circle above it.
    """
    points = tree.select("root", F.col("node"), F.col("pre").alias("_at"), F.col("depth").alias("_depth"))
    spans = tree.where("size > 1").select(
        "root", F.col("node").alias("above"), (F.col("pre") + 1).alias("_low"), (F.col("pre") + F.col("size")).alias("_high"),
        F.col("depth").alias("_up"),
    )
    straight = covered(points, "_at", spans, "_low", "_high", ["root"]).select(
        "node", "above", (F.col("_depth") - F.col("_up")).alias("distance")
    )
    ring = circles(tree).select(
        "root", F.col("node").alias("above"), "turn", F.col("pre").alias("_low"), (F.col("pre") + F.col("size")).alias("_high")
    )
    around = points.join(ring, "root").where("_at < _low OR _at >= _high").select(
        "node", "above", (F.col("_depth") + F.col("turn")).alias("distance")
    )
    return straight.unionByName(around)


def circles(tree: DataFrame) -> DataFrame:
    """The nodes of every circle: ``root``, ``node``, ``turn``, ``pre`` and ``size``.

    ``turn`` counts the steps to the node from the circle's root, all the way round.
    """
    opened = tree.where("cut IS NOT NULL").select("root", F.col("cut").alias("node"))
    ends = tree.join(opened, ["root", "node"]).select("root", F.col("pre").alias("_at"), F.col("depth").alias("_last"))
    spans = tree.select("root", "node", "pre", "size", "depth", (F.col("pre") + F.col("size")).alias("_high"))
    return covered(ends, "_at", spans, "pre", "_high", ["root"]).select(
        "root", "node", (F.col("_last") + 1 - F.col("depth")).alias("turn"), "pre", "size"
    )
