"""Conversation prefix trie by ROLLUP over positional turn-id columns.

Conversations that begin with the same turns share the nodes of a trie. A conversation is a
row per block of turns, one turn-id column per position; ``ROLLUP`` over these columns
aggregates all prefixes of a block at once, ``grouping_id`` tells their lengths. Longer
conversations continue in a further block, keyed by the node at which the block before it
ends. A second ``ROLLUP`` over the shared nodes sums what lies under every one of them, from
the last block to the first. A conversation that is alone at the end of a block shares
nothing after it: the rest of it is a chain and needs no further block.

A turn id is the digest of role and text with the length of the text; a node's key is the
digest of the key of its block and the turn ids since, so every row knows the keys of its
nodes without a join. Rows without a conversation id belong to no conversation and are left
out. Turns with equal numbers are ordered by their digest. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import column, ship
from .work import Work

# Turn-id columns of a block.
WIDTH = 6
# Ids that travel together on their way into one digest.
CHUNK_IDS = 4096
GROUP = 100
SHARED_TURNS = 6

# The digest of the empty sequence, as an expression.
_ROOT = "unhex(md5(CAST('' AS BINARY)))"


def turns(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Rows (c, turn, id) of the turns that have a conversation, null role and text as empty.

    ``id`` is the digest of role and text (16 bytes) and the text's length (4 bytes).
    """
    said, by = F.coalesce(column(text), F.lit("")), F.coalesce(column(role), F.lit(""))
    digest = F.md5(F.concat(F.length(by).cast("string"), F.lit(":"), by, said).cast("binary"))
    size = F.lpad(F.hex(F.length(said).cast("bigint")), 8, "0")
    return conversations.where(column(conv_id).isNotNull()).select(
        column(conv_id).cast("bigint").alias("c"), column(turn).alias("turn"), F.unhex(F.concat(digest, size)).alias("id")
    )


def _size(turn_id: Column) -> Column:
    return F.conv(F.hex(F.substring(turn_id, 17, 4)), 16, 10).cast("bigint")


def positions(work: Work, said: DataFrame) -> DataFrame:
    """(c, p, id): the turns of each conversation numbered from 0 by turn, null first.

    Rows are dealt by ranges of (conversation, turn), so one conversation that holds much of
    the table is numbered by many tasks; the range of a row is fixed by being written.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("id")]
    dealt = work.keep(said.repartitionByRange("c", *order).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("c", "part").count()
    before = F.sum("count").over(Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("c", "part", F.coalesce(before, F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("c", "part").orderBy(*order)) - 1
    return work.keep(
        dealt.withColumn("r", inside).join(starts, ["c", "part"]).select("c", (F.col("start") + F.col("r")).alias("p"), "id")
    )


def spliced(work: Work, placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of the first one of their hundred.

    Conversation c takes the first h turns of conversation ``c - c % 100`` (h is the crc32 of
    its number modulo 6) and its own turns after its first h. Returns the turns (c, p, id) and
    every conversation with its number of turns (c, size), also those without any.
    """
    h = F.crc32(F.col("c").cast("string").cast("binary")) % SHARED_TURNS
    own = placed.groupBy("c").agg(F.count("*").alias("own")).withColumn("h", h)
    own = own.withColumn("base", F.col("c") - F.col("c") % GROUP)
    first = own.select(F.col("c").alias("base"), F.col("own").alias("there"))
    convs = work.keep(
        own.join(first, "base", "left")
        .withColumn("lent", F.least("h", F.coalesce("there", F.lit(0))))
        .select("c", "base", "h", "lent", (F.col("lent") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size"))
    )
    lent = (
        placed.where((F.col("c") % GROUP == 0) & (F.col("p") < SHARED_TURNS)).withColumnRenamed("c", "base")
        .join(convs.select("c", "base", "lent"), "base").where("p < lent").select("c", "p", "id")
    )
    kept = (
        placed.join(convs.select("c", "h", "lent"), "c").where("p >= h")
        .select("c", (F.col("p") - F.col("h") + F.col("lent")).alias("p"), "id")
    )
    return work.keep(lent.unionByName(kept)), convs.select("c", "size")


def _key(width: int) -> Column:
    """Key of the node at the last turn id that is not null: the block's own key if there is none."""
    ids = [F.coalesce(F.col(f"t{k}"), F.lit(b"")) for k in range(width)]
    return F.when(F.col("t0").isNull(), F.col("up")).otherwise(F.unhex(F.md5(F.concat("up", *ids))))


def _rollup(rows: DataFrame, width: int, sums: str) -> DataFrame:
    """All prefixes of a block: ``level``, ``up``, the turn ids of the prefix, and the sums.

    A prefix that ends in a missing turn is no node; the level without any turn is kept.
    """
    ids = ", ".join(f"t{k}" for k in range(width))
    held = " + ".join(f"CAST(t{k} IS NOT NULL AS INT)" for k in range(width))
    return rows.sparkSession.sql(
        f"""SELECT * FROM (
              SELECT up, {ids}, {width} - bit_count(grouping_id()) AS level, {sums}
              FROM {{rows}} GROUP BY up, ROLLUP ({ids})
            ) WHERE level = {held}""",
        rows=rows,
    )


def _down(work: Work, said: DataFrame, convs: DataFrame, width: int):
    """Nodes of all blocks, where conversations end, and from where they are alone."""
    block = F.floor(F.col("p") / width).alias("block")
    ids = [F.max(F.when(F.col("p") % width == k, F.col("id"))).alias(f"t{k}") for k in range(width)]
    blocks = work.keep(said.groupBy("c", block).agg(*ids))
    state, number, nodes, ends, alone = convs.withColumn("up", F.expr(_ROOT)), 0, [], [], []
    while number == 0 or not state.isEmpty():
        reached = (number + 1) * width
        rows = work.keep(
            state.join(blocks.where(F.col("block") == number).drop("block"), "c", "left").withColumn("end", _key(width))
        )
        found = _rollup(rows, width, "min(c) AS conv_id, count(*) AS n_convs, max(size) AS longest")
        if number:
            found = found.where("level > 0")
        last = F.coalesce(*[F.col(f"t{k}") for k in reversed(range(width))])
        above = F.when(F.col("level") == 1, F.col("up")).otherwise(
            F.unhex(F.md5(F.concat("up", *[
                F.when(F.col("level") > k + 1, F.col(f"t{k}")).otherwise(F.lit(b"")) for k in range(width)
            ])))
        )
        kept = work.keep(
            found.select(
                "*", F.lit(number).alias("block"), (F.lit(number * width) + F.col("level")).cast("bigint").alias("depth"),
                _key(width).alias("key"), F.when(F.col("level") > 0, above).alias("parent"),
                F.coalesce(_size(last), F.lit(0)).alias("chars"),
            )
        )
        nodes.append(kept)
        ends.append(rows.where(F.col("size") <= reached).select(F.col("end").alias("key"), "c"))
        single = kept.where(f"level = {width} AND n_convs = 1 AND longest > {reached}")
        alone.append(single.select(F.col("conv_id").alias("c"), F.col("depth").alias("since"), F.col("longest").alias("size")))
        state = work.keep(
            rows.where(F.col("size") > reached)
            .join(alone[-1].select("c"), "c", "left_anti").select("c", "size", F.col("end").alias("up"))
        )
        number += 1
    return nodes, _union(ends), _union(alone)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def trie(work: Work, said: DataFrame, convs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie, and the conversations (key, c) that end at them.

    ``said`` holds the turns (c, p, id), numbered from 0, ``convs`` all conversations with
    their numbers of turns (c, size). A node is named by its smallest member and its depth:
    ``key``, ``conv_id``, ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``. Nodes of chains have no key; there conversation
    ``conv_id`` ends at its last node.
    """
    blocks, ends, alone = _down(work, said, convs, width)
    nodes = _union(blocks)
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("n_single")
    )
    shared = work.keep(
        nodes.where("n_convs > 1").join(children, "key", "left")
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single")))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars"))
        .drop("n_single")
    )
    totals, carry = [], None
    for number in reversed(range(len(blocks))):
        rows = shared.where(F.col("block") == number)
        if carry is not None:
            rows = rows.join(carry, "key", "left").withColumns({
                c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("leaves", "saved")
            })
        sums = work.keep(
            _rollup(rows, width, "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens")
            .select("level", _key(width).alias("key"), "n_leaves", "saved_tokens")
        )
        totals.append(sums.where("level > 0") if number else sums)
        carry = sums.where("level = 0").select(
            "key", F.col("n_leaves").alias("more_leaves"), F.col("saved_tokens").alias("more_saved")
        )
    several = shared.join(_union(totals).drop("level"), "key")
    one = nodes.where("n_convs = 1").withColumns({
        "n_children": (F.col("longest") > F.col("depth")).cast("bigint"), "n_leaves": F.lit(1).cast("bigint"),
        "saved_tokens": F.lit(0).cast("bigint"),
    })
    names = ["key", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    found = work.keep(several.select(*names).unionByName(one.select(*names)))
    parents = found.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = found.where("parent IS NOT NULL").join(parents, "parent").drop("parent")
    root = found.where("parent IS NULL").drop("parent").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    since = alone.select("c", "since", "size")
    chains = said.join(since, "c").where("p >= since").select(
        F.lit(None).cast("binary").alias("key"), F.col("c").alias("conv_id"), (F.col("p") + 1).alias("depth"),
        F.lit(1).cast("bigint").alias("n_convs"), (F.col("p") + 1 < F.col("size")).cast("bigint").alias("n_children"),
        F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
        F.col("c").alias("parent_conv_id"),
    )
    return below.unionByName(root).unionByName(chains), ends


def digests(ends: DataFrame) -> DataFrame:
    """Per key the SHA-256 of its ids (c), ascending and comma-joined: (key, ends_sha256).

    A digest is taken in order, so the ids of a key meet in one task at last, as a stream of
    joined pieces that are sorted and built by ranges: no task holds the ids of a key.
    """
    ship(ends.sparkSession)
    pieces_schema = T.StructType.fromDDL("key binary, first bigint, ids string")
    arrow = pa.schema([("key", pa.binary()), ("first", pa.int64()), ("ids", pa.string())])
    done = pa.schema([("key", pa.binary()), ("ends_sha256", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]):
        key, ids = None, []

        def piece():
            return {"key": key, "first": ids[0], "ids": ",".join(map(str, ids))}

        for batch in batches:
            out = []
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (k != key or len(ids) == CHUNK_IDS):
                    out.append(piece())
                    ids = []
                key = k
                ids.append(c)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if ids:
            yield pa.RecordBatch.from_pylist([piece()], schema=arrow)

    def digest(batches: Iterator[pa.RecordBatch]):
        key, state = None, None
        for batch in batches:
            out = []
            for k, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if state is None or k != key:
                    if state is not None:
                        out.append({"key": key, "ends_sha256": state.hexdigest()})
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pa.RecordBatch.from_pylist(out, schema=done)
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": state.hexdigest()}], schema=done)

    sorted_ids = ends.select("key", "c").repartitionByRange("key", "c").sortWithinPartitions("key", "c")
    pieces = sorted_ids.mapInArrow(join, pieces_schema)
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def summary(conversations: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per node of the trie of the spliced conversations, see ``spliced`` and ``trie``.

    ``ends_sha256`` is the digest of the conversations that end at the node.
    """
    work = Work(conversations.sparkSession, "prefix-trie")
    said, convs = spliced(work, positions(work, turns(conversations)))
    nodes, ends = trie(work, said, convs, width)
    chain_end = F.when(F.col("key").isNull() & (F.col("n_children") == 0), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256))
    empty = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    named = nodes.where("key IS NOT NULL").join(digests(ends), "key", "left")
    chains = nodes.where("key IS NULL").withColumn("ends_sha256", F.lit(None).cast("string"))
    return work.end(
        named.unionByName(chains).select(*columns, F.coalesce("ends_sha256", chain_end, empty).alias("ends_sha256"))
    )


def check_sql() -> str:
    """The same rows from lists of turns; every node is counted under each of its ancestors."""
    return f"""WITH
crc AS (SELECT list(list_reduce([x] || range(8), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY x) AS v FROM range(256) AS r(x)),
t AS (SELECT conv_id AS c, turn, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS k,
  length(coalesce(text, '')) AS s FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list(struct_pack(k := k, s := s) ORDER BY turn NULLS FIRST, k) AS w FROM t GROUP BY c),
h AS (SELECT c, w, c - c % {GROUP} AS base, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(c::VARCHAR, ''), lambda z: ord(z)::BIGINT),
  lambda a, b: xor(a >> 8, v[(xor(a, b) & 255) + 1])), 4294967295) % {SHARED_TURNS} AS h FROM o, crc),
r AS (SELECT h.c, coalesce(b.w[1:h], []) || h.w[h + 1:] AS w FROM h LEFT JOIN o AS b ON b.c = h.base),
p AS (SELECT c, d, len(w) = d AS ends, list_reduce([''] || list_transform(w[1:d], lambda z: z.k), lambda a, b: md5(a || b)) AS x,
  list_reduce([''] || list_transform(w[1:d - 1], lambda z: z.k), lambda a, b: md5(a || b)) AS y, coalesce(w[d].s, 0) AS s
  FROM r, unnest(range(len(w) + 1)) AS u(d)),
n AS (SELECT d, x, any_value(CASE WHEN d > 0 THEN y END) AS y, any_value(s) AS s, min(c) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, x),
k AS (SELECT d - 1 AS d, y AS x, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (d, x)),
a AS (SELECT DISTINCT q.d, q.x, p.d AS e, p.x AS z FROM p, p AS q WHERE p.c = q.c AND p.d <= q.d),
s AS (SELECT e AS d, z AS x, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * s)::BIGINT AS saved_tokens FROM m JOIN a USING (d, x) GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (d, x) LEFT JOIN n AS u ON u.d = m.d - 1 AND u.x = m.y"""
