"""N-gram Jaccard join by prefixes with token combinations.

A document is its set of distinct five-word shingles (tokens). Tokens are ordered by how
many documents hold them, rare ones first. If two sets are similar enough, few tokens of
one are missing from the other; a prefix that is one token longer than that number shares a
token with the other's prefix. Where a prefix has to use frequent tokens, it is extended
and pairs of frequent tokens are indexed instead of single ones, in classes so that their
number stays in proportion to the set. Candidates are verified on the whole sets.

Equal sets are one node from the start. Classes of linked documents are grown in two rounds.
First the nodes under a signature are compared with one of them, the one that has the fewest
tokens of its own, so a group of copies costs about one comparison per copy. Then the nodes
that share a signature and are still in different classes are paired, signature by signature
and in ranges of sizes that can be similar. A sketch of each set, the parity of its tokens in
a few bits per token, bounds from above what two sets share; only pairs that pass it are
emitted and verified. Signatures with the same nodes are looked at once. Tokens that no other
document holds cannot be shared: pairs that are too far apart by their sizes without those
tokens are never compared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_folder, scratch_path
from .packs import PACK_DOCUMENTS, bucket_count, known, look_up, pack_documents, place, repeated_keys, texts_of
from .rows import column

SHINGLE = 5
PERCENT = 80
# Documents up to which a token counts as rare and is indexed alone.
RARE = 100
# A class of frequent tokens holds about this many tokens of a set.
CLASS_TOKENS = 16
# Nodes of a block; two blocks are compared in one task, by their sketches.
BLOCK_NODES = 2048
# Least and most bits of a sketch.
SKETCH_BITS = (256, 65_536)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_M = 0x9E3779B97F4A7C15
_NOTE = 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_U = np.uint64
_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _U(_M))
_IN_WORD = np.array([c != 32 and not 9 <= c <= 13 for c in range(256)])
_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """The first ``n`` powers of the multiplier or more, kept by the process."""
    global _powers
    while len(_powers) < n:
        step = pow(_M, len(_powers), 1 << 64)
        _powers = np.concatenate((_powers, _powers * _U(step)))
    return _powers


def _word_hashes(text: bytes) -> np.ndarray:
    """A hash per word of a lower-cased text: a polynomial over its bytes, mixed with its length."""
    data = np.frombuffer(text, np.uint8)
    inside = _IN_WORD[data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.zeros(0, np.uint64)
    chars = data[inside]
    first = np.cumsum(lengths) - lengths
    place_in = np.arange(len(chars)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTES[chars] * _power(int(lengths.max()))[place_in], first)
    return _mix(h + lengths.astype(np.uint64))


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, none is empty."""
    h = _word_hashes(text.translate(_LOWER))
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _U(_M) + h[k : len(h) - n + 1 + k]
    out = np.sort(_mix(out))
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def sketch(tokens: np.ndarray) -> bytes:
    """Parities of the tokens by hash, in about two bits per token.

    Where two sketches differ, the sets differ in a token at least; a longer sketch is folded
    to half its length by combining its halves.
    """
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << (2 * len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens >> _U(7)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(sketches: list[bytes]) -> np.ndarray:
    """The sketches as rows of 64-bit words, all as long as the shortest."""
    width = min(map(len, sketches)) // 8
    out = np.empty((len(sketches), width), np.uint64)
    for k, data in enumerate(sketches):
        words = np.frombuffer(data, np.uint64)
        while len(words) > width:
            words = words[: len(words) // 2] ^ words[len(words) // 2 :]
        out[k] = words
    return out


def _note(texts: list[bytes]) -> bytes:
    """Digest and size of each set, twenty bytes per document."""
    out = []
    for t in texts:
        s = shingles(t)
        out.append(hashlib.blake2b(s.tobytes(), digest_size=_NOTE - 4).digest() + len(s).to_bytes(4, "big"))
    return b"".join(out)


def _keys(buckets: int):
    def keys_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
        seen, sets = set(), [np.zeros(0, np.uint64)]
        for k, t in enumerate(texts_of(row["body"], row["sizes"])):
            digest = row["note"][k * _NOTE : (k + 1) * _NOTE]
            if digest not in seen:
                seen.add(digest)
                sets.append(shingles(t))
        return np.unique(place(np.concatenate(sets), buckets), return_counts=True)

    return keys_of


def _combined(tokens: np.ndarray, classes: int, level: int) -> list[np.ndarray]:
    """A signature per pair of tokens of one class."""
    own = ((tokens >> np.uint64(20)) % np.uint64(classes)).astype(np.int64)
    out = []
    for c in np.unique(own):
        inside = np.sort(tokens[own == c])
        i, j = np.triu_indices(len(inside), 1)
        out.append(_mix(inside[i] * np.uint64(_M) + inside[j] + np.uint64(level + 1)))
    return out


def signatures(tokens: np.ndarray, counts: np.ndarray, percent: int = PERCENT, rare: int = RARE) -> np.ndarray:
    """Keys that any two similar sets share at least one of.

    At most ``missing`` tokens of a set lie outside a similar one. Every rare token of a
    prefix can be hidden by one missing token, a class of n frequent tokens by n - 1; the
    prefix is as long as it takes to hide more than ``missing``. Classes depend on the size
    range of the set; each set is indexed for every range that a similar one may be in.
    Sets too small for a pair of tokens are similar only to equal sets. Tokens that no
    other set holds need no key.
    """
    n = len(tokens)
    missing = n - (n * percent + 99) // 100
    order = np.lexsort((tokens, counts))
    tokens, counts = tokens[order], counts[order]
    n_rare = int(np.searchsorted(counts, rare, "right"))
    single = tokens[: min(n_rare, missing + 1)]
    single = single[counts[: len(single)] > 1]
    out = [single]
    need = missing + 1 - n_rare
    if need > 0:
        frequent = tokens[n_rare:]
        smallest, largest = (n * percent + 99) // 100, n * 100 // percent
        for level in range(smallest.bit_length(), largest.bit_length() + 1):
            classes = max(1, (1 << (level - 1)) // CLASS_TOKENS)
            own = (frequent >> np.uint64(20)) % np.uint64(classes)
            first = np.zeros(len(frequent), np.int64)
            first[np.unique(own, return_index=True)[1]] = 1
            length = int(np.searchsorted(np.cumsum(1 - first), need)) + 1
            out += _combined(frequent[:length], classes, level)
    return np.unique(np.concatenate(out))


class _Work:
    """A folder of tables in between, removed at the end."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.count = spark, scratch_path(spark, "jaccard"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows, written to the shared folder and read back."""
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def end(self, result: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "jaccard-result")
        result.write.parquet(path)
        drop_folder(self.spark, self.folder)
        return self.spark.read.schema(result.schema).parquet(path)


def members(packs: DataFrame) -> DataFrame:
    """``doc_id``, ``node`` (the row's own number), ``digest`` and ``n`` of every document."""
    return packs.select("pack", "note", F.posexplode("ids").alias("at", "doc_id")).select(
        "doc_id",
        (F.col("pack") * PACK_DOCUMENTS + F.col("at")).alias("node"),
        F.expr(f"substring(note, at * {_NOTE} + 1, {_NOTE - 4})").alias("digest"),
        F.expr(f"CAST(conv(hex(substring(note, at * {_NOTE} + {_NOTE - 3}, 4)), 16, 10) AS BIGINT)").alias("n"),
    )


def index(packs: DataFrame, heads: DataFrame, percent: int, rare: int) -> DataFrame:
    """One row per distinct set that has a signature: ``node``, ``n``, ``s``, ``keys``, ``sketch``, ``body``.

    ``s`` is the number of tokens that other documents may hold as well.
    """
    buckets = bucket_count(packs)
    counts = repeated_keys(packs, _keys(buckets), buckets)
    chosen = heads.groupBy(F.floor(F.col("node") / PACK_DOCUMENTS).cast("bigint").alias("pack")).agg(
        F.collect_list(F.col("node") % PACK_DOCUMENTS).alias("chosen")
    )
    told = counts.unionByName(chosen, allowMissingColumns=True)
    arrow = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("s", pa.int64()), ("keys", pa.list_(pa.int64())), ("sketch", pa.binary()), ("body", pa.binary())])

    def sign(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, out = right.to_pylist(), []
        wanted = [k for r in rows if r["chosen"] is not None for k in r["chosen"]]
        if left.num_rows and wanted:
            found, totals = known([r for r in rows if r["chosen"] is None])
            pack = left.to_pylist()[0]
            texts = texts_of(pack["body"], pack["sizes"])
            squeezer = zstandard.ZstdCompressor(level=3)
            for k in sorted(wanted):
                tokens = shingles(texts[k])
                held = look_up(place(tokens, buckets), found, totals)
                keys = signatures(tokens, held, percent, rare)
                if len(keys):
                    out.append({
                        "node": pack["pack"] * PACK_DOCUMENTS + k, "n": len(tokens),
                        "s": int((held > 1).sum()), "keys": keys.astype(np.int64), "sketch": sketch(tokens),
                        "body": squeezer.compress(texts[k]),
                    })
        return pa.Table.from_pylist(out, schema=arrow)

    needed = packs.select("pack", "sizes", "body")
    return needed.groupBy("pack").cogroup(told.groupBy("pack")).applyInArrow(
        sign, "node bigint, n bigint, s bigint, keys array<bigint>, sketch binary, body binary"
    )


def _alike(x: str, y: str, percent: int) -> Column:
    """Whether two nodes can be similar, by their sizes and the tokens they may share."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    shared = F.least(f"{x}.s", f"{y}.s")
    return shared * (100 + percent) >= (n + m) * percent


def verified(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity, with both sizes of overlap."""
    body = nodes.select("node", "body")
    full = pairs.join(body.toDF("a", "body_a"), "a").join(body.toDF("b", "body_b"), "b")
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("either", pa.int64())])

    def compare(batches):
        sets = {}
        reader = zstandard.ZstdDecompressor()

        def load(node, data):
            if node not in sets:
                if len(sets) > 200:
                    sets.clear()
                sets[node] = shingles(reader.decompress(data))
            return sets[node]

        for batch in batches:
            out = []
            for a, b, x, y in zip(*[batch.column(c).to_pylist() for c in ("a", "b", "body_a", "body_b")]):
                s, t = load(a, x), load(b, y)
                common = len(np.intersect1d(s, t, assume_unique=True))
                either = len(s) + len(t) - common
                if 100 * common >= percent * either:
                    out.append({"a": a, "b": b, "common": common, "either": either})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return full.mapInArrow(compare, "a bigint, b bigint, common bigint, either bigint")


def components(work: _Work, edges: DataFrame) -> DataFrame:
    """(node, class): the smallest node reachable, for every node of an edge.

    Each step takes the smallest class among the neighbours and then follows it once, so
    long chains halve. Every step is written to the shared folder.
    """
    both = work.keep(
        edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    )
    label = work.keep(
        both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("class")
        )
    )
    while True:
        near = both.join(label.toDF("v", "c"), "v").groupBy("u").agg(F.min("c").alias("c"))
        closer = label.join(near.withColumnRenamed("u", "node"), "node").select(
            "node", F.col("class").alias("old"), F.least("class", "c").alias("class")
        )
        jumped = closer.join(label.toDF("class", "next"), "class", "left").select(
            "node", "old", F.least("class", F.coalesce("next", "class")).alias("class")
        )
        step = work.keep(jumped)
        label = step.select("node", "class")
        if step.where("class <> old").isEmpty():
            return label


def _candidates(work: _Work, index: DataFrame) -> DataFrame:
    """(key, node, n, s) of the keys that several nodes hold."""
    flat = index.select(F.explode("keys").alias("key"), "node", "n", "s")
    shared = flat.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    return work.keep(flat.join(shared, "key", "left_semi"))


def _pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs under a key."""
    return (
        rows.alias("x").join(rows.alias("y"), F.expr("x.key = y.key AND x.node < y.node"))
        .where(_alike("x", "y", percent))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
        .distinct()
    )


def links(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, rare: int = RARE
) -> DataFrame:
    """All links between different sets: (id, other_id, common, either), smallest ids of each.

    This is the join itself; its output grows with the square of a group of near copies.
    ``classes`` gives the linked groups without it.
    """
    work = _Work(docs.sparkSession)
    packs = pack_documents(docs, doc_id, text, _note, folder=work.folder)
    heads = _heads(work, packs)
    nodes = work.keep(index(packs, heads, percent, rare))
    found = verified(_pairs(_candidates(work, nodes), percent), nodes, percent)
    named = heads.select("node", "first_id")
    return work.end(
        found.join(named.toDF("a", "x"), "a").join(named.toDF("b", "y"), "b")
        .select(F.least("x", "y").alias("id"), F.greatest("x", "y").alias("other_id"), "common", "either")
    )


def _heads(work: _Work, packs: DataFrame) -> DataFrame:
    """One node per distinct set: its number, the smallest id and the digest."""
    return work.keep(
        members(packs).where("n > 0").groupBy("digest").agg(
            F.min("node").alias("node"), F.min("doc_id").alias("first_id")
        )
    )


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, rare: int = RARE
) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles`` and ``component_id``.

    The component is the smallest id reachable by links. A document without words, or with
    null text, is its own component. Rows that share an id are documents of their own; a
    null id is never the smallest unless all ids of the component are null.
    """
    work = _Work(docs.sparkSession)
    packs = pack_documents(docs, doc_id, text, _note, folder=work.folder)
    heads = _heads(work, packs)
    nodes = work.keep(index(packs, heads, percent, rare))
    label = _grow(work, _candidates(work, nodes), nodes, percent)
    named = heads.join(label, "node", "left").withColumn("class", F.coalesce("class", "node"))
    smallest = named.groupBy("class").agg(F.min("first_id").alias("component_id"))
    resolved = named.select("digest", "class").join(smallest, "class").select("digest", "component_id")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return work.end(
        members(packs).join(resolved, "digest", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
    )


def _grow(work: _Work, rows: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Classes of linked nodes from all candidate pairs."""
    # One node per key, the same one wherever it comes first in this order.
    middle = F.min(F.struct((F.col("n") - F.col("s")).alias("own"), F.xxhash64("node"), "node", "n", "s"))
    stars = rows.groupBy("key").agg(middle.alias("m"))
    pairs = work.keep(
        rows.alias("x").join(stars, "key")
        .where((F.col("x.node") != F.col("m.node")) & _alike("x", "m", percent))
        .select(F.least("x.node", "m.node").alias("a"), F.greatest("x.node", "m.node").alias("b"))
        .distinct()
    )
    label = work.keep(rows.select("node", F.col("node").alias("class")).distinct())
    label = _joined(work, label, work.keep(verified(pairs, nodes, percent)))
    close = work.keep(_close(work, rows.join(label, "node"), nodes, percent))
    return _joined(work, label, work.keep(verified(close, nodes, percent)))


def _joined(work: _Work, label: DataFrame, links: DataFrame) -> DataFrame:
    """Classes after new links; only classes that a new link touches are looked at again."""
    if links.isEmpty():
        return label
    between = (
        links.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b")
        .select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    )
    merged = components(work, between).toDF("class", "into")
    return work.keep(
        label.join(merged, "class", "left").select("node", F.coalesce("into", "class").alias("class"))
    )


def _close(work: _Work, placed: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) under a signature that are in different classes and may be similar.

    Similar sets lie in the same range of sizes or in the next; so each node is held by its
    own range and visits the next one. A (signature, range) of many nodes is dealt into blocks
    by hash, and every two blocks are a group of their own.
    """
    node_hash = F.xxhash64("node")
    ties = (
        placed.groupBy("key")
        .agg(
            F.min("class").alias("first"), F.max("class").alias("last"), F.count("*").alias("c"),
            F.bit_xor(node_hash).alias("x"), F.min("node").alias("low"), F.max("node").alias("high"),
        )
        .where("first <> last")
        # Of signatures with the same nodes one is enough.
        .groupBy("x", "c", "low", "high").agg(F.min("key").alias("key")).select("key")
    )
    open_rows = work.keep(placed.join(ties, "key").select("key", "node", "n", "s", "class"))
    # A little wider than the similarity asks for, so that rounding moves no set two ranges off.
    ratio = 1.0001 * float(np.log(100 / percent)) if percent < 100 else 1.0
    own = F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int")
    at = [F.struct((own + k).alias("range"), F.lit(k == 0).alias("home")) for k in (0, 1)]
    held = open_rows.select("*", F.explode(F.array(*at)).alias("g")).select(
        "key", "node", "n", "s", "class", "g.range", "g.home"
    )
    sizes = (
        held.groupBy("key", "range")
        .agg(F.min("class").alias("first"), F.max("class").alias("last"), F.bool_or("home").alias("any"), F.count("*").alias("c"))
        .where("any AND first <> last")
        .select("key", "range", F.ceil(F.col("c") / BLOCK_NODES).cast("int").alias("blocks"))
    )
    dealt = (
        held.join(sizes, ["key", "range"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "range", "node", "n", "s", "class", "home", "own",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        )
        .join(nodes.select("node", "sketch"), "node")
    )
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(table: pa.Table) -> pa.Table:
        n, s, node, kind, home, own = (table.column(c).to_numpy() for c in ("n", "s", "node", "class", "home", "own"))
        bits = _folded(table.column("sketch").to_pylist())
        within = table.column("low")[0].as_py() == table.column("high")[0].as_py()
        left, right = [], []
        for i in range(len(n) - 1):
            after = slice(i + 1, None)
            both = n[i] + n[after]
            fits = (kind[after] != kind[i]) & (home[after] | home[i]) & ((100 + percent) * np.minimum(s[after], s[i]) >= percent * both)
            if not within:
                fits &= own[after] != own[i]
            at = np.flatnonzero(fits) + i + 1
            if len(at):
                differ = np.bitwise_count(bits[at] ^ bits[i]).sum(axis=1, dtype=np.int64)
                total = n[at] + n[i]
                at = at[(100 + percent) * (total - differ) >= 2 * percent * total]
                left.append(np.full(len(at), node[i]))
                right.append(node[at])
        if not left:
            return arrow.empty_table()
        x, y = np.concatenate(left), np.concatenate(right)
        return pa.Table.from_pydict({"a": np.minimum(x, y), "b": np.maximum(x, y)}, schema=arrow)

    return dealt.groupBy("key", "range", "low", "high").applyInArrow(compare, "a bigint, b bigint").distinct()


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each component, columns unchanged: the one with the smallest id.

    Rows are told apart by a number of their own, so ids may repeat or be null. Null ids come
    last; among rows that share the smallest id the one with the smallest number stays. Rows
    without words are components of their own and all stay.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "numbered")
    # The number is fixed by being written.
    rows = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("node")
    )
    rows.write.option("compression", "zstd").parquet(path)
    numbered = spark.read.schema(rows.schema).parquet(path)
    texts = numbered.select("node", F.col("row").getField(text).alias("text"))
    found = classes(texts, "node", "text", **options).select(F.col("doc_id").alias("node"), "component_id")
    own = F.col("row").getField(doc_id).cast("bigint")
    order = F.struct(own.isNull().alias("unnamed"), own.alias("id"), "node")
    kept = (
        numbered.select("node", order.alias("order")).join(found, "node")
        .groupBy("component_id").agg(F.min("order").alias("least")).select("least.node")
    )
    return numbered.join(kept, "node", "left_semi").select(
        *[F.col("row").getField(c).alias(c) for c in docs.columns]
    )
