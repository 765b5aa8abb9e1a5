"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``WINDOW`` consecutive item words. A shift table over blocks of two
words says how far a search may jump, buckets by the last block and the first block select
the windows to test, and a word-by-word comparison confirms each occurrence.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import column, field, with_results

WINDOW = 10
# Characters of benchmark text searched for at once; more items are searched block by block.
BLOCK_CHARS = 4_000_000

_KEEP = set(b"0123456789abcdefghijklmnopqrstuvwxyz")
_TABLE = bytes(
    c if c in _KEEP or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    return text.encode().translate(_TABLE).split() if text else []


class Patterns:
    """Wu-Manber tables for windows of one length over word numbers."""

    def __init__(self, length: int, windows: dict[tuple[int, ...], set], base: int):
        self.length, self.base = length, base
        self.block = min(2, length)
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list]] = {}
        for window, items in windows.items():
            for end in range(self.block - 1, length):
                key, jump = self._key(window, end), length - 1 - end
                self.shift[key] = min(jump, self.shift.get(key, jump))
            last, first = self._key(window, length - 1), self._key(window, self.block - 1)
            self.buckets.setdefault(last, {}).setdefault(first, []).append((list(window), items))

    def _key(self, ids, end: int) -> int:
        return ids[end] if self.block == 1 else ids[end - 1] * self.base + ids[end]

    def search(self, ids: list) -> Iterator[tuple[int, set]]:
        """Start and items of every occurrence; words outside all windows are None."""
        length, block, base = self.length, self.block, self.base
        shift, buckets = self.shift.get, self.buckets
        default, end, n = length - block + 1, length - 1, len(ids)
        while end < n:
            key = ids[end]
            if key is None:
                end += length
                continue
            if block == 2:
                before = ids[end - 1]
                if before is None:
                    end += default
                    continue
                key += before * base
            jump = shift(key, default)
            if jump:
                end += jump
                continue
            start = end - length + 1
            first = ids[start]
            if block == 2:
                second = ids[start + 1]
                first = None if first is None or second is None else first * base + second
            for window, items in buckets[key].get(first, ()):
                if ids[start : end + 1] == window:
                    yield start, items
            end += 1


def build(items: list[tuple[str | None, str | None]], window: int) -> tuple[dict, list[Patterns]]:
    """Word numbers and tables per window length; short items are one window each."""
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict] = {}
    for name, text in items:
        ids = tuple(vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text))
        length = min(window, len(ids))
        for start in range(len(ids) - length + 1) if ids else ():
            windows = by_length.setdefault(length, {})
            windows.setdefault(ids[start : start + length], set()).add(name)
    base = len(vocabulary) + 1
    return vocabulary, [Patterns(n, w, base) for n, w in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, item: str, text: str, block_chars: int) -> Iterator[list]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    rows = benchmark.select(column(item).cast("string").alias("i"), column(text).alias("t"))
    for i, t in rows.where("t IS NOT NULL").toLocalIterator():
        block.append((i, t))
        size += len(t)
        if size >= block_chars:
            yield block
            block, size = [], 0
    yield block


_HITS = T.ArrayType(
    T.StructType([T.StructField(n, k) for n, k in (
        ("start", T.IntegerType()), ("length", T.IntegerType()), ("items", T.ArrayType(T.StringType())))])
)
_HITS_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("items", pa.list_(pa.string()))]))


def occurrences(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``row`` with ``n_words`` and ``hits`` (first word, length, items of each occurrence).

    The documents stay where they are; only tables of at most ``block_chars`` of benchmark
    text are sent to the tasks, once per block. A null or empty text has no words and no
    hits; items without words are skipped; items that share an id count once; an empty
    benchmark gives no hits. Items without an id give hits like any other, without a name
    in ``items``.
    """
    sc = docs.sparkSession.sparkContext
    result = None
    for block in _blocks(benchmark, item, item_text, block_chars):
        tables = sc.broadcast(build(block, window))

        def scan(row, tables=tables, nested=result is not None):
            vocabulary, patterns = tables.value
            inner = row.field("row") if nested else row
            before = field(row, "hits") if nested else None
            counts, found = [], []
            for k, value in enumerate(field(inner, text)):
                tokens = words(value)
                ids = list(map(vocabulary.get, tokens))
                counts.append(len(tokens))
                hits = [
                    {"start": s, "length": p.length, "items": sorted(i - {None})}
                    for p in patterns for s, i in p.search(ids)
                ]
                found.append(before[k] + hits if nested else hits)
            return [pa.array(counts, pa.int64()), pa.array(found, _HITS_ARROW)]

        fields = [T.StructField("n_words", T.LongType()), T.StructField("hits", _HITS)]
        if result is None:
            result = with_results(docs, scan, fields)
        else:
            result = with_results(result, scan, fields).select("row.row", "n_words", "hits")
    return result


def contamination(hits: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One row per document with its digest columns, from ``occurrences``."""

    def digest(row):
        n_hit, n_items, sha = [], [], []
        for hits in field(row, "hits"):
            covered, end = 0, 0
            for start, stop in sorted((h["start"], h["start"] + h["length"]) for h in hits):
                covered += max(0, stop - max(start, end))
                end = max(end, stop)
            names = sorted({i for h in hits for i in h["items"]})
            n_hit.append(covered)
            n_items.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        return [pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string())]

    rows = hits.select(F.col("row").getField(doc_id).alias("doc_id"), "n_words", "hits")
    fields = [
        T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
    ]
    return with_results(rows, digest, fields).select(
        "row.doc_id", "row.n_words", "n_hit", "n_items", "items_sha256",
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any occurrence of a benchmark window, columns unchanged."""
    return occurrences(docs, benchmark, **options).where(F.size("hits") == 0).select("row.*")
