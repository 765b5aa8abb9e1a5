"""Removal of repeated byte strings by a distributed, common-prefix-aware merge sort.

A string of ``LENGTH`` bytes is dealt with at its anchor, the position in it whose
following ``GRAM`` bytes have the smallest hash. Equal strings have equal anchors, so it is
enough to sort the suffixes that start at anchors. Anchors whose bytes occur only once are
left out. Every pack sorts its suffixes, and sends them as front-coded runs (common prefix
with the suffix before, and the rest) to the bucket of their anchor. A bucket merges its
runs with a loser tree that carries common-prefix lengths: two suffixes with different
lengths are ordered by them alone, others are compared from the known prefix on. The merged
order with its prefix lengths groups the strings to the right of the anchors; a second sort
groups the bytes to the left; a string is a repeat if an earlier one lies in both groups.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .packs import bucket_count, known, look_up, pack_documents, place, repeated_keys, squeeze, texts_of, unsqueeze
from .rows import write_table

LENGTH = 100
GRAM = 32  # a power of two
# Occurrences from which on an anchor's strings are dealt out one by one.
HOT = 20_000
# Positions hashed at once, few enough for a processor's cache.
SLICE = 1 << 15

_NO_ID = np.int64(2**63 - 1)
_U = np.uint64


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTES = _scramble(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes (a power of two) at every position."""
    h, factor, reach = _BYTES[data], 0xD6E8FEB86659FD93, 1
    while reach < width:
        h = h[:-reach] * _U(factor) + h[reach:]
        factor = factor * factor % (1 << 64)
        reach *= 2
    return _scramble(h)


def anchors(data: np.ndarray, sizes: list[int], length: int, gram: int):
    """Anchors, the first and last start of the strings each stands for, and anchor hashes."""
    at, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(0, len(data) - length + 1, SLICE):
        where, h = _smallest(data[start : start + SLICE + length - 1], length, gram)
        at.append(where + start)
        hashes.append(h)
    at, hashes = np.concatenate(at), np.concatenate(hashes)
    inside = np.zeros(len(at) + 1, bool)
    end = 0
    for size in sizes:
        if size >= length:
            inside[end : end + size - length + 1] = True
        end += size
    starts = np.flatnonzero(inside)
    at, hashes = at[starts], hashes[starts]
    if not len(starts):
        return at, starts, starts, hashes
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], starts[new], starts[np.append(new[1:], len(starts)) - 1], hashes[new]


def _smallest(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For every string of ``length`` bytes the place of its smallest hash, and that hash."""
    h = rolling(data, gram)
    window = length - gram + 1
    # The position in the low half makes the first of equal hashes win.
    low = (h & _U(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    reach = 1
    while reach * 2 <= window:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    rest = window - reach
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    at = (low & _U(0xFFFFFFFF)).astype(np.int64)
    return at, h[at]


def _data(row: dict) -> np.ndarray:
    return np.frombuffer(b"".join(texts_of(row["body"], row["sizes"])), np.uint8)


def _keys(buckets: int, length: int, gram: int):
    def keys_of(row: dict):
        h = anchors(_data(row), row["sizes"], length, gram)[3]
        return np.unique(place(h, buckets), return_counts=True)

    return keys_of


def common(a: bytes, b: bytes, known_prefix: int) -> int:
    """Length of the common prefix, of which ``known_prefix`` bytes are not looked at again."""
    n = min(len(a), len(b))
    x, y = a[known_prefix:n], b[known_prefix:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - ((differ.bit_length() + 7) >> 3)


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """Sorted strings as prefix lengths, lengths and the rests."""
    shared, before = [], b""
    for s in strings:
        shared.append(common(before, s, 0))
        before = s
    rests = b"".join(s[k:] for s, k in zip(strings, shared))
    return (
        squeeze(np.array(shared, np.uint16)), squeeze(np.array([len(s) for s in strings], np.uint16)),
        zstandard.ZstdCompressor(level=3).compress(rests),
    )


def front_decode(coded: tuple[bytes, bytes, bytes]) -> tuple[list[bytes], list[int]]:
    shared, lengths = unsqueeze(coded[0], np.uint16).tolist(), unsqueeze(coded[1], np.uint16).tolist()
    rests = zstandard.ZstdDecompressor().decompress(coded[2])
    out, before, at = [], b"", 0
    for k, n in zip(shared, lengths):
        before = before[:k] + rests[at : at + n - k]
        at += n - k
        out.append(before)
    return out, shared


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[int], list[int], list[int]]:
    """Loser tree over sorted runs with known prefix lengths.

    Gives the run and place of each string in sorted order and its common prefix with the
    one before. Every contender knows its common prefix with the last winner it met: the
    longer one is the smaller string, and only equal ones are compared, from there on.
    """
    k = len(runs)
    heads = [r[0][0] if r[0] else None for r in runs]
    prefix, position = [0] * k, [0] * k
    losers = [-1] * k

    def play(challenger: int, node: int) -> int:
        """Carries the challenger up from ``node``; the winner at the top is returned."""
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = challenger
                return -1
            a, b = heads[challenger], heads[other]
            if b is None:
                pass
            elif a is None or prefix[other] > prefix[challenger]:
                losers[node], challenger = challenger, other
            elif prefix[other] == prefix[challenger]:
                n = common(a, b, prefix[other])
                if n < len(b) and (n == len(a) or a[n] < b[n]) or n == len(a) == len(b) and challenger < other:
                    prefix[other] = n
                else:
                    prefix[challenger] = n
                    losers[node], challenger = challenger, other
            node >>= 1
        return challenger

    winner = 0
    for leaf in range(k):
        top = play(leaf, (leaf + k) >> 1)
        if top >= 0:
            winner = top
    out_run, out_place, out_prefix = [], [], []
    while heads[winner] is not None:
        place_in = position[winner]
        out_run.append(winner)
        out_place.append(place_in)
        out_prefix.append(prefix[winner])
        strings, shared = runs[winner]
        position[winner] = place_in = place_in + 1
        if place_in < len(strings):
            heads[winner], prefix[winner] = strings[place_in], shared[place_in]
        else:
            heads[winner], prefix[winner] = None, -1
        winner = play(winner, (winner + k) >> 1)
    return out_run, out_place, out_prefix


def _run(entries: list[tuple]) -> bytes:
    """A sorted run as one value: right strings, left strings, first offset, ids, positions."""
    return pickle.dumps((
        front_code([e[0] for e in entries]),
        squeeze(np.array([len(e[1]) for e in entries], np.uint16)),
        zstandard.ZstdCompressor(level=3).compress(b"".join(e[1] for e in entries)),
        squeeze(np.array([e[2] for e in entries], np.uint16)),
        squeeze(np.array([e[3] for e in entries], np.int64)),
        squeeze(np.array([e[4] for e in entries], np.int64)),
    ))


def _intervals(starts, lengths) -> bytes:
    return pickle.dumps((squeeze(np.asarray(starts, np.int64)), squeeze(np.asarray(lengths, np.int32))))


def runs(packs: DataFrame, counts: DataFrame, buckets: int, length: int, gram: int, hot: int) -> DataFrame:
    """Rows (bucket, pack, value): sorted runs, and under bucket -1 repeats settled in a pack.

    A suffix with exactly the same bytes around it as an earlier one of the same pack is
    settled there, so a pack sends each only once. The strings of an anchor with very many
    occurrences are sent as suffixes of their own and spread by their own hash.
    """
    arrow = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("value", pa.binary())])

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_pylist([], schema=arrow)
        found, totals = known(right.to_pylist())
        row = left.to_pylist()[0]
        data = _data(row)
        at, first, last, h = anchors(data, row["sizes"], length, gram)
        placed = place(h, buckets)
        total = look_up(placed, found, totals)
        ids = np.array([_NO_ID if i is None else i for i in row["ids"]], np.int64)
        owner = np.searchsorted(np.cumsum(row["sizes"]), at, "right")
        raw = data.tobytes()
        by_bucket: dict[int, list] = {}

        def add(bucket, a, p, q):
            by_bucket.setdefault(bucket, []).append(
                (raw[a : q + length], raw[p:a][::-1], a - q, ids[own], a)
            )

        for k in np.flatnonzero(total > 1).tolist():
            own = owner[k]
            a, p, q = int(at[k]), int(first[k]), int(last[k])
            if total[k] < hot:
                add(int(placed[k] >> _U(32)), a, p, q)
            else:
                for s in range(p, q + 1):
                    whole = hashlib.blake2b(raw[s : s + length], digest_size=8).digest()
                    add(int.from_bytes(whole, "big") % buckets, s, s, s)
        out, starts, lengths = [], [], []
        for bucket, entries in by_bucket.items():
            entries.sort()
            kept = []
            for e in entries:
                if kept and kept[-1][:3] == e[:3]:
                    starts.append(e[4] - len(e[1]))
                    lengths.append(len(e[1]) - e[2] + length)
                else:
                    kept.append(e)
            out.append({"bucket": bucket, "pack": row["pack"], "value": _run(kept)})
        if starts:
            out.append({"bucket": -1, "pack": row["pack"], "value": _intervals(starts, lengths)})
        return pa.Table.from_pylist(out, schema=arrow)

    needed = packs.select("pack", "ids", "sizes", "body")
    return needed.groupBy("pack").cogroup(counts.groupBy("pack")).applyInArrow(cut, "bucket bigint, pack bigint, value binary")


def _repeats(values: list[tuple[int, bytes]], length: int) -> dict[int, tuple[list, list]]:
    """Per pack the byte intervals of repeated strings among the runs of one bucket."""
    packs, decoded, lefts, offsets, ids, places = [], [], [], [], [], []
    for pack, value in values:
        rights, left_sizes, left_bytes, offset, doc, at = pickle.loads(value)
        packs.append(pack)
        decoded.append(front_decode(rights))
        data, cut, own = zstandard.ZstdDecompressor().decompress(left_bytes), 0, []
        for n in unsqueeze(left_sizes, np.uint16).tolist():
            own.append(data[cut : cut + n])
            cut += n
        lefts.append(own)
        offsets.append(unsqueeze(offset, np.uint16))
        ids.append(unsqueeze(doc, np.int64))
        places.append(unsqueeze(at, np.int64))
    run, at, prefix = merge(decoded)
    n = len(run)
    base = np.cumsum([0] + [len(d[0]) for d in decoded])
    flat = base[np.array(run, np.int64)] + np.array(at, np.int64)
    prefix = np.array(prefix, np.int64)
    left = [lefts[r][k] for r, k in zip(run, at)]
    least = np.concatenate(offsets)[flat].astype(np.int64)
    most = np.array([len(x) for x in left], np.int64)
    doc, where = np.concatenate(ids)[flat], np.concatenate(places)[flat]
    pack = np.array(packs, np.int64)[np.array(run, np.int64)]
    # Rank in the order that says which of two equal strings came first.
    rank = np.empty(n, np.int64)
    rank[np.lexsort((where, pack, doc))] = np.arange(n)
    by_left = sorted(range(n), key=left.__getitem__)
    left_prefix = np.array([common(left[a], left[b], 0) for a, b in zip(by_left, by_left[1:])], np.int64)
    left_order = np.array(by_left, np.int64)
    repeat = np.zeros((n, length + 2), bool)
    for offset in range(int(least.min()), int(most.max()) + 1):
        right_group = np.cumsum(prefix < length - offset)
        left_group = np.empty(n, np.int64)
        left_group[left_order] = np.concatenate(([0], np.cumsum(left_prefix < offset)))
        here = np.flatnonzero((least <= offset) & (offset <= most))
        both = right_group[here] * (n + 1) + left_group[here]
        order = np.lexsort((rank[here], both))
        same = np.concatenate(([False], both[order][1:] == both[order][:-1]))
        repeat[here[order[same]], offset + 1] = True
    # Offsets count backwards from the anchor, so a stretch of offsets is a stretch of starts.
    edge = np.diff(repeat.astype(np.int8), axis=1)
    rows, lows = np.nonzero(edge == 1)
    _, highs = np.nonzero(edge == -1)
    out: dict[int, tuple[list, list]] = {}
    starts, lengths = where[rows] - (highs - 1), highs - 1 - lows + length
    for p in np.unique(pack[rows]):
        mine = pack[rows] == p
        out[int(p)] = (starts[mine], lengths[mine])
    return out


def repeats(sorted_runs: DataFrame, length: int) -> DataFrame:
    """Rows (pack, value) of byte intervals to remove, from merging each bucket's runs."""
    arrow = pa.schema([("pack", pa.int64()), ("value", pa.binary())])

    def resolve(table: pa.Table) -> pa.Table:
        pairs = sorted(zip(table.column("pack").to_pylist(), table.column("value").to_pylist()))
        found = _repeats(pairs, length)
        return pa.Table.from_pylist([{"pack": p, "value": _intervals(*v)} for p, v in found.items()], schema=arrow)

    merged = sorted_runs.where("bucket >= 0").groupBy("bucket").applyInArrow(resolve, "pack bigint, value binary")
    return merged.unionByName(sorted_runs.where("bucket < 0").select("pack", "value"))


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM,
    hot: int = HOT, with_kept: bool = True,
) -> DataFrame:
    """One row per document: id, bytes, removed stretches, kept digest and (if asked) kept bytes.

    Every byte covered by a string of ``length`` bytes that also starts earlier (smaller id,
    or earlier in the same document) is removed. Null text counts as empty; texts shorter
    than ``length`` stay whole. Null ids come last; rows that share an id are documents of
    their own, in the order they are stored. Kept bytes may end inside a character.
    """
    packs = pack_documents(docs, doc_id, text)
    buckets = bucket_count(packs)
    counts = repeated_keys(packs, _keys(buckets, length, gram), buckets)
    cut = runs(packs, counts, buckets, length, gram, hot)
    path = scratch_path(docs.sparkSession, "suffix-runs")
    found = repeats(write_table(cut, path, compression="none"), length)
    fields = [
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()),
        ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_sha256", pa.string()),
    ] + ([("kept", pa.binary())] if with_kept else [])
    arrow = pa.schema(fields)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            texts = texts_of(row["body"], row["sizes"])
            edge = np.zeros(sum(row["sizes"]) + 1, np.int32)
            for value in right.column("value").to_pylist():
                starts, lengths = pickle.loads(value)
                starts, lengths = unsqueeze(starts, np.int64), unsqueeze(lengths, np.int32)
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + lengths, -1)
            gone = np.cumsum(edge) > 0
            at = 0
            for i, t in zip(row["ids"], texts):
                mask = gone[at : at + len(t)]
                at += len(t)
                kept, stretches = t, []
                if mask.any():
                    turns = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
                    stretches = [{"start": int(a), "end": int(b)} for a, b in zip(turns[::2], turns[1::2])]
                    kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
                item = {"doc_id": i, "n_bytes": len(t), "removed": stretches, "kept_sha256": hashlib.sha256(kept).hexdigest()}
                out.append(item | ({"kept": kept} if with_kept else {}))
        return pa.Table.from_pylist(out, schema=arrow)

    schema = "doc_id bigint, n_bytes bigint, removed array<struct<start: bigint, end: bigint>>, kept_sha256 string"
    schema += ", kept binary" if with_kept else ""
    needed = packs.select("pack", "ids", "sizes", "body")
    return needed.groupBy("pack").cogroup(found.groupBy("pack")).applyInArrow(remove, schema)


def summary(result: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return result.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256"
    )
