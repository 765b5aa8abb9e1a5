"""Documents in packs, and keys that occur more than once in the corpus.

A pack is one row with the ids and the compressed texts of a few megabytes of documents,
written once to the shared folder, so that later passes read and move little and number
rows in a way that does not change. ``repeated_keys`` exchanges the hashed keys of all packs
bucket by bucket and tells every pack which of its keys occur elsewhere too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path
from .rows import column, ship

PACK_BYTES = 2 << 20
PACK_DOCUMENTS = 1 << 16
# Text whose keys meet in one bucket; a bucket is held in memory by one task.
BUCKET_BYTES = 8 << 20

_SCHEMA = "ids array<bigint>, sizes array<bigint>, note binary, body binary"


def pack_documents(
    docs: DataFrame, doc_id: str, text: str, note: Callable[[list[bytes]], bytes] | None = None,
    pack_bytes: int = PACK_BYTES, folder: str | None = None,
) -> DataFrame:
    """Columns ``pack``, ``ids``, ``sizes`` (bytes), ``note`` and ``body``.

    Null texts count as empty, null ids stay null, every row is kept. ``note`` may add what
    a later pass needs of the texts. A text longer than ``pack_bytes`` is a pack of its own.
    """
    ship(docs.sparkSession)
    rows = docs.select(column(doc_id).cast("bigint").alias("i"), F.coalesce(column(text), F.lit("")).cast("binary").alias("t"))

    def pack(batches):
        ids, texts, size = [], [], 0

        def full():
            body = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
            return pa.RecordBatch.from_pylist(
                [{"ids": ids, "sizes": [len(t) for t in texts], "note": note(texts) if note else b"", "body": body}],
                schema=arrow,
            )

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(i)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= pack_bytes or len(ids) == PACK_DOCUMENTS:
                    yield full()
                    ids, texts, size = [], [], 0
        if ids:
            yield full()

    arrow = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("note", pa.binary()), ("body", pa.binary())])
    spark = docs.sparkSession
    path = f"{folder}/packs" if folder else scratch_path(spark, "packs")
    # The number is fixed by being written; a task that runs again writes its own file anew.
    number = F.expr("shiftleft(shiftright(m, 33), 20) + (m & 1048575)")
    packed = rows.mapInArrow(pack, _SCHEMA).withColumn("m", F.monotonically_increasing_id())
    packed.withColumn("pack", number).drop("m").write.option("compression", "none").parquet(path)
    return spark.read.schema(f"{_SCHEMA}, pack bigint").parquet(path)


def texts_of(body: bytes, sizes: list[int]) -> list[bytes]:
    data = zstandard.ZstdDecompressor().decompress(body, max_output_size=max(1, sum(sizes)))
    out, at = [], 0
    for n in sizes:
        out.append(data[at : at + n])
        at += n
    return out


def bucket_count(packs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    total = packs.select(F.explode("sizes").alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(1, -(-total // bucket_bytes))


def place(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket in the high and 32 bits of the key in the low half; distinct keys may meet."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (keys & np.uint64(0xFFFFFFFF))


def squeeze(values: np.ndarray) -> bytes:
    """Compressed little-endian numbers, byte planes apart."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueeze(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def _deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def repeated_keys(
    packs: DataFrame, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], buckets: int
) -> DataFrame:
    """Rows (pack, bucket, keys, counts) of the keys with a total count of two or more.

    ``keys_of`` gives the placed keys of a pack, sorted and distinct, and their counts. Only
    32 bits per key travel, as compressed differences; keys that share them count together,
    so a key may seem repeated that is not, never the other way round. A pack sends a key
    once, however often it holds it, so no key is hot. Counts saturate at 65535.
    """

    def send(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = keys_of(row)
                which = (keys >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(which, prepend=-1)).tolist() + [len(keys)]
                out = []
                for a, b in zip(cuts, cuts[1:]):
                    out.append({
                        "bucket": int(which[a]), "pack": row["pack"],
                        "keys": squeeze(_deltas((keys[a:b] & np.uint64(0xFFFFFFFF)).astype(np.uint32))),
                        "counts": squeeze(np.minimum(counts[a:b], 65535).astype(np.uint16)),
                    })
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    def count(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        owners = table.column("pack").to_pylist()
        keys = [np.cumsum(unsqueeze(k.as_py(), np.uint32), dtype=np.uint32) for k in table.column("keys")]
        counts = [unsqueeze(c.as_py(), np.uint16) for c in table.column("counts")]
        ends = np.cumsum([len(k) for k in keys])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
        total = np.add.reduceat(np.concatenate(counts).astype(np.int64)[order], np.flatnonzero(new))
        mine = np.empty(len(every), np.int64)
        mine[order] = total[np.cumsum(new) - 1]
        out = []
        for owner, ks, a, b in zip(owners, keys, np.concatenate(([0], ends)), ends):
            t = mine[a:b]
            keep = t > 1
            if keep.any():
                out.append({
                    "bucket": bucket, "pack": owner, "keys": squeeze(_deltas(ks[keep])),
                    "counts": squeeze(np.minimum(t[keep], 65535).astype(np.uint16)),
                })
        return pa.Table.from_pylist(out, schema=arrow)

    arrow = pa.schema([("bucket", pa.int64()), ("pack", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
    schema = "bucket bigint, pack bigint, keys binary, counts binary"
    sent = packs.mapInArrow(send, schema)
    return sent.groupBy("bucket").applyInArrow(count, schema)


def known(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Placed keys, sorted, and total counts from the rows of one pack."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for r in sorted(rows, key=lambda r: r["bucket"]):
        low = np.cumsum(unsqueeze(r["keys"], np.uint32), dtype=np.uint32).astype(np.uint64)
        keys.append(np.uint64(r["bucket"] << 32) | low)
        counts.append(unsqueeze(r["counts"], np.uint16).astype(np.int64))
    return np.concatenate(keys), np.concatenate(counts)


def look_up(keys: np.ndarray, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Total count per placed key, one where it is not repeated."""
    if not len(found):
        return np.ones(len(keys), np.int64)
    at = np.minimum(np.searchsorted(found, keys), len(found) - 1)
    return np.where(found[at] == keys, counts[at], 1)
