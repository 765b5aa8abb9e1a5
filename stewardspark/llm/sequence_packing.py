"""Vector bin packing of examples into training sequences by the dot-product heuristic.

A sequence is limited in three dimensions at once: tokens, segments (pieces) and tokens that
bear loss. An open sequence takes, of the examples that fit whole in all dimensions, the one
whose demand has the largest dot product with what the sequence has left, each dimension
weighted by its limit. Where none fits, the head of the longest example is cut off to fill
it. An example longer than a sequence is cut into full pieces first.

Every task packs its own rows, a bounded pool of examples at a time, so nothing is shuffled
and no example is hot; a sequence that is not full goes back to the next pool. What remains
at a task's end, and a sequence that another limit closed early, is written as sequences
whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import column, ship

SEQUENCE_TOKENS = 2048
SEQUENCE_SEGMENTS = 64
END_ID = 1
# Examples, and tokens, that are packed against each other; an example with more tokens is a
# pool of its own.
POOL_EXAMPLES = 4096
POOL_TOKENS = 4 << 20
# Words whose ids a task remembers, and the longest such word.
MEMORY = 1 << 19
MEMORY_CHARS = 64
# Texts that are encoded at once.
SLICE = 256


class Limits(NamedTuple):
    """What one sequence may hold."""

    tokens: int = SEQUENCE_TOKENS
    segments: int = SEQUENCE_SEGMENTS
    loss: int = SEQUENCE_TOKENS


class Piece(NamedTuple):
    item: int
    start: int
    length: int


# -- token ids ------------------------------------------------------------------------------

_BLANK = re.compile(r"[\x20\x09-\x0D]+")
# Lower-case Latin-1 letters, or anything else that is not blank.
_RUNS = re.compile(r"[a-zªµºß-öø-ÿ]+|[^\x20\x09-\x0Da-zªµºß-öø-ÿ]+")


def parts(text: str) -> list[str]:
    """Pieces of a text whose ids, one after another, are those of the text.

    The tokenizer lower-cases and never joins what blanks part, nor a letter and anything
    else but the apostrophe of a contraction. Texts with apostrophes or with characters
    outside Latin-1, whose lower case may depend on more than themselves, are cut at blanks.
    """
    if "'" not in text:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return _BLANK.split(text)
        return _RUNS.findall(text.lower())
    return _BLANK.split(text)


class Encoder:
    """Ids of texts, remembered by their parts."""

    def __init__(self, path: str | None = None, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        # The names of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.memory = memory

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit numbers."""
        cut = [parts(t) for t in texts]
        known = self.known
        new = self._encode(set().union(*cut).difference(known))
        known.update(new)
        out = [b"".join(map(known.__getitem__, words)) for words in cut]
        for w in new:
            if len(w) > MEMORY_CHARS:
                del known[w]
        if len(known) > self.memory:
            known.clear()
        return out

    def _encode(self, words: set[str]) -> dict[str, bytes]:
        order = sorted(words)
        found = self.tokenizer.encode_batch_fast(order, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(order, found)}


# A worker keeps it from task to task.
_encoder = functools.lru_cache(maxsize=1)(Encoder)


def _texts(docs: DataFrame, doc_id: str, text: str, prompt: str | None) -> DataFrame:
    before = F.coalesce(column(prompt), F.lit("")) if prompt else F.lit("")
    return docs.select(column(doc_id).alias("id"), before.alias("prompt"), F.coalesce(column(text), F.lit("")).alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], path: str | None, end: int) -> Iterator[pa.RecordBatch]:
    encoder, last = _encoder(path), np.array([end], "<u4").tobytes()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            batch = whole.slice(at, SLICE)
            first = encoder(batch.column(1).to_pylist())
            rest = encoder(batch.column(2).to_pylist())
            ids = pa.array([a + b + last for a, b in zip(first, rest)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), ids, pa.array([len(a) // 4 for a in first], pa.int64())], names=["id", "ids", "n_prompt"]
            )


def tokens(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None, path: str | None = None,
    end: int = END_ID,
) -> DataFrame:
    """Rows (id, ids, n_prompt): the ids of prompt and text, then the end id.

    Null texts are empty; every row is an example, also if ids repeat or are null. The first
    ``n_prompt`` ids bear no loss. ``ids`` holds little-endian 32-bit numbers; ``path`` names
    a tokenizer file, the public word-level one if left out.
    """
    ship(docs.sparkSession)
    rows = _texts(docs, doc_id, text, prompt)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda batches: _encoded(batches, path, end), f"id {kind}, ids binary, n_prompt bigint")


# -- packing ----------------------------------------------------------------------------------


def _whole(pieces: list[tuple[int, int, int, int]], limits: Limits) -> tuple[list[list[Piece]], list[tuple[int, int, int, int]]]:
    """Full sequences cut from examples longer than one, and what is left of the examples.

    An example is (item, start, tokens, tokens before those that bear loss).
    """
    full, rest = [], []
    for item, start, n, prompt in pieces:
        while n > 0 and min(n, prompt + limits.loss) >= limits.tokens:
            full.append([Piece(item, start, limits.tokens)])
            start, n, prompt = start + limits.tokens, n - limits.tokens, max(0, prompt - limits.tokens)
        if n:
            rest.append((item, start, n, prompt))
    return full, rest


def sequences(examples: list[tuple[int, int, int, int]], limits: Limits) -> tuple[list[list[Piece]], list[tuple[int, int, int, int]]]:
    """Sequences of pieces, and the pieces of one that the pool could not fill any more."""
    done, rest = _whole(examples, limits)
    item, start, n, prompt = (np.array(c, np.int64) for c in zip(*rest)) if rest else (np.zeros(0, np.int64),) * 4
    while len(n):
        left, pieces = list(limits), []
        while left[0] and left[1]:
            loss = n - np.minimum(prompt, n)
            fits = (n > 0) & (n <= left[0]) & (loss <= left[2])
            if fits.any():
                # The segment term is the same for every example: each is one segment more.
                score = n * (left[0] / limits.tokens**2) + loss * (left[2] / limits.loss**2) + left[1] / limits.segments**2
                k = int(np.argmax(np.where(fits, score, -1.0)))
                length = int(n[k])
            else:
                head = np.minimum(np.minimum(n, left[0]), np.minimum(prompt, n) + left[2])
                k = int(np.lexsort((n, head))[-1])
                length = int(head[k])
                if length <= 0:
                    break
            pieces.append((int(item[k]), int(start[k]), length, min(int(prompt[k]), length)))
            left[0] -= length
            left[1] -= 1
            left[2] -= length - pieces[-1][3]
            start[k] += length
            n[k] -= length
            prompt[k] = max(0, prompt[k] - length)
        if 2 * int((n > 0).sum()) <= len(n):
            keep = n > 0
            item, start, n, prompt = item[keep], start[keep], n[keep], prompt[keep]
        if left[0] and left[1] and left[2] and not len(n):
            return done, pieces
        done.append([Piece(*p[:3]) for p in pieces])
    return done, []


def powers_of_two(pieces: list[Piece]) -> list[list[Piece]]:
    """The pieces as sequences whose lengths are the powers of two in their sum, largest first."""
    total, out, queue = sum(p.length for p in pieces), [], list(reversed(pieces))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            p = queue.pop()
            taken = min(room, p.length)
            out[-1].append(Piece(p.item, p.start, taken))
            room -= taken
            if taken < p.length:
                queue.append(Piece(p.item, p.start + taken, p.length - taken))
    return out


def _ready(done: list[list[Piece]], limits: Limits) -> Iterator[list[Piece]]:
    for pieces in done:
        if sum(p.length for p in pieces) == limits.tokens:
            yield pieces
        else:
            yield from powers_of_two(pieces)


def _packed(batches: Iterator[pa.RecordBatch], limits: Limits, pool: int, pool_tokens: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 33
    # Of the examples that are not packed yet: id, ids and length of the prompt.
    held: dict[int, tuple] = {}
    waiting, size, rest, kind, count = [], 0, [], None, 0

    def rows(done: list[list[Piece]]) -> pa.RecordBatch:
        nonlocal number
        out = [[] for _ in _PIECES]
        for pieces in _ready(done, limits):
            offset = 0
            for p in pieces:
                name, ids, prompt = held[p.item]
                end = p.start + p.length
                row = (name, p.start, ids[4 * p.start : 4 * end], max(0, end - max(p.start, prompt)), len(ids) // 4, number, offset)
                for values, v in zip(out, row):
                    values.append(v)
                offset += p.length
            number += 1
        kinds = [kind, *(pa.binary() if c == "ids" else pa.int64() for c in _PIECES[1:])]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=_PIECES)

    def flush(last: bool = False) -> pa.RecordBatch:
        nonlocal waiting, size, rest
        done, open_pieces = sequences(rest + waiting, limits)
        if last and open_pieces:
            done.append([Piece(*p[:3]) for p in open_pieces])
            open_pieces = []
        made = rows(done)
        # What goes back to the pool keeps the place it was cut at.
        rest, waiting, size = open_pieces, [], sum(p[2] for p in open_pieces)
        for item in set(held) - {p[0] for p in rest}:
            del held[item]
        return made

    for batch in batches:
        kind = batch.schema.field(0).type
        for name, ids, prompt in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            data = ids.as_py()
            held[count] = (name.as_py(), data, prompt)
            waiting.append((count, 0, len(data) // 4, min(prompt, len(data) // 4)))
            size += len(data) // 4
            count += 1
            if len(waiting) >= pool or size >= pool_tokens:
                yield flush()
    if held:
        yield flush(last=True)


_PIECES = ["id", "start", "ids", "n_loss", "example_tokens", "sequence_id", "offset"]


def _schema(rows: DataFrame) -> str:
    kind = rows.schema["id"].dataType.simpleString()
    return f"id {kind}, " + ", ".join(f"{c} {'binary' if c == 'ids' else 'bigint'}" for c in _PIECES[1:])


def _checked(limits: Limits) -> None:
    if min(limits) < 1:
        raise ValueError(f"limits have to be positive: {limits}")


def pack(
    examples: DataFrame, limits: Limits = Limits(), pool: int = POOL_EXAMPLES, pool_tokens: int = POOL_TOKENS
) -> DataFrame:
    """One row per piece of the examples (id, ids, n_prompt), see ``tokens``.

    ``id``, ``start`` (ids of the example before the piece), ``ids`` of the piece, ``n_loss``
    (those that bear loss), ``example_tokens``, ``sequence_id`` and ``offset`` in it. Every id
    lies in one piece, the pieces of a sequence follow each other without gaps, and each
    sequence keeps all limits. An example without ids gives no row.
    """
    _checked(limits)
    ship(examples.sparkSession)
    rows = examples.select("id", "ids", "n_prompt")
    return rows.mapInArrow(lambda batches: _packed(batches, limits, pool, pool_tokens), _schema(rows))


def pack_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", prompt: str | None = None, path: str | None = None,
    end: int = END_ID, limits: Limits = Limits(),
) -> DataFrame:
    """``pack`` of the ``tokens`` of texts, both in one pass of a task over its rows."""
    _checked(limits)
    ship(docs.sparkSession)
    rows = _texts(docs, doc_id, text, prompt)
    return rows.mapInArrow(
        lambda batches: _packed(_encoded(batches, path, end), limits, POOL_EXAMPLES, POOL_TOKENS), _schema(rows)
    )


def summary(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        F.col("id").alias("doc_id"), "start", F.expr("CAST(octet_length(ids) DIV 4 AS BIGINT)").alias("length"),
        F.crc32("ids").alias("ids_crc32"), F.col("example_tokens").alias("doc_tokens"), "sequence_id", "offset", "n_loss",
    )
