"""Spelling variants by search in frequency-vector tries.

A word is arranged by the counts of its letter groups, level by level. Words that differ by
one inserted, deleted or replaced letter have counts with at most one surplus and one deficit,
so a depth-first search that spends a budget of one each meets all of them; the words at the
leaves it reaches are verified letter by letter.

The trie is dealt out by its upper levels, counts of a few coarse groups: all words with the
same coarse counts are one shard, built in one task, and a word asks the shards that lie
within the budget. Each pair of words is met once: a longer word asks for the shorter one, and
of two equally long words the one with the surplus in the lower group asks for the other. The number of
coarse groups follows the largest shard; what is still too large is dealt into blocks, every
block of words against every block of queries.

Words are counted per task before they are exchanged, so a frequent word is a row per task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import column, ship
from .work import Work

LEAST_LETTERS = 6
LEAST_COUNT = 5
# A near word with so many times the occurrences is a word's form.
RATIO = 5
# One of so many runs of letters loses a letter, by its checksum.
THINNED = 199
# Letter groups of a trie's own levels, and of the levels by which it is dealt out.
GROUPS = 26
COARSE = (3, 6, 12)
# Words and queries of one task; larger shards are dealt into blocks.
SHARD_WORDS = 60_000
SHARD_QUERIES = 100_000
# Distinct words that a task counts before it sends them.
HELD_WORDS = 200_000
# Paths that are followed at once, and letters that are compared at once.
PATHS = 1 << 15
WIDE = 64

_LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256)
)


def runs(text: str) -> list[bytes]:
    """The runs of letters in Latin-1, a byte per letter, with A-Z in lower case.

    Characters outside Latin-1 become one byte that is no letter.
    """
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def thinned(prefix: int, word: bytes) -> bytes:
    """The run, or the run without one letter if its checksum says so."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), prefix)
    if h % THINNED:
        return word
    cut = h % len(word)
    return word[:cut] + word[cut + 1 :]


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """(word, n): the words of at least ``least`` letters with their occurrences.

    A null text has no words; a null id counts as an empty one in the checksum.
    """
    ship(docs.sparkSession)
    rows = docs.where(column(text).isNotNull()).select(
        F.coalesce(column(doc_id).cast("string"), F.lit("")).alias("i"), column(text).alias("t")
    )

    def count(batches: Iterator[pa.RecordBatch]):
        held: Counter = Counter()

        def flush():
            words = [w.decode("latin-1") for w in held]
            made = pa.RecordBatch.from_pydict({"word": words, "n": list(held.values())}, schema=arrow)
            held.clear()
            return made

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                prefix = zlib.crc32(f"{i}:".encode())
                for word, n in Counter(runs(t.as_py())).items():
                    if len(word) >= least:
                        held[thinned(prefix, word)] += n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    arrow = pa.schema([("word", pa.string()), ("n", pa.int64())])
    parts = rows.mapInArrow(count, "word string, n bigint")
    return parts.where(F.length("word") >= least).groupBy("word").agg(F.sum("n").alias("n"))


# -- one shard ------------------------------------------------------------------------------


def vectors(words: list[bytes], groups: int = GROUPS) -> np.ndarray:
    """Per word how often a letter of each group occurs; a letter's group is its number modulo ``groups``."""
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) % groups
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    return np.bincount(owner * groups + letters, minlength=len(words) * groups).reshape(len(words), groups)


class Trie:
    """Words under their frequency vectors, a level per letter group."""

    def __init__(self, vecs: np.ndarray):
        self.order = np.lexsort(vecs.T[::-1])
        ranked = vecs[self.order]
        self.base = int(vecs.max(initial=0)) + 2
        node = np.zeros(len(vecs), np.int64)
        self.levels = []
        for k in range(vecs.shape[1]):
            key = node * self.base + ranked[:, k]
            new = np.diff(key, prepend=-1) != 0
            self.levels.append(key[new])
            node = np.cumsum(new) - 1
        self.ends = np.append(np.flatnonzero(np.diff(node, prepend=-1)), len(vecs))

    def search(self, vecs: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, word) within the budgets; the paths go deepest first, block by block."""
        zero = np.zeros(len(vecs), np.int64)
        stack = [(0, np.arange(len(vecs)), zero, surplus.astype(bool), deficit.astype(bool))]
        while stack:
            level, query, node, more, less = stack.pop()
            if len(query) > PATHS:
                half = len(query) // 2
                stack += [(level, *(x[s] for x in (query, node, more, less))) for s in (slice(half, None), slice(half))]
                continue
            if level == len(self.levels):
                first, size = self.ends[node], self.ends[node + 1] - self.ends[node]
                inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                yield np.repeat(query, size), self.order[np.repeat(first, size) + inside]
                continue
            keys, steps = self.levels[level], []
            wanted = vecs[query, level]
            for change, may in ((0, None), (1, more), (-1, less & (wanted > 0))):
                at = np.arange(len(query)) if may is None else np.flatnonzero(may)
                key = node[at] * self.base + np.minimum(wanted[at] + change, self.base - 1)
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                met = keys[place] == key
                at, place = at[met], place[met]
                steps.append((query[at], place, more[at] & (change != 1), less[at] & (change != -1)))
            joined = [np.concatenate(x) for x in zip(*steps)]
            if len(joined[0]):
                stack.append((level + 1, *joined))


def _near(a: bytes, b: bytes) -> bool:
    """Whether one insertion, deletion or replacement makes one word of the other."""
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:])


def verified(queries: list[bytes], words: list[bytes], pairs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which pairs differ by one letter; a query is as long as the word or one letter longer."""
    q, w = pairs
    size_q, size_w = (np.array([len(x) for x in y], np.int64) for y in (queries, words))
    out = np.zeros(len(q), bool)
    long = (size_q[q] > WIDE - 2) | (size_w[w] > WIDE - 2)
    for k in np.flatnonzero(long):
        out[k] = _near(queries[q[k]], words[w[k]])
    left, right = (np.array([x[:WIDE] for x in y], f"S{WIDE}").view(np.uint8).reshape(-1, WIDE) for y in (queries, words))
    short = np.flatnonzero(~long)
    for start in range(0, len(short), PATHS):
        here = short[start : start + PATHS]
        a, b = left[q[here]], right[w[here]]
        differ = a != b
        same_size = size_q[q[here]] == size_w[w[here]]
        first = differ.argmax(axis=1)
        moved = (a[:, 1:] == b[:, :-1]) | (np.arange(WIDE - 1) < first[:, None])
        out[here] = np.where(same_size, differ.sum(axis=1) == 1, moved.all(axis=1))
    return out


# -- all shards --------------------------------------------------------------------------------

_OWN, _REPLACED, _SHORTER = 0, 1, 2


def _shard(counts) -> str:
    return ",".join(map(str, counts))


def _routes(words: DataFrame, coarse: int) -> DataFrame:
    """(shard, kind, word, n): a word in its own shard, and where it asks for near words."""
    arrow = pa.schema([("shard", pa.string()), ("kind", pa.int8()), ("word", pa.string()), ("n", pa.int64())])

    def route(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names = batch.column(0).to_pylist()
            out = [[], [], [], []]
            if names:
                for word, n, counts in zip(names, batch.column(1).to_pylist(), vectors([w.encode("latin-1") for w in names], coarse).tolist()):
                    made = [(_shard(counts), _OWN)]
                    for i in range(coarse):
                        if counts[i]:
                            counts[i] -= 1
                            made.append((_shard(counts), _SHORTER))
                            for j in range(i + 1, coarse):
                                counts[j] += 1
                                made.append((_shard(counts), _REPLACED))
                                counts[j] -= 1
                            counts[i] += 1
                    for shard, kind in made:
                        for values, v in zip(out, (shard, kind, word, n)):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return words.select("word", "n").mapInArrow(route, "shard string, kind tinyint, word string, n bigint")


def _coarse(words: DataFrame, choices: tuple[int, ...], shard_words: int) -> int:
    """The smallest number of coarse groups whose largest shard fits a task, else the largest."""
    letters = F.transform(F.split("word", ""), lambda c: F.ascii(c))

    def held(groups: int, k: int):
        return F.size(F.filter("letters", lambda c: c % groups == k)).cast("string")

    for groups in choices[:-1]:
        largest = (
            words.select(letters.alias("letters"))
            .select(F.concat_ws(",", *[held(groups, k) for k in range(groups)]).alias("shard"))
            .groupBy("shard").count().agg(F.max("count")).first()[0]
        )
        if (largest or 0) <= shard_words:
            return groups
    return choices[-1]


def near_words(
    work: Work, words: DataFrame, coarse: tuple[int, ...] = COARSE, shard_words: int = SHARD_WORDS,
    shard_queries: int = SHARD_QUERIES,
) -> DataFrame:
    """(word, n_near, form, form_n): the near words of a word, and the most frequent of them.

    ``words`` are (word, n) in Latin-1 letters. Ties go to the smallest word in code-point
    order. Words without a near one are left out.
    """
    ship(words.sparkSession)
    routed = work.keep(_routes(words, _coarse(words, coarse, shard_words)))
    sizes = routed.groupBy("shard").agg(F.count_if(F.col("kind") == _OWN).alias("words"), F.count("*").alias("queries"))
    # A shard without words has nobody to answer.
    sizes = sizes.where("words > 0").select(
        "shard", F.ceil(F.col("words") / shard_words).alias("wb"), F.ceil(F.col("queries") / shard_queries).alias("qb")
    )
    placed = routed.join(sizes, "shard")
    draw = F.xxhash64("word")
    asked = placed.select(
        "shard", "kind", "word", "n", F.explode(F.sequence(F.lit(0), F.col("wb") - 1)).alias("w"), F.pmod(draw, "qb").alias("q")
    )
    held = placed.where(F.col("kind") == _OWN).select(
        "shard", F.lit(-1).cast("tinyint").alias("kind"), "word", "n", F.pmod(draw, "wb").alias("w"),
        F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"),
    )
    arrow = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form", pa.string()), ("form_n", pa.int64())])

    def search(table: pa.Table) -> pa.Table:
        kind, names, n = table.column("kind").to_numpy(), table.column("word").to_pylist(), table.column("n").to_numpy()
        raw = [w.encode("latin-1") for w in names]
        inside, asking = np.flatnonzero(kind == -1), np.flatnonzero(kind != -1)
        if not len(inside) or not len(asking):
            return arrow.empty_table()
        trie = Trie(vectors([raw[k] for k in inside]))
        queries, words_here = [raw[k] for k in asking], [raw[k] for k in inside]
        full, own = kind[asking] != _SHORTER, kind[asking] == _OWN
        rank = np.unique(np.array(raw, object), return_inverse=True)[1]
        found: dict[int, list] = {}
        for q, w in trie.search(vectors(queries), full, np.ones(len(asking), bool)):
            # In their own shard two words meet twice; the smaller one asks.
            once = ~own[q] | (rank[asking[q]] < rank[inside[w]])
            q, w = q[once], w[once]
            good = verified(queries, words_here, (q, w))
            for a, b in zip(asking[q[good]].tolist(), inside[w[good]].tolist()):
                for one, other in ((a, b), (b, a)):
                    best = (-int(n[other]), names[other])
                    if one in found:
                        found[one][0] += 1
                        found[one][1] = min(found[one][1], best)
                    else:
                        found[one] = [1, best]
        return pa.Table.from_pylist(
            [{"word": names[k], "n_near": c, "form": best[1], "form_n": -best[0]} for k, (c, best) in found.items()], schema=arrow
        )

    parts = asked.unionByName(held).groupBy("shard", "w", "q").applyInArrow(search, "word string, n_near bigint, form string, form_n bigint")
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", "best.form", (-F.col("best.less")).alias("form_n")
    )


def roots(work: Work, forms: DataFrame) -> DataFrame:
    """(word, root): the end of each word's chain of forms; every round doubles its steps.

    ``forms`` are (word, form). A form is more frequent than its word, so chains end.
    """
    known = work.keep(forms.select("word", F.coalesce("form", "word").alias("root")))
    while True:
        step = work.keep(
            known.join(known.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
            .select("word", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved"))
        )
        known = step.select("word", "root")
        if step.where("moved").isEmpty():
            return known


def groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT, ratio: int = RATIO, **limits,
) -> DataFrame:
    """One row per word: ``word``, ``form``, ``root``, ``n``, ``n_near`` and ``form_n``.

    A word is a run of Latin letters of at least ``least_letters`` that occurs ``least_count``
    times or more in the whole corpus. Its form is the most frequent of its near words, if
    that has ``ratio`` times its occurrences; its root is the last of the forms. Repeated
    rows count as often as they occur; a table without such words gives no rows.
    """
    work = Work(docs.sparkSession, "spelling")
    words = work.keep(counted(docs, doc_id, text, least_letters).where(F.col("n") >= least_count))
    near = near_words(work, words, **limits)
    often = F.col("form_n") >= ratio * F.col("n")
    chosen = work.keep(
        words.join(near, "word", "left").select(
            "word", F.when(often, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(often, F.col("form_n")).alias("form_n"),
        )
    )
    return work.end(
        chosen.join(roots(work, chosen.where("form IS NOT NULL")), "word", "left")
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    )


def check_sql(documents: str = "documents") -> str:
    """The same rows: near words meet under the words with one letter cut out or masked."""
    return f"""WITH RECURSIVE
crc AS (SELECT list(list_reduce([x] || range(8), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) ORDER BY x) AS v FROM range(256) AS r(x)),
d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM {documents}),
l AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM d GROUP BY ALL),
h AS (SELECT r, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || r)) AS x FROM l WHERE length(r) >= {LEAST_LETTERS}),
c AS (SELECT r, n, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: ('0x' || x[i:i + 1])::BIGINT),
  lambda a, b: xor(a >> 8, v[(xor(a, b) & 255) + 1])), 4294967295) AS k FROM h, crc),
t AS (SELECT CASE WHEN k % {THINNED} = 0 THEN r[1:k % length(r)] || r[k % length(r) + 2:] ELSE r END AS word, n FROM c),
w AS (SELECT word, sum(n)::BIGINT AS n FROM t WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
m AS (SELECT word, word[1:i - 1] || '_' || word[i + 1:] AS masked, word[1:i - 1] || word[i + 1:] AS cut FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
s AS (SELECT a.word, b.word AS near FROM m AS a JOIN m AS b USING (masked) WHERE a.word <> b.word),
x AS (SELECT m.word, w.word AS near FROM m JOIN w ON w.word = m.cut),
p AS (SELECT word, near FROM s UNION SELECT word, near FROM x UNION SELECT near, word FROM x),
b AS (SELECT p.word, count(*) AS n_near, first(near ORDER BY w.n DESC, near) AS best, max(w.n) AS top FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {RATIO} * w.n THEN best END AS form,
  CASE WHEN top >= {RATIO} * w.n THEN top END AS form_n FROM w LEFT JOIN b USING (word)),
g(word, reached) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.reached WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.reached AS root, f.n, f.n_near, f.form_n FROM f JOIN g ON g.word = f.word
WHERE g.reached IN (SELECT word FROM f WHERE form IS NULL)"""
