"""Spelling variants, conversation prefix tries and sequence packing against plain versions."""

import random
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stewardspark.llm import prefix_trie, sequence_packing, spelling
from stewardspark.llm.work import Work
from stewardspark.sources.driver_tables import DRIVER_SCHEMAS, read_driver

SF = "/root/testdata/sf0.001"


def rows_of(df, *columns):
    return ordered(tuple(r) for r in df.select(*columns or df.columns).collect())


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, str(v)) for v in r))


# -- spelling variants --------------------------------------------------------------------

FORMS = ("word", "form", "root", "n", "n_near", "form_n")


def test_spelling_variants_of_the_corpus(corpus):
    frame, rows = corpus
    assert rows_of(spelling.groups(frame), *FORMS) == ordered(brute.spelling([(r.doc_id, r.text) for r in rows]))


@pytest.fixture(scope="module")
def misspelt():
    """Words around a few centres, words longer than what is compared at once, and odd rows."""
    draw = random.Random(3)
    centres = ["receive", "separate", "Éléphants", "ÀÉÎÕÜß", "accommodate", "x" * 70, "ab" * 40, "aaaaaa", "aaaaaaa"]
    texts = [" ".join([c] * 40) for c in centres] + ["x" * 69 + " " + "x" * 71, None, "", "a b c 1 2 3", "東京 receive東京separate"]
    for c in centres * 8:
        k = draw.randrange(len(c))
        texts.append(" ".join([c[:k] + draw.choice(["", "e", "é", c[k] + "s"]) + c[k + 1 :]] * draw.choice([1, 5, 6, 9])))
    texts += ["receives receivez"] * 300 + ["recieve"] * 5
    return [(None if i % 17 == 0 else i % 60, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("limits", [{}, {"coarse": (1,)}, {"coarse": (1, 2), "shard_words": 5, "shard_queries": 4}])
def test_spelling_variants_of_odd_rows(spark, misspelt, limits):
    frame = spark.createDataFrame(misspelt, "doc_id bigint, text string")
    for name in ("word", "n", "shard", "kind", "form"):
        frame = frame.withColumn(name, F.lit(7))
    assert rows_of(spelling.groups(frame, **limits), *FORMS) == ordered(brute.spelling(misspelt))


def test_spelling_variants_of_nothing(nothing, odd):
    assert spelling.groups(nothing).collect() == []
    frame, rows = odd
    assert rows_of(spelling.groups(frame), *FORMS) == ordered(brute.spelling([(r[0], r[1]) for r in rows]))


def test_spelling_chains(spark):
    """Forms follow each other; the root is the last."""
    words = {"letter": 5, "letters": 25, "lettters": 125, "letttters": 625}
    text = " ".join(w for w, n in words.items() for _ in range(n))
    frame = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    found = {r["word"]: r["root"] for r in spelling.groups(frame).collect()}
    assert found == dict.fromkeys(words, "letttters")


def test_coarse_groups_follow_the_largest_shard(spark):
    words = [f"{a}{b}été" for a in "abcdefgh" for b in ("ab", "cd", "éa", "zz")]
    frame = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    largest = {
        k: max(Counter(map(tuple, spelling.vectors([w.encode("latin-1") for w in words], k).tolist())).values()) for k in (1, 2, 3)
    }
    assert largest[1] > largest[2] >= largest[3]
    for k in (1, 2, 3):
        assert spelling._coarse(frame, (1, 2, 3, 9), largest[k]) == min(j for j in largest if largest[j] <= largest[k])
    assert spelling._coarse(frame, (1, 2, 3, 9), 0) == 9


def test_trie_search_meets_every_near_vector():
    draw = random.Random(5)
    words = sorted({"".join(draw.choices("abcd", k=draw.randrange(3, 8))).encode() for _ in range(400)})
    trie = spelling.Trie(spelling.vectors(words))
    all_true = np.ones(len(words), bool)
    met = {(int(a), int(b)) for q, w in trie.search(spelling.vectors(words), all_true, all_true) for a, b in zip(q, w)}
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            if spelling._near(a, b):
                assert (i, j) in met


# -- conversation prefixes --------------------------------------------------------------------

NODES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def check_conversations(frame, rows, **options):
    got = rows_of(prefix_trie.summary(frame, **options), *NODES)
    assert got == ordered(brute.prefixes(brute.spliced(rows)))


def test_prefixes_of_the_conversations(spark):
    frame = read_driver(spark, SF, "conversations")
    check_conversations(frame, [tuple(r) for r in frame.collect()])


@pytest.mark.parametrize("width", [1, 2, 6])
def test_prefixes_of_odd_conversations(spark, width):
    draw = random.Random(4)
    rows = [(None, 0, "user", "no conversation"), (7, None, None, None), (7, None, "user", ""), (7, 3, "user", "same"), (7, 3, "user", "same")]
    # Copies of one conversation, long ones that part late, conversations that end inside others, gaps and ties.
    rows += [(c, t, "user", f"turn {t}") for c in range(100, 130) for t in range(5)]
    rows += [(c, t, "user" if t % 2 else "bot", f"long {t if t < 13 else (t, c % 3)}") for c in range(200, 208) for t in range(17)]
    rows += [(c, t, "user", "é🙂" * t) for c in range(300, 320) for t in range(c % 6)]
    rows += [(c, draw.choice([None, 1, 1, 5, -2]), draw.choice([None, "a"]), draw.choice([None, "", "x", "y"])) for c in (400, 401, 402, 503, 1_000_000_007) for _ in range(6)]
    rows += [(c, 0, "user", "only") for c in (650, 651, 700)]
    draw.shuffle(rows)
    frame = spark.createDataFrame(rows, DRIVER_SCHEMAS["conversations"]).repartition(5)
    for name in ("c", "id", "key", "block", "size"):
        frame = frame.withColumn(name, F.lit("x"))
    check_conversations(frame, rows, width=width)


def test_prefixes_of_no_conversations(spark):
    assert prefix_trie.summary(spark.createDataFrame([], DRIVER_SCHEMAS["conversations"])).collect() == []


def test_digests_of_many_ids(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_IDS", 10)
    ends = spark.range(-300, 5000).select(F.when(F.col("id") % 3 == 0, b"a").otherwise(b"b").alias("key"), F.col("id").alias("c"))
    found = {bytes(r["key"]): r["ends_sha256"] for r in prefix_trie.digests(ends).collect()}
    ids = range(-300, 5000)
    assert found == {
        b"a": brute.sha(",".join(str(i) for i in ids if i % 3 == 0)), b"b": brute.sha(",".join(str(i) for i in ids if i % 3)),
    }


def test_a_conversation_that_holds_most_rows_is_numbered_by_many_tasks(spark):
    rows = spark.range(20_000).selectExpr("5 AS conv_id", "id DIV 2 AS turn", "'a' AS role", "CAST(id AS STRING) AS text")
    work = Work(spark, "test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefix_trie.positions(work, prefix_trie.turns(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["p"] for r in placed.select("p").collect()) == list(range(20_000))
    dealt = spark.read.parquet(f"{work.folder}/1")
    assert dealt.groupBy("part").count().agg(F.max("count")).first()[0] < 10_000


# -- packing --------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def check_packing(pieces, wanted, limits):
    """Pieces cover every example once, without gaps, within all limits; returns the lengths of sequences."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in pieces:
        of[r["id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    assert set(of) == {i for i, ids in wanted.items() if ids}
    for i, parts in of.items():
        parts.sort(key=lambda r: r["start"])
        whole = b"".join(bytes(r["ids"]) for r in parts)
        assert np.frombuffer(whole, "<u4").tolist() == wanted[i]
        at = 0
        for r in parts:
            assert r["start"] == at and r["example_tokens"] == len(wanted[i])
            at += len(r["ids"]) // 4
    lengths = []
    for parts in sequences.values():
        parts.sort(key=lambda r: r["offset"])
        at = 0
        for r in parts:
            assert r["offset"] == at
            at += len(r["ids"]) // 4
        assert at <= limits.tokens and len(parts) <= limits.segments and sum(r["n_loss"] for r in parts) <= limits.loss
        assert at == limits.tokens or at & (at - 1) == 0
        lengths.append(at)
    return lengths


def test_packing_of_the_corpus(corpus, tokenizer):
    frame, rows = corpus
    limits = sequence_packing.Limits()
    pieces = sequence_packing.pack(sequence_packing.tokens(frame), limits).collect()
    wanted = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in rows}
    lengths = check_packing(pieces, wanted, limits)
    assert sum(n == limits.tokens for n in lengths) >= sum(lengths) // limits.tokens - 4
    digest = {(r["doc_id"], r["start"]): r for r in sequence_packing.summary(sequence_packing.pack_texts(frame)).collect()}
    for r in pieces:
        one = digest[r["id"], r["start"]]
        assert one["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and one["length"] == len(r["ids"]) // 4


def test_ids_of_odd_texts(spark, tokenizer):
    """Ids by words equal those of the whole text."""
    texts = [
        None, "", " ", "a\x0bb\x0c c\rd", "it's we'll 'tis don 't", "<|endoftext|> <|startoftext|>x", "é ́x ΣΑΣ ς", "東京 🙂🙂 1234 ½",
        "\x1cfoo\x85bar\xa0baz qux　 end", "z" * 5000, "İstanbul ﬁne Å", "word " * 3000, "ABC\x1cdef\x85ghi\xa0JKL Ünï×÷ªµºß¿½2a3 B-52s x_y",
        "he said 'no,' it's 'sad", "a1b2c3###d,,e", "NAÏVE ÀÉ! façade?", "#!? ... ﻿bom \x00nul", "ⅷ ①②",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in sequence_packing.tokens(frame).collect()}
    assert found == {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    small = sequence_packing.Encoder(memory=2)
    assert [np.frombuffer(x, "<u4").tolist() + [1] for x in small([t or "" for t in texts])] == list(found.values())


@pytest.mark.parametrize("limits, pool", [((2048, 64, 2048), 3), ((64, 3, 40), 4096), ((10, 10, 1), 7), ((1, 1, 1), 4096), ((100, 2, 100), 3)])
def test_packing_within_all_limits(spark, limits, pool):
    draw = random.Random(1)
    limits = sequence_packing.Limits(*limits)
    examples = [(i, list(range(i, i + draw.choice([0, 1, 1, 3, 20, 200, 5000])))) for i in range(120)]
    rows = [(i, np.array(ids, "<u4").tobytes(), draw.choice([0, 0, len(ids) // 2, len(ids), len(ids) + 5])) for i, ids in examples]
    frame = spark.createDataFrame(rows, "id bigint, ids binary, n_prompt bigint").repartition(3)
    check_packing(sequence_packing.pack(frame, limits, pool=pool).collect(), dict(examples), limits)


def test_the_heuristic_takes_what_suits_the_room_that_is_left():
    """Where loss is scarce, the example with more tokens and less loss comes first."""
    limits = sequence_packing.Limits(100, 9, 50)
    done, _ = sequence_packing.sequences([(0, 0, 40, 0), (1, 0, 60, 60), (2, 0, 45, 45)], limits)
    assert [p.item for p in done[0]][:2] == [0, 1] and sum(p.length for p in done[0]) == 100


def test_packing_of_odd_rows(spark, odd, nothing):
    frame, rows = odd
    found = sequence_packing.pack_texts(frame)
    assert found.groupBy("sequence_id").agg(F.sum(F.octet_length("ids") / 4).alias("n")).where("n > 2048").isEmpty()
    per_row = sequence_packing.tokens(frame).agg(F.sum(F.octet_length("ids"))).first()[0]
    assert found.agg(F.sum(F.octet_length("ids"))).first()[0] == per_row
    assert found.where("start = 0").count() == len(rows)
    assert sequence_packing.pack_texts(nothing).collect() == []
    with pytest.raises(ValueError):
        sequence_packing.pack(sequence_packing.tokens(nothing), sequence_packing.Limits(0, 1, 1))


def test_packing_of_instructions(spark, tokenizer):
    rows = [(1, "What is two and two?", "Four."), (2, None, "Alone."), (3, "Unanswered?", None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, question string, text string")
    found = {r["id"]: r for r in sequence_packing.tokens(frame, prompt="question").collect()}
    for i, question, answer in rows:
        first = tokenizer.encode(question or "", add_special_tokens=False).ids
        rest = tokenizer.encode(answer or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(found[i]["ids"]), "<u4").tolist() == first + rest + [1] and found[i]["n_prompt"] == len(first)
