"""The pipeline, stage by stage, against plain versions on the smallest table."""

import brute
import duckdb
import pytest

import corpus_pipeline
from stewardspark.llm import language, mixing
from stewardspark.sources.driver_tables import read_driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Rows before and after each stage; the output of one is the input of the next."""
    docs = read_driver(spark, SF, "documents")
    seen = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen.append((name, docs))
    return seen


def ordered(df):
    return sorted(df.collect(), key=lambda r: r.doc_id)


def test_all_but_the_last_return_documents(stages):
    columns = stages[0][1].columns
    assert [df.columns for _, df in stages[1:-1]] == [columns] * 4


def test_language(stages):
    docs, kept = stages[0][1], stages[1][1]
    model = language.fit(docs)
    rows = ordered(docs)
    p = model.probabilities([r.text for r in rows]).max(axis=1)
    want = [r for r, x in zip(rows, p) if any(c.isalpha() for c in r.text) and x >= model.threshold]
    assert ordered(kept) == want and len(want) > 0.95 * len(rows)


def test_lines(stages):
    before, after = ordered(stages[1][1]), ordered(stages[2][1])
    want = ["\n".join(lines) for lines in brute.repeated_lines([r.text for r in before], words=50)]
    assert [r.text for r in after] == want
    assert [(r.doc_id, r.lang, r.source, r.n_chars) for r in after] == [
        (r.doc_id, r.lang, r.source, r.n_chars) for r in before
    ]


def test_near_duplicates(stages):
    before = ordered(stages[2][1])
    classes = brute.classes(len(before), brute.linked([brute.shingles(r.text) for r in before]))
    assert ordered(stages[3][1]) == [r for k, r in enumerate(before) if classes[k] == k]


def test_benchmark(spark, stages):
    items = [(r.item_id, r.text) for r in read_driver(spark, SF, "benchmark").collect()]
    before = ordered(stages[3][1])
    assert ordered(stages[4][1]) == [r for r in before if brute.leaks(r.text, items)[1] == 0]


def test_mixture(stages):
    con = duckdb.connect()
    con.register("kept", stages[4][1].toPandas())
    names = ["block", "position", "source", "epoch", "doc_id", "n_tokens"]
    want = con.sql(mixing.check_sql("kept")).select(*names).fetchall()
    assert sorted(tuple(r) for r in stages[5][1].select(*names).collect()) == sorted(want)


def test_run_is_the_last_stage(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[5][1].collect()))
