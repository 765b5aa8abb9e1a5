import pytest

from stewardspark.sources.driver_tables import read_driver

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Extra columns named like the operators' own.
CLASHING = ("score", "row", "key", "class", "starts", "digest", "n", "hits", "n_words", "node", "pack", "spans", "tokens")


@pytest.fixture(scope="session")
def corpus(spark):
    """The smallest documents table, and the same rows in Python."""
    frame = read_driver(spark, SF, "documents")
    return frame, frame.collect()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    line = "one two three four five six seven eight nine ten"
    long = " ".join(f"word{i % 977} über {i}" for i in range(40_000))
    block = "\n".join(f"line {i} of a shared block that is long enough to be found again" for i in range(5))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \t ", "en", "a", 3), (4, line, None, "a", 9),
        (5, line, "en", None, 9), (5, line, "en", None, 9), (6, long, "en", "b", None), (7, long + " x", "de", "b", 1),
        (8, block, "en", "", 1), (9, "first\n" + block + "\nlast", "en", "a", 1), (None, block, "en", "a", 1),
        (None, None, None, None, None), (10, "Ünïcödé — 東京 🙂 " * 20, "fr", "a", 1), (11, "a" * 5000, "en", "a", 1),
        (12, "12345 678", "en", "a", 1), (8, "another text under the same id", "en", "a", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        frame = frame.selectExpr("*", f"'x' AS `{name}`")
    return frame, rows


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
