"""Line deduplication by winnowing over line hashes, in DataFrame functions only.

A run is three consecutive lines, or fewer that hold fifty words or more. Of the lines of a
run the one with the smallest hash is selected, so two documents that share a run share a
selected line: every run has a guaranteed fingerprint. Lines that are selected at two places or
more are joined: the runs around each place meet the first place in the corpus with the same
run. Matches are then extended both ways, run by run along the lines on which both sides
continue alike, to the longest stretch that two documents share; it is deleted at the later
place. The selected places with their runs are written once and read from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .rows import column, write_table

RUN = 3
WORDS = 50


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(doc_id: str, text: str) -> dict[str, Column]:
    """Identity of a row: its id and content, both never null."""
    return {
        "_unnamed": column(doc_id).isNull(),
        "_id": F.coalesce(column(doc_id).cast("bigint"), F.lit(0)),
        "_content": F.xxhash64(F.coalesce(column(text), F.lit(""))),
    }


_KEY = ["_unnamed", "_id", "_content"]


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _windows(run: int, words: int | None) -> Column:
    """(start, size) of all runs: ``run`` lines, or fewer that hold ``words`` words."""
    count = F.size("lines")

    def starts(size: int) -> Column:
        return F.when(count >= size, F.sequence(F.lit(0), count - size)).otherwise(F.array().cast("array<int>"))

    def sized(size: int) -> Column:
        found = starts(size)
        if size < run:
            held = lambda p: F.aggregate(F.slice("counts", p + 1, size), F.lit(0), lambda x, y: x + y)
            found = F.filter(found, lambda p: held(p) >= words)
        return F.transform(found, lambda p: F.struct(p.alias("start"), F.lit(size).alias("size")))

    return F.concat(*[sized(n) for n in ([run] if words is None else range(1, run + 1))])


def fingerprints(docs: DataFrame, doc_id: str, text: str, run: int, words: int | None = WORDS) -> DataFrame:
    """Selected line hashes and their lines, each with the runs (start, size, digest) that selected it."""
    marks = F.transform("lines", lambda line, i: F.struct(F.xxhash64(line).alias("h"), (-i).alias("i")))
    lines = docs.select(*[c.alias(n) for n, c in _key(doc_id, text).items()], split_lines(column(text)).alias("lines"))
    if words is None:
        lines = lines.where(F.size("lines") >= run)
    else:
        lines = lines.withColumn("counts", F.transform("lines", _words))
    # Identical rows are one document; the smallest hash wins, the later line on a tie.
    windows = lines.withColumn("marks", marks).select(
        *_KEY,
        F.explode(
            F.transform(
                _windows(run, words),
                lambda w: F.struct(
                    F.array_min(F.slice("marks", w["start"] + 1, w["size"])).alias("mark"),
                    w["start"].alias("start"),
                    w["size"].alias("size"),
                    F.unhex(F.md5(F.concat_ws("\n", F.slice("lines", w["start"] + 1, w["size"])).cast("binary"))).alias("digest"),
                ),
            )
        ).alias("w"),
    )
    return windows.select(*_KEY, "w.mark.h", (-F.col("w.mark.i")).alias("line"), "w.start", "w.size", "w.digest")


def repeated_places(selected: DataFrame) -> DataFrame:
    """The runs whose selected line hash is selected at two places or more.

    Neighbouring runs that select the same line have one place; a repeat inside a document
    is another.
    """
    apart = " OR ".join(f"min({c}) < max({c})" for c in (*_KEY, "line"))
    repeated = selected.groupBy("h").agg(F.expr(apart).alias("apart")).where("apart").select("h")
    return selected.join(repeated, "h", "left_semi")


def matches(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = WORDS
) -> DataFrame:
    """The longest stretches that occur earlier: the document, ``start``, ``size``, ``source``, ``source_start``.

    A document is the three columns of its identity, the source a struct of them. Each run of
    a stretch has its first occurrence in the source, at the same distance from its start.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "line-fingerprints")
    selected = write_table(fingerprints(docs, doc_id, text, run, words), path, compression="zstd")
    runs = repeated_places(selected).select(*_KEY, "start", "size", "digest")
    place = F.struct(*_KEY, "start")
    first = runs.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("last > first")
    met = (
        runs.join(first.select("digest", "first"), "digest").where(place > F.col("first"))
        .withColumn("source", F.struct(*[F.col(f"first.{c}").alias(c) for c in _KEY]))
        .withColumn("shift", F.col("start") - F.col("first.start"))
        .select(*_KEY, "start", "size", "source", "shift")
    )
    # One exchange by document serves the window and what callers group by document.
    line = Window.partitionBy(*_KEY, "source", "shift").orderBy("start", "size")
    reached = F.max(F.col("start") + F.col("size")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    stretch = F.sum(F.when(F.col("start") <= F.col("reached"), 0).otherwise(1)).over(line)
    return (
        met.repartition(*_KEY).withColumn("reached", reached).withColumn("stretch", stretch)
        .groupBy(*_KEY, "source", "shift", "stretch")
        .agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
        .select(*_KEY, "start", (F.col("end") - F.col("start")).alias("size"), "source", (F.col("start") - F.col("shift")).alias("source_start"))
    )


def later_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = WORDS
) -> DataFrame:
    """Per document the stretches (start, size) that occur earlier in the corpus."""
    return matches(docs, doc_id, text, run, words).groupBy(*_KEY).agg(
        F.collect_set(F.struct("start", "size")).alias("starts")
    )


def deduplicate(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = WORDS
) -> DataFrame:
    """``row`` with ``lines``, ``kept`` (line numbers that stay) and ``kept_text``.

    A line goes if it lies in a run of ``run`` lines that occurs earlier: in a document with
    a smaller id, or further up in the same one. Fewer lines that hold ``words`` words (parted
    by blanks) are a run as well; with ``words=None`` they are not, and shorter documents stay
    whole. Null text counts as empty (one empty line) and comes back null; rows without an id
    come last. Rows that share id and text are one document; those that share only the id are
    ordered by content. The lines of a very long text are rows of their own wherever they are
    compared; only the text itself, its lines and its stretches lie in one row.
    """
    packed = docs.select(
        F.struct(*[column(c) for c in docs.columns]).alias("row"),
        *[c.alias(n) for n, c in _key(doc_id, text).items()],
    )
    later = later_runs(docs, doc_id, text, run, words)
    gone = F.array_distinct(
        F.flatten(F.transform("starts", lambda w: F.sequence(w["start"], w["start"] + w["size"] - 1)))
    )
    everything = F.sequence(F.lit(0), F.size("lines") - 1)
    body = F.col("row").getField(text)
    return (
        packed.join(later, _KEY, "left")
        .withColumn("lines", split_lines(body))
        .withColumn("kept", F.when(F.col("starts").isNull(), everything).otherwise(F.array_except(everything, gone)))
        .withColumn(
            "kept_text",
            F.when(F.col("starts").isNull(), body).otherwise(
                F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n")
            ),
        )
        .select("row", "lines", "kept", "kept_text")
    )


def summary(result: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    lines, kept = F.size("lines").cast("bigint"), F.size("kept").cast("bigint")
    return result.select(
        F.col("row").getField(doc_id).alias("doc_id"),
        lines.alias("n_lines"),
        (lines - kept).alias("n_removed"),
        F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"),
    )


def without_later_runs(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = WORDS
) -> DataFrame:
    """The documents with later repeated runs cut from their text; all rows and columns stay."""
    result = deduplicate(docs, doc_id, text, run, words)
    return result.select(
        *[
            F.col("kept_text").alias(c) if c == text else F.col("row").getField(c).alias(c)
            for c in docs.columns
        ]
    )


def check_sql(documents: str = "documents", run: int = RUN, words: int = WORDS) -> str:
    """The same summary by comparing every run with its first occurrence."""
    return f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM {documents}),
w AS (SELECT doc_id, s, m, l[s:s + m - 1] AS g FROM d, unnest(range(1, {run + 1})) AS v(m), unnest(range(1, len(l) - m + 2)) AS t(s)),
q AS (SELECT * FROM w WHERE m = {run} OR list_sum(list_transform(g, lambda x: len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))) >= {words}),
r AS (SELECT doc_id, s, m, row_number() OVER (PARTITION BY m, g ORDER BY doc_id, s) AS nth FROM q),
x AS (SELECT DISTINCT doc_id, s + k AS i FROM r, unnest(range(m)) AS u(k) WHERE nth > 1),
n AS (SELECT doc_id, i, l[i] AS line FROM d, unnest(range(1, len(l) + 1)) AS t(i)),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t, count(*) AS c FROM n ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(l) AS n_lines, len(l) - coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)"""
