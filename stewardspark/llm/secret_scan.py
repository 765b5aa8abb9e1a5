"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidate credentials; their values are hashed and counted by distinct
repositories and distinct owners over the whole corpus. A value that many owners hold, or
that lies in very many repositories of few, is a widely copied example; a value of one owner
that looks random and is not spread like that is live-looking. Candidates of the looser
patterns become findings only when they are live-looking.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .rows import column

# Owners from which on a value counts as a widely copied example.
SHARED_OWNERS = 3
# Repositories from which on it does whoever owns them.
SHARED_REPOSITORIES = 20
# Distinct characters that a live-looking value has at least.
DISTINCT_CHARS = 8

# Words that mark a value as a placeholder.
PLAIN = "example|sample|changeme|placeholder|dummy|your|xxxx|0123456789|abcdef0|test"

# Base kinds: pattern, the group that holds the value, characters the value needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# From the lower bound on, a run is found whole, so these two need no later check.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Looser kind: well-known token prefixes, signed web tokens, bearer headers, key blocks.
LOOSE = (
    r"(?:ghp|gho|ghs|glpat|sk|pk|rk|xoxb|xoxp)[_-][A-Za-z0-9_-]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"
    r"|[Bb]earer\x20[A-Za-z0-9._~+/-]{20,}"
)
KINDS = ("assign", "access", "hex", "loose")
BASE = KINDS[:3]


def found(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Matches in order as an array of (kind, i, gap, size, hash, random, whole).

    ``gap`` is the number of characters since the match before, ``size`` that of the match; the
    offsets are sums of both. ``group`` holds the secret part; a match whose part is shorter
    than ``least`` is not ``whole`` and only counts for the offsets of others. A text without
    any match costs one look.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))

    def piece(x: Column, i: Column) -> Column:
        value = F.regexp_extract(x["m"], pattern, group) if group else x["m"]
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["gap"]).alias("gap"), F.length(x["m"]).alias("size"),
            F.sha2(value, 256).alias("hash"), _live_looking(value).alias("random"), (F.length(value) >= least).alias("whole"),
        )

    return F.when(text.rlike(pattern), F.transform(F.arrays_zip(gaps.alias("gap"), matches.alias("m")), piece)).otherwise(
        F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,hash:string,random:boolean,whole:boolean>>")
    )


def candidates(docs: DataFrame, text: str, owner: str, repository: str, doc_id: str) -> DataFrame:
    """All matches of a document, base and loose, without the text; stored once.

    ``row`` numbers the stored rows, so documents may repeat or lack an id.
    """
    body = F.coalesce(column(text), F.lit(""))
    pieces = F.concat(
        found(body, ASSIGN, "assign", 2, 6), found(body, ACCESS, "access"),
        found(body, HEX, "hex"), found(body, LOOSE, "loose"),
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), column(doc_id).alias("doc_id"),
        column(owner).cast("string").alias("owner"), column(repository).cast("string").alias("repository"),
        pieces.alias("pieces"),
    )
    spark = docs.sparkSession
    path = scratch_path(spark, "secrets")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def placed(rows: DataFrame) -> DataFrame:
    """One row per candidate with its offsets: running sums over the matches of a text and kind."""
    flat = rows.select("row", F.explode("pieces").alias("p")).select("row", "p.*")
    upto = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("gap") + F.col("size")).cast("bigint")).over(upto)
    return flat.withColumn("end", end).where("whole").select(
        "row", "kind", (F.col("end") - F.col("size")).alias("first"), "end", "hash", "random"
    )


def _live_looking(value: Column) -> Column:
    chars = F.size(F.array_distinct(F.split(value, "")))
    plain = value.rlike(f"(?i){PLAIN}")
    return (chars >= DISTINCT_CHARS) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~plain


def ownership(rows: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories and owners over the corpus.

    Repeats are dropped per (hash, repository) and (hash, owner) before they are counted, so
    a value that sits in a third of all documents is spread by its repositories. A null owner
    or repository counts as one of its own.
    """
    held = rows.select("owner", "repository", F.explode("pieces").alias("p")).where("p.whole").select("owner", "repository", "p.hash")
    repositories = held.select("hash", "repository").distinct().groupBy("hash").agg(F.count("*").alias("repositories"))
    owners = held.select("hash", "owner").distinct().groupBy("hash").agg(F.count("*").alias("owners"))
    return repositories.join(owners, "hash")


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source",
    repository: str = "doc_id", shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES,
) -> DataFrame:
    """One row per document: ``doc_id``, ``spans`` with ownership, live and shared marks.

    Null text counts as empty; a document without candidates has an empty list. ``shared``
    values have at least ``shared_owners`` owners or ``shared_repositories`` repositories,
    ``live`` ones have one owner, fewer repositories than that and look random. Loose candidates
    that are not live are left out. Texts are read whole; what a very long one costs grows with
    its length, as its matches are rows of their own when offsets are summed.
    """
    rows = candidates(docs, text, owner, repository, doc_id)
    counts = ownership(rows)
    judged = (
        placed(rows).join(counts, "hash")
        .withColumn("shared", (F.col("owners") >= shared_owners) | (F.col("repositories") >= shared_repositories))
        .withColumn("live", (F.col("owners") == 1) & ~F.col("shared") & F.col("random"))
        .where(F.col("kind").isin(*BASE) | F.col("live"))
    )
    order = F.struct(
        "first", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("rank"),
        "end", "kind", "hash", "repositories", "owners", "shared", "live",
    )
    grouped = judged.groupBy("row").agg(F.array_sort(F.collect_list(order)).alias("spans"))
    return rows.select("row", "doc_id").join(grouped, "row", "left").select(
        "doc_id", F.coalesce("spans", F.array().cast(grouped.schema["spans"].dataType)).alias("spans")
    )


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")


def summary(result: DataFrame) -> DataFrame:
    """Counts per base kind, the digest of the base spans, all spans, and the two marks."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def n(condition) -> Column:
        return F.size(F.filter("spans", condition)).cast("bigint")

    def of_kind(kind: str):
        return lambda s: s["kind"] == kind

    return result.select(
        "doc_id",
        *[n(of_kind(k)).alias(f"n_{k}") for k in BASE],
        F.sha2(_written(base), 256).alias("base_sha256"),
        _written(F.col("spans")).alias("spans"),
        n(lambda s: s["live"]).alias("n_live"),
        n(lambda s: s["shared"]).alias("n_shared"),
    )


def check_sql(shared_owners: int = SHARED_OWNERS, shared_repositories: int = SHARED_REPOSITORIES) -> str:
    """The same summary of ``documents`` with the source as owner and the document as repository, in SQL.

    Pieces between matches give the offsets here too; all else is counted from a flat table
    of candidates.
    """
    groups = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 0), "hex": (HEX, 0, 0), "loose": (LOOSE, 0, 0)}
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(groups.items()):
        quoted = "'" + pattern.replace("'", "''") + "'"
        parts.append(
            f"""SELECT doc_id, owner, '{kind}' AS kind, {rank} AS rank, gaps, found, i, regexp_extract(found[i], {quoted}, {group}) AS v
  FROM (SELECT doc_id, owner, string_split_regex(t, {quoted}) AS gaps, regexp_extract_all(t, {quoted}) AS found FROM d),
    unnest(range(1, len(found) + 1)) AS u(i) WHERE length(regexp_extract(found[i], {quoted}, {group})) >= {least}"""
        )
    every = "\n  UNION ALL ".join(parts)
    counts = ", ".join(f"count_if(kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""WITH d AS (SELECT doc_id, coalesce(source, chr(0)) AS owner, coalesce(text, '') AS t FROM documents),
c AS ({every}),
f AS (SELECT doc_id, owner, kind, rank, v, list_sum(list_transform(gaps[1:i], lambda z: length(z)))
    + coalesce(list_sum(list_transform(found[1:i - 1], lambda z: length(z))), 0) AS a, length(found[i]) AS n FROM c),
o AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT doc_id) AS repositories FROM f GROUP BY v),
j AS (SELECT doc_id, kind, rank, a, kind || ':' || a || ':' || (a + n) AS span, owners >= {shared_owners} OR repositories >= {shared_repositories} AS shared,
  owners = 1 AND repositories < {shared_repositories} AND len(list_distinct(string_split(v, ''))) >= {DISTINCT_CHARS} AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]')
    AND NOT regexp_matches(v, '{PLAIN}', 'i') AS live FROM f JOIN o USING (v)),
g AS (SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY a, rank) FILTER (kind IN ({base})) AS base,
  string_agg(span, ',' ORDER BY a, rank) AS spans, count_if(live)::BIGINT AS n_live, count_if(shared)::BIGINT AS n_shared
  FROM j WHERE kind IN ({base}) OR live GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_shared, 0) AS n_shared
FROM d LEFT JOIN g USING (doc_id)"""
