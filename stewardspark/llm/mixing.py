"""Temperature mixing of sources, in DataFrame functions only.

Token shares are raised to an exponent between 0 (all sources alike) and 1 (as they are).
The exponent is bisected: the largest that reaches the target entropy, or, if that repeats
a source too often, the smallest that keeps the repetition limit. A budget that no exponent
can meet within the limit is lowered to what the limit allows. The budget is dealt out by
largest remainder, so the quotas of the sources add up to it. The weights are then
realised as permutations: each source is read in a new pseudo-random order per epoch until
its share of the token budget is used up, and the reading is cut into blocks that each
hold the sources in their target proportions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .rows import column

# Share of the largest possible entropy that the mixture has to reach.
ENTROPY = 0.95
# How often a source may be read at most.
EPOCHS = 4.0
BLOCK_TOKENS = 1_000_000
# Five jobs of eight bisection steps each.
STEPS, STEPS_PER_JOB = 40, 8
# Ranges in which remainders are counted.
RANGES = 4096
# Rows per slice of a source whose running sums are taken together.
SLICE_ROWS = 50_000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _source_key(source: Column) -> Column:
    """Never null, and different for a null and an empty source."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def counted(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Ids, sources and token counts, stored once; documents without tokens are left out."""
    rows = docs.select(
        column(doc_id).alias("doc_id"), column(source).alias("source"),
        _source_key(column(source)).alias("key"), token_count(column(text)).alias("n_tokens"),
    ).where("n_tokens > 0")
    spark = docs.sparkSession
    path = scratch_path(spark, "token-counts")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@dataclass
class Mixture:
    exponent: float
    tokens: int
    budget: int  # what is dealt out
    asked: int  # the budget asked for; more than ``budget`` where the repetition limit forbids it
    total: float  # sum of the raised shares


def solve(
    sources: DataFrame, entropy: float = ENTROPY, epochs: float = EPOCHS, budget: int | None = None
) -> Mixture | None:
    """The exponent for ``sources`` (key, tokens); None without any token.

    Every source alike is read ``budget / tokens`` times at exponent 1, which is the least that
    the most repeated one can be read. A budget that breaks the limit even so is lowered to
    ``epochs`` times the tokens, and the sources are read as they are. Only sums per tried
    exponent reach the driver, whatever the number of sources.
    """
    top = sources.agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not top["t"]:
        return None
    tokens, asked = int(top["t"]), int(top["t"] if budget is None else budget)
    budget = min(asked, math.floor(tokens * epochs))
    share = F.col("tokens") / F.lit(float(tokens))

    def measures(exponents: list[float]) -> dict[float, tuple[float, float, float]]:
        """Per exponent: entropy over its maximum, most epochs of any source, total."""
        raised = F.pow(share, F.col("a"))
        rows = (
            sources.withColumn("a", F.explode(F.array(*[F.lit(a) for a in exponents])))
            .groupBy("a")
            .agg(
                F.sum(raised).alias("s0"), F.sum(raised * F.log(share)).alias("s1"),
                F.max(raised / share).alias("most"), F.log(F.count("*").cast("double")).alias("limit"),
            )
            .select(
                "a", "s0",
                F.when(F.col("limit") > 0, (F.log("s0") - F.col("a") * F.col("s1") / F.col("s0")) / F.col("limit"))
                .otherwise(1.0).alias("entropy"),
                (F.col("most") / F.col("s0") * (budget / tokens)).alias("epochs"),
            )
        )
        return {r["a"]: (r["entropy"], r["epochs"], r["s0"]) for r in rows.collect()}

    def bisect(holds_low) -> tuple[float, float]:
        """Bounds between which ``holds_low`` (true at small exponents) turns false."""
        low, high = 0.0, 1.0
        for _ in range(STEPS // STEPS_PER_JOB):
            parts = 1 << STEPS_PER_JOB
            grid = [low + (high - low) * k / parts for k in range(1, parts)]
            found = measures(grid)
            inside = [a for a in grid if holds_low(found[a])]
            low, high = (max(inside), min([a for a in grid if a > max(inside)], default=high)) if inside else (low, grid[0])
        return low, high

    ends = measures([0.0, 1.0])
    exponent = 1.0 if ends[1.0][0] >= entropy else bisect(lambda m: m[0] >= entropy)[0]
    if asked > budget:
        exponent = 1.0
    elif measures([exponent])[exponent][1] > epochs:
        exponent = bisect(lambda m: m[1] > epochs)[1]
    return Mixture(exponent, tokens, budget, asked, measures([exponent])[exponent][2])


def quotas(sources: DataFrame, mixture: Mixture) -> DataFrame:
    """Sources with their weight and their tokens of the budget, by largest remainder.

    Every source gets the whole tokens due to it; those that are left over go to the largest
    remainders, equal ones in order of the keys. Remainders are counted in ranges, so only
    the sources of one range are ranked, however many there are.
    """
    share = F.col("tokens") / F.lit(float(mixture.tokens))
    due = F.pow(share, F.lit(mixture.exponent)) / mixture.total
    planned = (
        sources.withColumn("weight", due).withColumn("due", F.col("weight") * float(mixture.budget))
        .withColumn("quota", F.floor("due").cast("bigint")).withColumn("rest", F.col("due") - F.col("quota"))
        .withColumn("range", F.floor(F.col("rest") * RANGES).cast("int"))
    )
    counts = {r["range"]: (r["n"], r["q"]) for r in planned.groupBy("range").agg(F.count("*").alias("n"), F.sum("quota").alias("q")).collect()}
    left = max(0, mixture.budget - sum(q for _, q in counts.values()))
    last = RANGES
    for last in sorted(counts, reverse=True):
        if counts[last][0] > left:
            break
        left -= counts[last][0]
    else:
        last -= 1
    inside = planned.where(F.col("range") == last)
    rank = F.row_number().over(Window.partitionBy("range").orderBy(F.desc("rest"), "key"))
    chosen = inside.withColumn("rank", rank).withColumn("quota", F.col("quota") + (F.col("rank") <= left).cast("bigint"))
    others = planned.where(F.col("range") != last).withColumn("quota", F.col("quota") + (F.col("range") > last).cast("bigint"))
    columns = [*sources.columns, "weight", "quota"]
    return chosen.select(*columns).unionByName(others.select(*columns))


def realise(rows: DataFrame, plan: DataFrame, budget: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The mixture: which document stands where, in which epoch of its source.

    A document is taken while its source has budget left where it begins, so a source
    overshoots by less than its last document. Running sums are taken inside slices of an
    epoch and carried over one row per slice; a hot source is spread over its slices.
    """
    drawn = rows.join(plan.where("quota > 0").select("key", "tokens", "quota"), "key").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), (F.ceil(F.col("quota") / F.col("tokens")) - 1).cast("int")))
    )
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    largest, slices = plan.agg(F.max("docs")).first()[0], 2
    while 16**slices * SLICE_ROWS < largest:
        slices += 1
    drawn = drawn.withColumn("order", F.md5(F.concat_ws(":", name, F.col("epoch")).cast("binary"))).withColumn(
        "slice", F.substring("order", 1, slices)
    )
    place = ["order", "doc_id", "n_tokens"]
    sums = drawn.groupBy("key", "epoch", "slice").agg(F.sum("n_tokens").alias("inside"))
    before = Window.partitionBy("key", "epoch").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("key", "epoch", "slice", F.coalesce(F.sum("inside").over(before), F.lit(0)).alias("carry"))
    within = Window.partitionBy("key", "epoch", "slice").orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    blocks = max(1, -(-budget // block_tokens))
    placed = (
        drawn.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(carried, ["key", "epoch", "slice"])
        .withColumn("offset", F.col("epoch") * F.col("tokens") + F.col("carry") + F.col("inside"))
        .where("offset < quota")
        .withColumn("block", F.expr(f"CAST(offset * CAST({blocks} AS DECIMAL(20, 0)) DIV quota AS BIGINT)"))
        .withColumn("shuffle", F.md5(F.concat_ws(":", "key", "epoch", name, "block").cast("binary")))
    )
    inside_block = Window.partitionBy("block").orderBy("shuffle", "offset")
    return placed.select(
        "block", F.row_number().over(inside_block).cast("bigint").alias("position"),
        "source", F.col("epoch").cast("bigint").alias("epoch"), "doc_id", "n_tokens",
    )


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    entropy: float = ENTROPY, epochs: float = EPOCHS, budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
) -> DataFrame:
    """Counts, solves and realises; the budget is the corpus itself unless given.

    Columns: block, position (from 1 in the block), source, epoch (from 0), doc_id,
    n_tokens. Null sources are a source of their own. Documents without tokens, or with
    null text, are never drawn; no tokens at all give an empty result. Repeated rows are
    drawn once each. A budget beyond what ``epochs`` allows is lowered, see ``solve``. Of a
    text only its number of tokens is kept, so very long ones move nothing.
    """
    rows = counted(docs, doc_id, text, source)
    spark = docs.sparkSession
    path = scratch_path(spark, "source-tokens")
    totals = rows.groupBy("key").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals.write.parquet(path)
    sources = spark.read.schema(totals.schema).parquet(path)
    mixture = solve(sources, entropy, epochs, budget)
    if mixture is None:
        return rows.select(
            F.lit(0).cast("bigint").alias("block"), F.lit(0).cast("bigint").alias("position"),
            "source", F.lit(0).cast("bigint").alias("epoch"), "doc_id", "n_tokens",
        )
    return realise(rows, quotas(sources, mixture), mixture.budget, block_tokens)


def check_sql(documents: str = "documents", entropy: float = ENTROPY, epochs: float = EPOCHS) -> str:
    """The same mixture of a corpus without null sources, one bisection step at a time."""
    # Each step measures the middle of its interval over all sources.
    def bisection(name: str, low_side: str) -> str:
        return f"""{name}(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN {low_side} THEN a ELSE low END, CASE WHEN {low_side} THEN high ELSE a END FROM (
    SELECT step, low, high, (low + high) / 2 AS a, ln(sum(pow(p, (low + high) / 2)))
      - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2)) AS h,
      max(pow(p, (low + high) / 2) / p) / sum(pow(p, (low + high) / 2)) AS e, ln(count(*)) AS m
    FROM {name}, s WHERE step < {STEPS} GROUP BY step, low, high))"""

    def at(a: str) -> str:
        return f"(SELECT max(pow(p, {a}) / p) / sum(pow(p, {a})) FROM s)"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n
  FROM {documents}),
r AS (SELECT * FROM d WHERE n > 0),
t AS (SELECT source, sum(n)::BIGINT AS tokens FROM r GROUP BY source),
s AS (SELECT source, tokens, tokens / (SELECT sum(tokens) FROM t)::DOUBLE AS p FROM t),
{bisection("b", f"h >= {entropy} * m")},
{bisection("c", f"e > {epochs}")},
o AS (SELECT CASE WHEN (SELECT -sum(p * ln(p)) >= {entropy} * ln(count(*)) FROM s) THEN 1.0::DOUBLE
  ELSE (SELECT low FROM b WHERE step = {STEPS}) END AS a),
f AS (SELECT CASE WHEN {at("a")} <= {epochs} THEN a WHEN {at("1.0")} > {epochs} THEN 1.0::DOUBLE
  ELSE (SELECT high FROM c WHERE step = {STEPS}) END AS a FROM o),
z AS (SELECT source, tokens, pow(p, a) / (SELECT sum(pow(p, a)) FROM s) * (SELECT sum(tokens) FROM t)::DOUBLE AS due FROM s, f),
q AS (SELECT source, tokens, floor(due)::BIGINT + (row_number() OVER (ORDER BY due - floor(due) DESC, source)
  <= (SELECT sum(tokens) FROM t) - sum(floor(due)::BIGINT) OVER ())::BIGINT AS quota FROM z),
e AS (SELECT r.*, tokens, quota, epoch, md5(doc_id || ':' || epoch) AS o
  FROM r JOIN q USING (source), unnest(range(ceil(quota / tokens)::BIGINT)) AS u(epoch)),
w AS (SELECT *, epoch * tokens + coalesce(sum(n) OVER (PARTITION BY source, epoch ORDER BY o, doc_id, n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM e),
k AS (SELECT *, ((off::HUGEINT * (SELECT greatest(1, ceil(sum(tokens) / {BLOCK_TOKENS}))::HUGEINT FROM t)) // quota)::BIGINT AS block
  FROM w WHERE off < quota)
SELECT block, row_number() OVER (PARTITION BY block ORDER BY md5('=' || source || ':' || epoch || ':' || doc_id || ':' || block), off) AS position,
  source, epoch, doc_id, n AS n_tokens FROM k"""
