"""Page access decisions and the access log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import count_where

# Level ranks, the role of a nameless user, and the texts of a decision.
LEVEL_RANK = {"READ": 1, "WRITE": 2, "ADMIN": 3}
NAMELESS_ROLE = "PUBLIC"
NO_RULE_REASON = "default_allow (no matching rule)"
RULE_REASON = "rule="


def _rank(level: Column, allow_as: str | None) -> Column:
    label = F.upper(level)
    if allow_as is not None:
        label = F.when(label == "ALLOW", allow_as).otherwise(label)
    rank = F.lit(0)
    for name, value in LEVEL_RANK.items():
        rank = F.when(label == name, value).otherwise(rank)
    return rank


def page_decisions(
    requests: DataFrame, rules: DataFrame, required: str = "READ", allow_as: str | None = None
) -> DataFrame:
    """Requests with ``allowed`` and ``reason``; no rule for a page means allowed.

    Unknown levels rank below READ, so a rule with level ALLOW denies, unless
    ``allow_as`` names the level it stands for. Of several rules for one role and page the
    first level in text order decides.
    """
    role, page = F.upper("role_name"), F.upper("page_name")
    level = rules.groupBy(role.alias("_role"), page.alias("_page")).agg(
        F.min("access_level").alias("access_level")
    )
    asked = requests.withColumn(
        "_role", F.coalesce(F.nullif(role, F.lit("")), F.lit(NAMELESS_ROLE))
    ).withColumn("_page", F.coalesce(page, F.lit("")))
    has_rule = F.col("access_level").isNotNull()
    allowed = _rank(F.col("access_level"), allow_as) >= LEVEL_RANK.get(required.upper(), 1)
    return (
        asked.join(level, ["_role", "_page"], "left")
        .withColumn("allowed", F.when(has_rule, allowed).otherwise(True))
        .withColumn(
            "reason",
            F.when(has_rule, F.concat(F.lit(RULE_REASON), "access_level")).otherwise(
                NO_RULE_REASON
            ),
        )
        .select(*requests.columns, "allowed", "reason")
    )


def log_access(log: DataFrame, decisions: DataFrame) -> DataFrame:
    """Access log with the decided requests appended."""
    return log.unionByName(decisions.select(*log.columns))


def access_log_rollup(log: DataFrame) -> DataFrame:
    """Attempts, denials and last attempt per role and page, ignoring case."""
    return log.groupBy(
        F.upper("role_name").alias("role_name"), F.upper("page_name").alias("page_name")
    ).agg(
        F.count(F.lit(1)).alias("attempts"),
        count_where(~F.col("allowed")).alias("denials"),
        F.max("ts").alias("last_attempt"),
    )
