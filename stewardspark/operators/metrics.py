"""Daily roll-ups, dashboard queries and documented analytics.

Log tables are counted per join key before they are shuffled to a registry table: the
counts are additive, so the totals are those of the plain joins, while a hot dataset,
control or risk is a single row by the time it moves.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clock import (
    AsOf,
    days_crossed,
    minutes_crossed,
    moment,
    since,
    to_datetime,
)
from ..functions.ratios import count_where, percent, rating_score, zero_if_null
from .common import counts_side_by_side
from .views import latest_results

ALL_DOMAINS = "__ALL__"
# Weights of successful runs, passed tests and passed controls in the score.
HEALTH_WEIGHTS = (40, 35, 25)
SEVERITY_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")

_OUTCOMES = (("PASS", "passed"), ("FAIL", "failed"), ("WARN", "warning"))


def _outcome_counts(total: str):
    return [F.count(F.lit(1)).alias(total)] + [
        count_where(F.col("outcome") == value).alias(name) for value, name in _OUTCOMES
    ]


def _daily_by_domain(facts: DataFrame, key: str, domain_of: DataFrame, total: str) -> DataFrame:
    """Outcome counts of dated ``facts`` per day and domain.

    Facts are counted per (day, key) before they meet the registry: sums of those counts are
    the same, and a hot key is one row per day when it moves. Whether the registry side is
    broadcast is left to Spark, which checks its size.
    """
    return by_domain(facts.groupBy("metric_date", key).agg(*_outcome_counts(total)), key, domain_of, total)


def by_domain(counted: DataFrame, key: str, domain_of: DataFrame, total: str) -> DataFrame:
    """Counts per (day, key) as counts per day and domain."""
    sums = [F.sum(c).alias(c) for c in (total, *(name for _, name in _OUTCOMES))]
    return (
        counted.join(domain_of, key, "left").groupBy("metric_date", "domain_name").agg(*sums)
    )


def dataset_domains(ds: DataFrame, domain: DataFrame) -> DataFrame:
    return (
        ds.select("dataset_id", "domain_id")
        .join(domain.select("domain_id", "domain_name"), "domain_id", "left")
        .select("dataset_id", "domain_name")
    )


def control_domains(control: DataFrame, ds: DataFrame, domain: DataFrame) -> DataFrame:
    """Only dataset-scoped controls resolve to a domain."""
    scoped = ds.select(F.col("dataset_id").alias("scope_id"), "domain_id").withColumn(
        "scope_type", F.lit("DATASET")
    )
    return (
        control.select("control_id", "scope_type", "scope_id")
        .join(scoped, ["scope_type", "scope_id"], "left")
        .join(domain.select("domain_id", "domain_name"), "domain_id", "left")
        .select("control_id", "domain_name")
    )


QUALITY_NAMES = {"passed": "passed_tests", "failed": "failed_tests", "warning": "warning_tests"}
CONTROL_NAMES = {"passed": "passed_controls", "failed": "failed_controls", "warning": "warning_controls"}


def daily_process_metrics(run: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    minutes = minutes_crossed("started_at", "ended_at")
    return (
        run.where(since("started_at", as_of, days))
        .groupBy(F.to_date("started_at").alias("metric_date"))
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            count_where(F.col("status") == "SUCCESS").alias("successful_runs"),
            count_where(F.col("status") == "FAILED").alias("failed_runs"),
            F.avg(minutes).alias("avg_duration_minutes"),
            F.max(minutes).alias("max_duration_minutes"),
        )
        .withColumn("domain_name", F.lit(ALL_DOMAINS))
    )


def daily_quality_metrics(
    res: DataFrame, ds: DataFrame, domain: DataFrame, as_of: AsOf, days: int = 30
) -> DataFrame:
    """Per day and domain; results whose dataset has no domain form a NULL domain row."""
    facts = res.where(since("created_at", as_of, days)).select(
        F.to_date("created_at").alias("metric_date"), "dataset_id", "outcome"
    )
    return _daily_by_domain(
        facts, "dataset_id", dataset_domains(ds, domain), "total_dq_tests"
    ).withColumnsRenamed(QUALITY_NAMES)


def daily_control_metrics(
    test: DataFrame,
    control: DataFrame,
    ds: DataFrame,
    domain: DataFrame,
    as_of: AsOf,
    days: int = 30,
) -> DataFrame:
    """Per day and domain; only dataset-scoped controls resolve to a domain."""
    facts = test.where(since("executed_at", as_of, days)).select(
        F.to_date("executed_at").alias("metric_date"), "control_id", "outcome"
    )
    return _daily_by_domain(
        facts, "control_id", control_domains(control, ds, domain), "total_control_tests"
    ).withColumnsRenamed(CONTROL_NAMES)


def governance_metrics(
    run: DataFrame,
    res: DataFrame,
    test: DataFrame,
    control: DataFrame,
    ds: DataFrame,
    domain: DataFrame,
    as_of: AsOf,
    days: int = 30,
) -> DataFrame:
    """Daily process, quality and control metrics side by side, with a weighted score."""
    return side_by_side(
        daily_process_metrics(run, as_of, days),
        daily_quality_metrics(res, ds, domain, as_of, days),
        daily_control_metrics(test, control, ds, domain, as_of, days),
        as_of,
    )


def side_by_side(pm: DataFrame, qm: DataFrame, cm: DataFrame, as_of: AsOf) -> DataFrame:
    """The daily process, quality and control roll-ups as one table.

    The three roll-ups meet in full outer joins on (date, domain). A NULL domain joins
    nothing and stays a row of its own; a union and regroup would merge those rows. An empty
    domain name is joined as it is and shown as NULL.
    """
    pq = pm.join(qm, ["metric_date", "domain_name"], "full")
    joined = pq.join(cm, ["metric_date", "domain_name"], "full")

    w_run, w_test, w_control = HEALTH_WEIGHTS
    runs, tests, controls = (
        zero_if_null(c) for c in ("total_runs", "total_dq_tests", "total_control_tests")
    )
    good = (
        zero_if_null("successful_runs") * w_run
        + zero_if_null("passed_tests") * w_test
        + zero_if_null("passed_controls") * w_control
    )
    return joined.where("metric_date IS NOT NULL").select(
        "metric_date",
        F.nullif("domain_name", F.lit("")).alias("domain_name"),
        runs.alias("total_process_runs"),
        zero_if_null("successful_runs").alias("successful_process_runs"),
        zero_if_null("failed_runs").alias("failed_process_runs"),
        percent("successful_runs", "total_runs").alias("process_success_rate_pct"),
        "avg_duration_minutes",
        "max_duration_minutes",
        tests.alias("total_dq_tests"),
        zero_if_null("passed_tests").alias("passed_dq_tests"),
        zero_if_null("failed_tests").alias("failed_dq_tests"),
        zero_if_null("warning_tests").alias("warning_dq_tests"),
        percent("passed_tests", "total_dq_tests").alias("dq_pass_rate_pct"),
        controls.alias("total_control_tests"),
        zero_if_null("passed_controls").alias("passed_control_tests"),
        zero_if_null("failed_controls").alias("failed_control_tests"),
        zero_if_null("warning_controls").alias("warning_control_tests"),
        percent("passed_controls", "total_control_tests").alias("control_pass_rate_pct"),
        percent(good, runs * w_run + tests * w_test + controls * w_control).alias(
            "overall_health_score_pct"
        ),
        moment(as_of).alias("created_at"),
    )


# --- dashboard ---------------------------------------------------------------------------


def kpis(ds: DataFrame, term: DataFrame, rule: DataFrame, risk: DataFrame) -> DataFrame:
    return counts_side_by_side(
        {
            "datasets": ds,
            "glossary_terms": term,
            "dq_rules": rule,
            "open_risks": risk.where("status = 'OPEN'"),
        }
    )


def dataset_browser(
    ds: DataFrame, domain: str | None = None, system: str | None = None, ordered: bool = False
) -> DataFrame:
    """Datasets, optionally of one domain or system; ``None`` and ``(All)`` keep all.

    The order by domain, system and name is a global sort, made only when asked for.
    """
    for column, choice in (("domain_id", domain), ("system_id", system)):
        if choice is not None and choice.upper() != "(ALL)":
            ds = ds.where(F.col(column) == choice)
    shown = ds.select(
        "dataset_id", "system_id", "domain_id", "platform", "database_name", "schema_name",
        "object_name", "object_type", "dv_layer", "classification", "certification",
    )
    return shown.orderBy("domain_id", "system_id", "object_name") if ordered else shown


def latest_dq(
    res: DataFrame,
    run: DataFrame,
    rates: tuple[str, ...] = ("validity_rate", "completeness_rate"),
    scale: int | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Newest result per rule with rates read from its JSON summary.

    Rates are doubles; ``scale`` rounds them to that many digits (0 gives whole numbers).
    They are read before results move, so the JSON itself is not shuffled.
    """

    def rate(name: str):
        value = F.get_json_object("metrics_summary", f"$.{name}").try_cast("double")
        return (value if scale is None else F.round(value, scale)).alias(name)

    narrow = res.select(
        "run_id", "rule_id", "dataset_id", "outcome", "evidence_ref", *[rate(r) for r in rates]
    )
    found = latest_results(narrow, run).select(
        "run_id", "rule_id", "dataset_id", "outcome", *rates
    )
    return found.orderBy("rule_id") if ordered else found


def outcome_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("outcome").agg(F.count(F.lit(1)).alias("count"))


def risk_register(risk: DataFrame, ranked: bool = False) -> DataFrame:
    """Open and mitigated risks; severity sorts as text, or by rank when ``ranked``."""
    kept = risk.where(F.col("status").isin("OPEN", "MITIGATED")).select(
        "risk_id", "title", "category", "severity", "likelihood", "impact", "owner_party_id",
        "status",
    )
    if not ranked:
        return kept.orderBy(F.desc("severity"), F.desc("impact"))
    place = F.array_position(F.array(*[F.lit(s) for s in SEVERITY_ORDER]), F.col("severity"))
    return kept.withColumn("severity_rank", place.cast("int")).orderBy(
        "severity_rank", rating_score("impact").desc()
    )


# --- documented analytics ----------------------------------------------------------------


def asset_discovery(
    ds: DataFrame, system: DataFrame, attrs: DataFrame, ordered: bool = False
) -> DataFrame:
    per_dataset = attrs.groupBy("dataset_id").agg(
        F.count("column_name").alias("column_count"),
        count_where(F.col("quality_critical")).alias("critical_columns"),
    )
    shown = ["dataset_id", "catalog_name", "domain_id", "classification", "is_cde", "system_name"]
    found = (
        ds.join(system.select("system_id", "system_name"), "system_id")
        .join(per_dataset, "dataset_id", "left")
        .groupBy(*shown)
        .agg(
            F.sum(zero_if_null("column_count")).alias("column_count"),
            F.sum(zero_if_null("critical_columns")).alias("critical_columns"),
        )
    )
    return found.orderBy("domain_id", "classification") if ordered else found


def quality_scorecard(
    res: DataFrame,
    ds: DataFrame,
    domain: DataFrame,
    rule: DataFrame,
    as_of: AsOf,
    days: int = 30,
) -> DataFrame:
    counted = (
        res.where(since("created_at", as_of, days))
        .groupBy("dataset_id", "rule_id")
        .agg(*_outcome_counts("checks"))
    )
    return (
        counted.join(ds.select("dataset_id", "domain_id"), "dataset_id")
        .join(domain.select("domain_id", "domain_name"), "domain_id")
        .join(rule.select("rule_id", "severity"), "rule_id")
        .groupBy("domain_name")
        .agg(
            F.count_distinct("dataset_id").alias("monitored_datasets"),
            F.sum("checks").alias("total_quality_checks"),
            F.sum("passed").alias("passed_checks"),
            percent(F.sum("passed"), F.sum("checks"), 2).alias("quality_score_pct"),
            F.sum(F.when(F.col("severity") == "CRITICAL", F.col("failed")).otherwise(0)).alias(
                "critical_failures"
            ),
        )
        .orderBy(F.desc("quality_score_pct"))
    )


def stewardship_coverage(
    ds: DataFrame, domain: DataFrame, owner: DataFrame, party: DataFrame, distinct: bool = False
) -> DataFrame:
    """Ownership coverage by domain.

    A dataset with several owners counts once per owner, as the documented query does;
    ``distinct`` counts each dataset once.
    """
    owners = (
        owner.groupBy("dataset_id", "party_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(party.select("party_id", F.col("party_id").alias("known_party")), "party_id", "left")
        .select("dataset_id", F.lit(True).alias("owned"), "known_party", "n")
    )
    placed = ds.select("dataset_id", "domain_id", "is_cde").join(
        domain.select("domain_id", "domain_name"), "domain_id"
    )
    rows = placed.join(owners, "dataset_id", "left")
    if distinct:
        # One row per dataset for the counts, one per steward for the distinct stewards.
        per_dataset = (
            rows.groupBy("domain_name", "dataset_id")
            .agg(F.bool_or("is_cde").alias("is_cde"), F.bool_or("owned").alias("owned"))
            .withColumn("n", F.lit(1))
        )
        stewards = rows.groupBy("domain_name").agg(
            F.count_distinct("known_party").alias("unique_stewards")
        )
        counts = per_dataset.groupBy("domain_name").agg(*_coverage())
        out = counts.join(stewards, "domain_name")
    else:
        out = rows.groupBy("domain_name").agg(
            *_coverage(), F.count_distinct("known_party").alias("unique_stewards")
        )
    return out.withColumn(
        "ownership_coverage_pct", percent("datasets_with_owners", "total_datasets", 2)
    ).orderBy(F.desc("ownership_coverage_pct"))


def _coverage():
    n = F.coalesce("n", F.lit(1))
    return [
        F.sum(n).alias("total_datasets"),
        F.sum(F.when(F.col("owned"), n).otherwise(0)).alias("datasets_with_owners"),
        F.sum(F.when(F.col("is_cde"), n).otherwise(0)).alias("cde_count"),
        F.sum(F.when(F.col("is_cde") & F.col("owned"), n).otherwise(0)).alias("cde_with_owners"),
    ]


def policy_compliance(
    policy: DataFrame, control: DataFrame, test: DataFrame, as_of: AsOf, days: int = 90
) -> DataFrame:
    counted = (
        test.where(since("executed_at", as_of, days))
        .groupBy("control_id")
        .agg(*_outcome_counts("n"), F.max("executed_at").alias("last_test"))
    )
    return (
        policy.select("policy_id", "policy_type")
        .join(control.select("policy_id", "control_id"), "policy_id")
        .join(counted, "control_id")
        .groupBy("policy_type")
        .agg(
            F.sum("n").alias("total_controls"),
            F.sum("passed").alias("passing_controls"),
            F.sum("failed").alias("failing_controls"),
            percent(F.sum("passed"), F.sum("n"), 2).alias("compliance_rate_pct"),
            F.max("last_test").alias("last_test_date"),
        )
        .orderBy("compliance_rate_pct")
    )


def privacy_compliance(
    ds: DataFrame, assessment: DataFrame, classes: tuple[str, ...] = ("PII", "CONFIDENTIAL")
) -> DataFrame:
    scored = assessment.groupBy("dataset_id").agg(
        F.count("assessment_id").alias("assessments"),
        F.sum(rating_score("risk_rating")).alias("score_sum"),
        F.count(rating_score("risk_rating")).alias("score_n"),
    )
    sensitive = ds.where(F.col("classification").isin(*classes)).select(
        "classification", "dataset_id", "is_cde"
    )
    return (
        sensitive.join(scored, "dataset_id", "left")
        .groupBy("classification", "dataset_id")
        .agg(
            F.max(F.col("assessments") > 0).alias("assessed"),
            F.bool_or("is_cde").alias("is_cde"),
            F.sum("score_sum").alias("score_sum"),
            F.sum("score_n").alias("score_n"),
        )
        .groupBy("classification")
        .agg(
            F.count("dataset_id").alias("total_datasets"),
            count_where(F.col("assessed")).alias("assessed_datasets"),
            count_where(F.col("is_cde")).alias("cde_datasets"),
            F.try_divide(F.sum("score_sum").cast("double"), F.sum("score_n").cast("double")).alias(
                "avg_privacy_risk"
            ),
        )
        .orderBy(F.desc("avg_privacy_risk"))
    )


def risk_summary(risk: DataFrame, test: DataFrame, as_of: AsOf, days: int = 365) -> DataFrame:
    """By category and severity; a risk counts once per control test, or once without any.

    Only tests of the risks of the period are counted.
    """
    kept = risk.where(since("created_at", as_of, days))
    per_control = (
        test.join(kept.select("risk_id"), "risk_id", "left_semi")
        .groupBy("risk_id", "control_id")
        .agg(
            F.count(F.lit(1)).alias("n"), count_where(F.col("outcome") == "PASS").alias("passed")
        )
    )
    rows = kept.join(per_control, "risk_id", "left")
    n = F.coalesce("n", F.lit(1))
    score = rating_score("likelihood") * rating_score("impact")
    scored_rows = F.sum(F.when(score.isNotNull(), n))
    return (
        rows.groupBy(F.col("category").alias("risk_category"), "severity")
        .agg(
            F.sum(n).alias("risk_count"),
            F.try_divide(F.sum(score * n).cast("double"), scored_rows.cast("double")).alias(
                "avg_risk_score"
            ),
            F.sum(F.when(F.col("status") == "OPEN", n).otherwise(0)).alias("open_risks"),
            F.sum(F.when(F.col("status") == "MITIGATED", n).otherwise(0)).alias("mitigated_risks"),
            F.count_distinct("control_id").alias("associated_controls"),
            (F.sum(zero_if_null("passed")).cast("double") / F.sum(n)).alias(
                "control_effectiveness"
            ),
        )
        .orderBy(F.desc("avg_risk_score"))
    )


def change_metrics(
    cr: DataFrame, approvals: DataFrame, as_of: AsOf, months: int = 12
) -> DataFrame:
    """By month and scope type; a change is approved at its last APPROVE decision."""
    approved = (
        approvals.where("decision = 'APPROVE'")
        .groupBy("cr_id")
        .agg(F.max("decided_at").alias("approved_at"))
    )
    start = months_before(as_of, months)
    month = F.to_date(F.date_trunc("month", "created_at"))
    return (
        cr.where(F.col("created_at") >= start)
        .join(approved, "cr_id", "left")
        .groupBy(month.alias("change_month"), F.col("scope_type").alias("change_type"))
        .agg(
            F.count(F.lit(1)).alias("total_changes"),
            count_where(F.col("status") == "APPROVED").alias("approved_changes"),
            count_where(F.col("status") == "REJECTED").alias("rejected_changes"),
            F.avg(days_crossed("created_at", "approved_at")).alias("avg_approval_days"),
        )
        .orderBy(F.desc("change_month"), "change_type")
    )


def months_before(as_of: AsOf, months: int):
    day = to_datetime(as_of).date()
    index = day.year * 12 + day.month - 1 - months
    year, month = divmod(index, 12)
    first = dt.date(year, month + 1, 1)
    following = dt.date(year + (month == 11), (month + 1) % 12 + 1, 1)
    last = (following - dt.timedelta(days=1)).day
    return moment(first.replace(day=min(day.day, last)))


def etl_health(run: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    return (
        run.where(since("started_at", as_of, days))
        .groupBy("system_id")
        .agg(
            F.count(F.lit(1)).alias("total_runs"),
            count_where(F.col("status") == "SUCCESS").alias("successful_runs"),
            count_where(F.col("status") == "FAILED").alias("failed_runs"),
            F.avg(minutes_crossed("started_at", "ended_at")).alias("avg_duration_minutes"),
            F.max("started_at").alias("last_run_time"),
        )
        .orderBy("system_id")
    )


def etl_quality(ds: DataFrame, res: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    counted = (
        res.where(since("created_at", as_of, days))
        .groupBy("dataset_id")
        .agg(
            F.count("rule_id").alias("checks"),
            count_where(F.col("outcome") == "PASS").alias("passed"),
        )
    )
    return (
        ds.select("dataset_id", "system_id", "domain_id")
        .join(counted, "dataset_id")
        .groupBy("system_id", "domain_id")
        .agg(
            F.count_distinct("dataset_id").alias("total_datasets"),
            F.sum("checks").alias("total_quality_checks"),
            F.sum("passed").alias("passed_checks"),
            percent(F.sum("passed"), F.sum("checks"), 2).alias("pass_rate_pct"),
        )
        .orderBy("system_id", "domain_id")
    )


# --- monitoring --------------------------------------------------------------------------


def recent_registrations(
    ds: DataFrame, as_of: AsOf, days: int = 1, ordered: bool = False
) -> DataFrame:
    found = ds.where(since("updated_at", as_of, days)).select(
        "dataset_id", "catalog_name", "dv_layer", "classification", "updated_at"
    )
    return found.orderBy(F.desc("updated_at")) if ordered else found


def row_count_history(
    res: DataFrame, ds: DataFrame, as_of: AsOf, days: int = 1, metric: str = "row_count"
) -> DataFrame:
    """Recent results of registered datasets with one number read from their JSON."""
    number = F.get_json_object("metrics_summary", f"$.{metric}").try_cast("bigint")
    recent = res.where(since("created_at", as_of, days)).select(
        "dataset_id", "outcome", number.alias("row_count"), "created_at"
    )
    return recent.join(ds.select("dataset_id", "catalog_name"), "dataset_id").select(
        "catalog_name", "outcome", "row_count", "created_at"
    )


def audit_trail(test: DataFrame, control_id: str, k: int = 10) -> DataFrame:
    """The ``k`` newest tests of one control; ties in time fall to the greatest test."""
    return (
        test.where(F.col("control_id") == control_id)
        .select("test_id", "outcome", "details", "executed_at")
        .orderBy(F.desc("executed_at"), F.desc("test_id"), F.desc("outcome"), F.desc("details"))
        .limit(k)
    )


def catalog_coverage(ds: DataFrame, as_of: AsOf, days: int = 7) -> DataFrame:
    return ds.where(since("updated_at", as_of, days)).agg(
        F.lit("Catalog Coverage").alias("metric"), F.count(F.lit(1)).alias("value")
    )


def quality_coverage(res: DataFrame, as_of: AsOf, days: int = 1) -> DataFrame:
    return res.where(since("created_at", as_of, days)).agg(
        F.lit("Quality Checks").alias("metric"),
        F.count_distinct("dataset_id").alias("datasets_with_metrics"),
    )

