"""Executive numbers in long form: one row per number and dimension."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import AsOf, days_crossed, moment, since
from ..functions.ratios import count_where, percent, rating_score
from ..operators import metrics as m
from ..operators.common import union_all
from ..operators.lineage import lineage_coverage

EVERYTHING = "ALL"


def _kpi(df: DataFrame, name: str, value: Column, dimension: Column | None = None) -> DataFrame:
    return df.select(
        F.lit(name).alias("kpi"),
        (F.lit(EVERYTHING) if dimension is None else dimension).alias("dimension"),
        value.cast("double").alias("value"),
    )


def executive_kpis(
    t: Mapping[str, DataFrame], as_of: AsOf, change_as_of: AsOf | None = None
) -> DataFrame:
    """Quality, ownership, compliance, risk, lineage, freshness, run, privacy and change numbers.

    ``t`` maps table names to frames. Scores over domains or policies are weighted by the
    number of tests behind them.
    """
    ds = t["dim_dataset"]
    by_domain = m.daily_quality_metrics(t["dq_result"], ds, t["dim_domain"], as_of)
    quality = by_domain.where("domain_name IS NOT NULL").agg(
        percent(F.sum("passed_tests"), F.sum("total_dq_tests")).alias("v")
    )
    owned = t["map_dataset_owner"].select("dataset_id").distinct()
    ownership = (
        ds.select("dataset_id")
        .join(owned.withColumn("owned", F.lit(1)), "dataset_id", "left")
        .agg(percent(F.count("owned"), F.count(F.lit(1))).alias("v"))
    )
    compliance = m.policy_compliance(
        t["policy_registry"], t["control_registry"], t["control_test"], as_of
    ).agg(percent(F.sum("passing_controls"), F.sum("total_controls")).alias("v"))
    exposure = (
        t["risk_item"]
        .where("status = 'OPEN'")
        .groupBy("severity")
        .agg(F.sum(rating_score("likelihood") * rating_score("impact")).alias("v"))
    )
    freshness = ds.agg(days_crossed(F.max("updated_at"), moment(as_of)).alias("v"))
    runs = (
        t["process_run"]
        .where(since("started_at", as_of, 30))
        .agg(percent(count_where(F.col("status") == "SUCCESS"), F.count(F.lit(1))).alias("v"))
    )
    privacy = m.privacy_compliance(ds, t["privacy_assessment"]).agg(
        percent(F.sum("assessed_datasets"), F.sum("total_datasets")).alias("v")
    )
    approvals = _approval_days(t["change_request"], t["change_approval"], change_as_of or as_of)
    coverage = lineage_coverage(t["lineage_edge"], ds)
    v = F.col("v")
    return union_all(
        [
            _kpi(quality, "data_quality_score", v),
            _kpi(ownership, "ownership_coverage_pct", v),
            _kpi(compliance, "policy_compliance_rate_pct", v),
            _kpi(exposure, "risk_exposure", v, F.col("severity")),
            _kpi(coverage, "lineage_coverage_pct", F.col("lineage_coverage_pct")),
            _kpi(freshness, "data_freshness_days", v),
            _kpi(runs, "processing_success_rate_pct", v),
            _kpi(privacy, "privacy_assessment_coverage_pct", v),
            _kpi(approvals, "change_approval_days", v),
        ]
    )


def _approval_days(cr: DataFrame, approvals: DataFrame, as_of: AsOf) -> DataFrame:
    """Mean days from request to approval over the last twelve months."""
    approved = (
        approvals.where("decision = 'APPROVE'")
        .groupBy("cr_id")
        .agg(F.max("decided_at").alias("approved_at"))
    )
    recent = cr.where(F.col("created_at") >= m.months_before(as_of, 12)).select(
        "cr_id", "created_at"
    )
    return recent.join(approved, "cr_id").agg(
        F.avg(days_crossed("created_at", "approved_at")).alias("v")
    )
