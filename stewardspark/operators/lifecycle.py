"""Effective dates, retention, exceptions, attestations, certifications, changes, RACI."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import AsOf, days_crossed, moment
from ..functions.ratios import count_where, percent, zero_if_null
from .common import last_known, newest, running_max


def in_force(at: Column, from_col: str, to_col: str) -> Column:
    """``at`` lies in the half-open interval; a NULL end is open."""
    return (F.col(from_col) <= at) & (F.col(to_col).isNull() | (F.col(to_col) > at))


def as_of(df: DataFrame, at: AsOf, from_col="effective_from", to_col="effective_to") -> DataFrame:
    """Rows in force at one moment."""
    return df.where(in_force(moment(at), from_col, to_col))


def result_owner_as_of(
    facts: DataFrame,
    owners: DataFrame,
    ts: str = "created_at",
    bucket: str = "day",
    split_rows: int | None = None,
) -> DataFrame:
    """Each fact with the ownership that last began before it, if that is still in force.

    Of owners that began at the same time the greatest party id counts. An ownership that
    had ended by then leaves the owner NULL. Give ``split_rows`` where a dataset may hold more
    facts in a bucket than a task should sort.
    """
    payload = ["party_id", "role_type", "effective_from", "effective_to"]
    known = last_known(
        facts, owners, ["dataset_id"], ts, "effective_from", payload, bucket, split_rows
    )
    held = in_force(F.col(ts), "effective_from", "effective_to")
    return known.select(
        *facts.columns,
        F.when(held, F.col("party_id")).alias("owner_party_id"),
        F.when(held, F.col("role_type")).alias("owner_role"),
    )


def version_parts(version: Column | str) -> Column:
    """The numbers of a version text, so that 10.0.0 sorts after 9.0.0; text breaks ties."""
    text = F.col(version) if isinstance(version, str) else version
    numbers = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda p: p.cast("decimal(38,0)"))
    return F.struct(numbers.alias("numbers"), text.alias("text"))


def version_in_force(
    df: DataFrame, at: AsOf, key: str = "dataset_id", id_col: str = "contract_id"
) -> DataFrame:
    """The version in force at a moment, one per key: the one that began last.

    Of versions that began together the greatest by number counts.
    """
    order = [F.desc("effective_from"), version_parts("version").desc(), F.desc(id_col)]
    return newest(as_of(df, at), [key], order)


def interval_overlaps(
    df: DataFrame,
    key: str,
    id_col: str,
    from_col: str = "effective_from",
    to_col: str = "effective_to",
    bucket: str = "month",
    split_rows: int | None = None,
) -> DataFrame:
    """Intervals that begin before an earlier interval of the same key has ended.

    A NULL end is open; a NULL start is open as well and counts as the beginning of time.
    """
    kind = dict(df.dtypes)[from_col]
    end = F.coalesce(F.col(to_col), moment("9999-12-31").cast(kind))
    start = F.coalesce(F.col(from_col), moment("0001-01-01").cast(kind))
    kept = df.select(key, id_col, from_col, to_col, start.alias("_start"), end.alias("_end"))
    reached = running_max(
        kept, [key], ["_start", id_col], "_start", F.col("_end"), "covered_until", bucket,
        split_rows=split_rows,
    )
    return reached.where("_start < covered_until").drop("_start", "_end")


def retention_due(ds: DataFrame, policies: DataFrame, at: AsOf) -> DataFrame:
    """Datasets with their age against the retention policy; holds suspend expiry."""
    rules = policies.select(
        F.col("policy_id").alias("retention_policy_id"),
        "duration_days",
        "disposition",
        "legal_hold_flag",
    )
    age = days_crossed("created_at", moment(at))
    due = (F.col("age_days") > F.col("duration_days")) & ~F.coalesce(
        "legal_hold_flag", F.lit(False)
    )
    return (
        ds.select("dataset_id", "retention_policy_id", "created_at")
        .join(rules, "retention_policy_id")
        .withColumn("age_days", age)
        .withColumn("expired", due)
        .withColumn("action", F.when(due, F.col("disposition")).otherwise("KEEP"))
        .select("dataset_id", "retention_policy_id", "age_days", "legal_hold_flag", "expired",
                "action")
    )


def retention_summary(due: DataFrame) -> DataFrame:
    return due.groupBy("action").agg(F.count(F.lit(1)).alias("datasets"))


def exception_status(df: DataFrame, at: AsOf) -> DataFrame:
    """Access exceptions with their state at a moment.

    Only an approved exception can be active; one past its end counts as expired although
    its row still says approved, and one before its start is pending.
    """
    now = moment(at)
    approved = F.col("status") == "APPROVED"
    state = (
        F.when(~approved, F.col("status"))
        .when(F.col("effective_to") <= now, "EXPIRED")
        .when(F.col("effective_from") > now, "PENDING")
        .otherwise("ACTIVE")
    )
    return df.withColumn("effective_status", state)


def attestation_coverage(df: DataFrame, start: AsOf, end: AsOf) -> DataFrame:
    """Scopes with attestations that touch a period, and whether one was approved."""
    first, last = moment(start).cast("date"), moment(end).cast("date")
    touching = df.where((F.col("period_start") <= last) & (F.col("period_end") >= first))
    return touching.groupBy("scope_id").agg(
        F.count(F.lit(1)).alias("attestations"),
        count_where(F.col("status") == "APPROVED").alias("approved"),
        F.bool_or(F.col("status") == "APPROVED").alias("covered"),
    )


def interval_union(
    df: DataFrame, key: str, from_col: str, to_col: str, bucket: str = "month", split_rows: int | None = None,
) -> DataFrame:
    """The disjoint spans that the intervals of each key cover together, with the gap before each.

    Intervals reach from ``from_col`` to before ``to_col``; those that touch join up, empty
    ones and those without a start or an end are left out. Columns: the key, ``span_from``,
    ``span_to`` and ``previous_to``, the end of the span before. The sweep runs inside (key,
    time bucket), so a key with very many intervals is spread over time.
    """
    kept = df.where(F.col(from_col) < F.col(to_col)).select(
        F.col(key), F.col(from_col).alias("_from"), F.col(to_col).alias("_to")
    )
    order = ["_from", "_to"]
    swept = running_max(kept, [key], order, "_from", F.col("_to"), "_reached", bucket, split_rows=split_rows)
    fresh = F.col("_reached").isNull() | (F.col("_from") > F.col("_reached"))
    # Starts only grow, so the newest fresh start is the start of the span a row belongs to.
    placed = running_max(
        swept, [key], order, "_from", F.when(fresh, F.col("_from")), "_span", bucket, include_current=True,
        split_rows=split_rows,
    )
    return placed.groupBy(key, F.col("_span").alias("span_from")).agg(
        F.max("_to").alias("span_to"),
        F.max(F.when(F.col("_from") == F.col("_span"), F.when(fresh, F.col("_reached")))).alias("previous_to"),
    )


def attested_days(df: DataFrame, start: AsOf, end: AsOf, split_rows: int | None = None) -> DataFrame:
    """Days of a period that approved attestations cover, per scope, and the gaps that are left.

    Both ends of the period and of an attestation are days that count. Every scope of the
    table has a row: ``covered_days``, ``gap_days``, ``gaps`` and ``longest_gap`` in days.
    """
    first, after = moment(start).cast("date"), F.date_add(moment(end).cast("date"), 1)
    clipped = df.where(F.col("status") == "APPROVED").select(
        "scope_id", F.greatest("period_start", first).alias("_a"), F.least(F.date_add("period_end", 1), after).alias("_b")
    ).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    spans = interval_union(clipped, "scope_id", "_a", "_b", split_rows=split_rows)
    gap = F.datediff("span_from", "previous_to")
    lead, trail = F.datediff(F.min("span_from"), first), F.datediff(after, F.max("span_to"))
    covered = spans.groupBy("scope_id").agg(
        F.sum(F.datediff("span_to", "span_from")).alias("covered_days"),
        (F.count("previous_to") + (lead > 0).cast("bigint") + (trail > 0).cast("bigint")).alias("gaps"),
        F.greatest(F.max(gap), lead, trail).cast("bigint").alias("longest_gap"),
    )
    days = F.datediff(after, first).cast("bigint")
    scopes = df.where("scope_id IS NOT NULL").select("scope_id").distinct()
    return scopes.join(covered, "scope_id", "left").select(
        "scope_id", F.coalesce("covered_days", F.lit(0).cast("bigint")).alias("covered_days"),
        (days - F.coalesce("covered_days", F.lit(0))).alias("gap_days"),
        F.coalesce("gaps", F.lit(1).cast("bigint")).alias("gaps"), F.coalesce("longest_gap", days).alias("longest_gap"),
    )


def current_certification(events: DataFrame, ds: DataFrame) -> DataFrame:
    """Certification by the newest event, and whether the registry disagrees with it."""
    last = newest(events, ["dataset_id"], [F.desc("effective_at"), F.desc("event_id")]).select(
        "dataset_id", F.col("status").alias("event_status"), "effective_at"
    )
    registered = ds.select("dataset_id", "certification")
    return last.join(registered, "dataset_id", "left").withColumn(
        "drifted", ~F.col("event_status").eqNullSafe(F.upper("certification"))
    )


def change_state(cr: DataFrame, approvals: DataFrame) -> DataFrame:
    """State of each change from the newest decision of each approver.

    One rejection rejects, one request for changes asks for changes, otherwise approval
    stands; a change without decisions is pending.
    """
    last = newest(
        approvals, ["cr_id", "approver_party_id"], [F.desc("decided_at"), F.desc("approval_id")]
    )
    votes = last.groupBy("cr_id").agg(
        F.count(F.lit(1)).alias("approvers"),
        count_where(F.col("decision") == "REJECT").alias("rejects"),
        count_where(F.col("decision") == "REQUEST_CHANGES").alias("change_requests"),
    )
    state = (
        F.when(F.col("approvers").isNull(), "PENDING")
        .when(F.col("rejects") > 0, "REJECTED")
        .when(F.col("change_requests") > 0, "CHANGES_REQUESTED")
        .otherwise("APPROVED")
    )
    return (
        cr.select("cr_id", "status")
        .join(votes, "cr_id", "left")
        .select("cr_id", "status", state.alias("decided_state"),
                zero_if_null("approvers").alias("approvers"))
    )


def raci_violations(raci: DataFrame) -> DataFrame:
    """Scopes without exactly one accountable or without any responsible party."""
    counts = raci.groupBy("scope_type", "scope_id").agg(
        count_where(F.col("raci_role") == "A").alias("accountable"),
        count_where(F.col("raci_role") == "R").alias("responsible"),
    )
    return counts.where("accountable <> 1 OR responsible = 0")


def cde_coverage(cde: DataFrame, attrs: DataFrame, rule: DataFrame) -> DataFrame:
    """Critical elements by materiality: mapped to a column, and on a dataset with a rule."""
    ruled = rule.where("enabled_flag").select("dataset_id").distinct()
    mapped = (
        attrs.where("cde_id IS NOT NULL")
        .select("cde_id", "dataset_id")
        .distinct()
        .join(ruled.withColumn("ruled", F.lit(True)), "dataset_id", "left")
        .groupBy("cde_id")
        .agg(F.lit(True).alias("mapped"), F.bool_or("ruled").alias("ruled"))
    )
    return (
        cde.select("cde_id", "materiality")
        .join(mapped, "cde_id", "left")
        .groupBy("materiality")
        .agg(
            F.count(F.lit(1)).alias("cdes"),
            count_where(F.col("mapped")).alias("mapped_cdes"),
            count_where(F.col("ruled")).alias("ruled_cdes"),
        )
        .withColumn("mapped_pct", percent("mapped_cdes", "cdes"))
    )


def owners_as_of(owners: DataFrame, at: AsOf, datasets: Sequence[str] | None = None) -> DataFrame:
    """Ownership rows in force at a moment, optionally of some datasets only."""
    held = as_of(owners, at).select("dataset_id", "party_id", "role_type")
    return held if datasets is None else held.where(F.col("dataset_id").isin(list(datasets)))
