"""Enriched views over registry and log tables, and their governed form per role."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policies import mask_email, mask_evidence, row_access
from .common import newest

OWNER_SEPARATOR = "; "


def _party(party: DataFrame, key: str, name: str, email: str) -> DataFrame:
    return party.select(
        F.col("party_id").alias(key), F.col("party_name").alias(name), F.col("email").alias(email)
    )


def _dataset(ds: DataFrame) -> DataFrame:
    return ds.select("dataset_id", F.col("domain_id").alias("domain_name"), "classification")


def latest_results(
    res: DataFrame, run: DataFrame, keys: Sequence[str] = ("rule_id",)
) -> DataFrame:
    """Newest result per key among registered runs; ties fall to the greatest ids."""
    started = run.select("run_id", "started_at")
    order = [
        F.desc(c) for c in ("started_at", "run_id", "rule_id", "dataset_id", "evidence_ref")
    ]
    return newest(res.join(started, "run_id"), keys, order)


def today_health(
    ds: DataFrame, res: DataFrame, run: DataFrame, keys: Sequence[str] = ("rule_id",)
) -> DataFrame:
    """Every dataset with the newest results that point at it.

    The newest result is taken per rule, so a rule shared by several datasets shows on
    one of them only; ``keys=("dataset_id", "rule_id")`` keeps one per dataset.
    """
    last = latest_results(
        res.select("run_id", "rule_id", "dataset_id", "outcome", "evidence_ref"), run, keys
    ).select(
        "dataset_id",
        F.col("started_at").alias("last_dq_run_at"),
        F.col("outcome").alias("last_dq_outcome"),
    )
    shown = ds.select(
        "dataset_id", F.col("domain_id").alias("domain_name"), "classification", "certification"
    )
    return shown.join(last, "dataset_id", "left")


def with_scope(rows: DataFrame, ds: DataFrame) -> DataFrame:
    """Adds class and domain of the dataset that a dataset-scoped control points at."""
    scoped = ds.select(
        F.col("dataset_id").alias("scope_id"), F.lit("DATASET").alias("scope_type"),
        "classification", F.col("domain_id").alias("domain_name"),
    )
    return rows.join(scoped, ["scope_type", "scope_id"], "left").select(
        *rows.columns, "classification", "domain_name"
    )


def dq_results_enriched(
    res: DataFrame, run: DataFrame, ds: DataFrame, rule: DataFrame, party: DataFrame
) -> DataFrame:
    """Results of registered runs with run, dataset, rule and rule owner."""
    owned_rule = rule.select("rule_id", "rule_name", "severity", "owner_party_id").join(
        _party(party, "owner_party_id", "owner_name", "owner_email"), "owner_party_id", "left"
    )
    return (
        res.join(run.select("run_id", "started_at", "ended_at"), "run_id")
        .join(_dataset(ds), "dataset_id", "left")
        .join(owned_rule.drop("owner_party_id"), "rule_id", "left")
        .select(
            "run_id", "rule_id", "dataset_id", "outcome", "metrics_summary", "evidence_ref",
            "domain_name", "classification", "started_at", "ended_at", "rule_name", "severity",
            "owner_name", "owner_email",
        )
    )


def control_results_enriched(test: DataFrame, control: DataFrame, party: DataFrame) -> DataFrame:
    owned = control.select(
        "control_id", "control_name", "severity", "scope_type", "scope_id", "owner_party_id"
    ).join(_party(party, "owner_party_id", "owner_name", "owner_email"), "owner_party_id", "left")
    return test.join(owned.drop("owner_party_id"), "control_id", "left").select(
        "test_id", "control_id", "control_name", "severity", "run_id", "executed_at", "outcome",
        "details", "scope_type", "scope_id", "owner_name", "owner_email",
    )


def dataset_owners(
    ds: DataFrame,
    owner: DataFrame,
    party: DataFrame,
    email: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Datasets with their distinct ``name <email>`` owners in one sorted list.

    An owner without an email has a NULL label and is left out; no owners give ``''``.
    ``email`` masks each address before the list is built.
    """
    address = F.col("email") if email is None else email(F.col("email"))
    label = F.concat("party_name", F.lit(" <"), address, F.lit(">"))
    labels = party.select("party_id", label.alias("label"))
    lists = (
        owner.select("dataset_id", "party_id")
        .distinct()
        .join(labels, "party_id")
        .groupBy("dataset_id")
        .agg(F.array_join(F.array_sort(F.collect_set("label")), OWNER_SEPARATOR).alias("owners"))
    )
    return (
        _dataset(ds)
        .distinct()
        .join(lists, "dataset_id", "left")
        .withColumn("owner_emails", F.coalesce("owners", F.lit("")))
        .drop("owners")
    )


def business_glossary(term: DataFrame, domain: DataFrame, party: DataFrame) -> DataFrame:
    known = domain.select("domain_id", F.col("domain_id").alias("domain_name"))
    return (
        term.join(known, "domain_id", "left")
        .join(
            _party(party, "steward_party_id", "steward_name", "steward_email"),
            "steward_party_id",
            "left",
        )
        .select(
            "term_id", "term_name", "definition", "domain_name", "steward_name",
            "steward_email", "status",
        )
    )


def data_contracts(contract: DataFrame, ds: DataFrame, party: DataFrame) -> DataFrame:
    return (
        contract.join(_dataset(ds), "dataset_id", "left")
        .join(
            _party(party, "producer_party_id", "producer_name", "producer_email"),
            "producer_party_id",
            "left",
        )
        .join(
            _party(party, "consumer_party_id", "consumer_name", "consumer_email"),
            "consumer_party_id",
            "left",
        )
        .select(
            "contract_id", "dataset_id", "domain_name", "classification", "version", "status",
            "producer_name", "producer_email", "consumer_name", "consumer_email",
        )
    )


def risk_dashboard(risk: DataFrame, party: DataFrame) -> DataFrame:
    return risk.join(
        _party(party, "owner_party_id", "risk_owner", "owner_email"), "owner_party_id", "left"
    ).select(
        "risk_id", "title", "category", "severity", "likelihood", "impact", "status",
        "risk_owner", "owner_email",
    )


def govern(
    df: DataFrame,
    role: str,
    domain_col: str | None = None,
    class_col: str | None = None,
    masks: Mapping[str, Callable[[Column, str], Column]] | None = None,
    case_sensitive: bool = True,
) -> DataFrame:
    """``df`` as ``role`` may see it: rows by domain and class, columns masked.

    Spark offers no security barrier inside a plan: hand untrusted users the written
    output of this function, not the function.
    """
    kept = df.where(row_access(role, domain_col, class_col, case_sensitive))
    return kept.withColumns({c: mask(F.col(c), role) for c, mask in (masks or {}).items()})


def with_domain_label(
    view: DataFrame, domain: DataFrame, key: str = "domain_name", out: str = "domain_label"
) -> DataFrame:
    """Adds the real domain name: the views carry the domain id under ``domain_name``."""
    names = domain.select(F.col("domain_id").alias(key), F.col("domain_name").alias(out))
    return view.join(names, key, "left")


DQ_RESULT_MASKS = {"evidence_ref": mask_evidence, "owner_email": mask_email}
OWNER_EMAIL_MASK = {"owner_email": mask_email}
GLOSSARY_MASKS = {"steward_email": mask_email}
CONTRACT_MASKS = {"producer_email": mask_email, "consumer_email": mask_email}
