"""Row access predicate and masking Columns for a role known when the plan is built."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The roles, prefixes, labels and mask texts of the governance policies.
FULL_ACCESS_ROLES = ("GOVERNANCE_ADMIN", "AUDIT_ROLE", "DATA_STEWARD", "GOVERNANCE_ANALYST")
DOMAIN_PREFIXES = {
    "RETAIL_DATA_ANALYST": ("RETAIL", "DEPOSIT"),
    "LENDING_DATA_ANALYST": ("LENDING",),
    "CARDS_DATA_ANALYST": ("CARDS",),
    "TREASURY_DATA_ANALYST": ("TREASURY",),
}
OPEN_CLASSES = ("Public", "Internal")
CLASS_ROLES = {
    "Confidential": ("DATA_STEWARD", "GOVERNANCE_ANALYST", "GOVERNANCE_ADMIN"),
    "PII": ("GOVERNANCE_ADMIN", "DATA_STEWARD", "PRIVACY_OFFICER"),
    "PCI": ("GOVERNANCE_ADMIN", "PCI_ANALYST"),
}
SAMPLE_EXEMPT_ROLES = ("GOVERNANCE_ADMIN", "DATA_STEWARD", "AUDIT_ROLE")
EMAIL_EXEMPT_ROLES = ("GOVERNANCE_ADMIN", "DATA_STEWARD")
EVIDENCE_EXEMPT_ROLES = ("GOVERNANCE_ADMIN", "AUDIT_ROLE")
SAMPLE_KEEP_LEFT, SAMPLE_KEEP_RIGHT, SAMPLE_MIN_LENGTH = 3, 2, 10
SAMPLE_GAP, SAMPLE_MASK, EMAIL_MASK, EVIDENCE_MASK = (
    "*****",
    "***MASKED***",
    "***",
    "evidence://masked",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def row_access(
    role: str,
    domain: Column | str | None,
    classification: Column | str | None,
    case_sensitive: bool = True,
) -> Column:
    """Predicate that keeps the rows ``role`` may read.

    Only the terms that can hold for this role are emitted, as one OR of plain
    comparisons, so the class test reaches the Parquet filters. ``None`` stands for a
    view without that column. NULL labels give NULL, which a filter drops.
    """
    if role in FULL_ACCESS_ROLES:
        return F.lit(True)
    terms: list[Column] = []
    if classification is not None:
        classes = list(OPEN_CLASSES)
        classes += [name for name, roles in CLASS_ROLES.items() if role in roles]
        label = _col(classification)
        if not case_sensitive:
            label, classes = F.upper(label), [c.upper() for c in classes]
        terms.append(label.isin(classes))
    if domain is not None:
        terms += [_col(domain).ilike(f"{p}%") for p in DOMAIN_PREFIXES.get(role, ())]
    return reduce(lambda a, b: a | b, terms) if terms else F.lit(False)


def row_access_flag(role: str, domain, classification, case_sensitive: bool = True) -> Column:
    """``row_access`` as a two-valued Column for projections."""
    return F.coalesce(row_access(role, domain, classification, case_sensitive), F.lit(False))


def mask_sensitive(value: Column | str, role: str) -> Column:
    v = _col(value)
    if role in SAMPLE_EXEMPT_ROLES:
        return v
    ends = F.concat(
        F.left(v, F.lit(SAMPLE_KEEP_LEFT)), F.lit(SAMPLE_GAP), F.right(v, F.lit(SAMPLE_KEEP_RIGHT))
    )
    hidden = F.when(F.length(v) > SAMPLE_MIN_LENGTH, ends).otherwise(F.lit(SAMPLE_MASK))
    return F.when(v.isNotNull(), hidden)


def mask_email(value: Column | str, role: str) -> Column:
    """Hides the local part: the text between the first and second ``@`` is kept."""
    v = _col(value)
    if role in EMAIL_EXEMPT_ROLES:
        return v
    return F.concat(F.lit(EMAIL_MASK), F.split_part(v, F.lit("@"), F.lit(2)))


def mask_evidence(value: Column | str, role: str) -> Column:
    v = _col(value)
    if role in EVIDENCE_EXEMPT_ROLES:
        return v
    return F.when(v.isNotNull(), F.lit(EVIDENCE_MASK))


def register_sql_masks(spark: SparkSession, role: str) -> None:
    """The masks for ``role`` as temporary SQL functions, inlined by the optimizer."""
    for name, fn in (
        ("mask_sensitive", _sensitive_sql),
        ("mask_email", _email_sql),
        ("mask_evidence", _evidence_sql),
    ):
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(val STRING) RETURNS STRING "
            f"RETURN {fn(role)}"
        )


def _sensitive_sql(role: str) -> str:
    if role in SAMPLE_EXEMPT_ROLES:
        return "val"
    return (
        f"IF(val IS NULL, NULL, IF(length(val) > {SAMPLE_MIN_LENGTH}, "
        f"left(val, {SAMPLE_KEEP_LEFT}) || '{SAMPLE_GAP}' || right(val, {SAMPLE_KEEP_RIGHT}), "
        f"'{SAMPLE_MASK}'))"
    )


def _email_sql(role: str) -> str:
    return "val" if role in EMAIL_EXEMPT_ROLES else f"'{EMAIL_MASK}' || split_part(val, '@', 2)"


def _evidence_sql(role: str) -> str:
    return "val" if role in EVIDENCE_EXEMPT_ROLES else f"IF(val IS NULL, NULL, '{EVIDENCE_MASK}')"
