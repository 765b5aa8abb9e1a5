import datetime as dt
import itertools

import pytest
from pyspark.sql import functions as F

from stewardspark.functions import clock, labels, policies


@pytest.mark.parametrize(
    "schema, long, short",
    [
        ("raw_landing", "BRONZE", "BRONZE"),
        ("bronze", "BRONZE", "SILVER"),
        ("stg_STAGING", "SILVER", "SILVER"),
        ("data_mart", "GOLD", "GOLD"),
        ("GOLD", "GOLD", "SILVER"),
        ("raw_gold", "BRONZE", "BRONZE"),
        ("misc", "SILVER", "SILVER"),
        (None, "SILVER", "SILVER"),
    ],
)
def test_dv_layer(spark, schema, long, short):
    df = spark.createDataFrame([(schema,)], "s string")
    assert df.select(labels.dv_layer("s"), labels.dv_layer("s", short=True)).first()[:] == (
        long,
        short,
    )


@pytest.mark.parametrize(
    "name, dtype, expected",
    [
        ("email_id", "NUMBER", "EMAIL"),
        ("Home_Phone", "VARCHAR", "PHONE"),
        ("ssn", "VARCHAR", "SSN"),
        ("social_no", "VARCHAR", "SSN"),
        ("CUSTOMER_ID", "NUMBER", "IDENTIFIER"),
        ("ID_CARD", "VARCHAR", "IDENTIFIER"),
        ("PAID", "BOOLEAN", "IDENTIFIER"),  # the underscore is a wildcard
        ("ID", "VARCHAR", "GENERAL"),
        ("ID_", "VARCHAR", "IDENTIFIER"),
        ("created", "timestamp_ntz", "TEMPORAL"),
        ("born", "date", "TEMPORAL"),
        ("clock", "TIME", "GENERAL"),
        ("total", "bigint", "NUMERIC"),
        ("total", "decimal(10,2)", "NUMERIC"),
        ("note", "string", "GENERAL"),
    ],
)
def test_semantic_type(spark, name, dtype, expected):
    df = spark.createDataFrame([(name, dtype)], "n string, t string")
    assert df.select(labels.semantic_type("n", labels.warehouse_type("t"))).first()[0] == expected


def test_quality_critical(spark):
    df = spark.createDataFrame(
        [("balance", ["x"]), ("X", ["x"]), (None, ["x"])], "n string, own array<string>"
    )
    got = df.select(
        labels.quality_critical("n"),
        labels.quality_critical("n", F.col("own")),
        labels.quality_critical("n", ["X"]),
    ).collect()
    assert [tuple(r) for r in got] == [
        (True, False, False), (False, True, True), (False, False, False)
    ]


def test_labels_default(spark):
    df = spark.createDataFrame([("pii", ""), ("", "RETAIL"), (None, None)], "c string, d string")
    got = df.select(labels.normalize_classification("c"), labels.default_domain("d")).collect()
    assert [tuple(r) for r in got] == [
        ("PII", "ANALYTICS"), ("INTERNAL", "RETAIL"), ("INTERNAL", "ANALYTICS")
    ]


def test_minutes_count_boundaries(spark):
    d = dt.datetime
    df = spark.createDataFrame(
        [
            (d(2024, 1, 1, 0, 0, 59), d(2024, 1, 1, 0, 1, 0)),
            (d(2024, 1, 1, 0, 0, 0), d(2024, 1, 1, 0, 0, 59)),
            (d(2024, 1, 1, 0, 1, 0), d(2024, 1, 1, 0, 0, 59)),
            (d(2024, 1, 1), None),
        ],
        "a timestamp_ntz, b timestamp_ntz",
    )
    got = [r[0] for r in df.select(clock.minutes_crossed("a", "b")).collect()]
    assert got == [1, 0, -1, None]


def test_windows_start_at_midnight(spark):
    d = dt.datetime
    df = spark.createDataFrame(
        [(d(2024, 1, 3, 23, 59),), (d(2024, 1, 4),), (d(2024, 1, 5),)], "t timestamp_ntz"
    )
    assert df.where(clock.since("t", "2024-01-05T13:00:00", 1)).count() == 2
    assert df.where(clock.on_day("t", "2024-01-04T05:00:00")).count() == 1


ROLES = [
    *policies.FULL_ACCESS_ROLES, *policies.DOMAIN_PREFIXES, "PRIVACY_OFFICER", "PCI_ANALYST",
    "RISK_MANAGER",
]
DOMAINS = ["Retail Banking", "deposits EU", "LENDING", "Cards & Payments", "treasury", "HR", None]
CLASSES = ["Public", "Internal", "Confidential", "PII", "PCI", "INTERNAL", "public", None]


def may_read(role, domain, cls):
    """The policy read top down, one question after the other."""
    if role in {"GOVERNANCE_ADMIN", "AUDIT_ROLE", "DATA_STEWARD", "GOVERNANCE_ANALYST"}:
        return True
    name = (domain or "").lower()
    wanted = {
        "RETAIL_DATA_ANALYST": ("retail", "deposit"),
        "LENDING_DATA_ANALYST": ("lending",),
        "CARDS_DATA_ANALYST": ("cards",),
        "TREASURY_DATA_ANALYST": ("treasury",),
    }.get(role, ())
    if any(name.startswith(w) for w in wanted) or cls in ("Public", "Internal"):
        return True
    return (cls, role) in {("PII", "PRIVACY_OFFICER"), ("PCI", "PCI_ANALYST")}


@pytest.mark.parametrize("role", ROLES)
def test_row_access(spark, role):
    df = spark.createDataFrame(list(itertools.product(DOMAINS, CLASSES)), "d string, c string")
    flagged = df.select("d", "c", policies.row_access_flag(role, "d", "c").alias("ok")).collect()
    assert all(r.ok == may_read(role, r.d, r.c) for r in flagged)
    kept = df.where(policies.row_access(role, "d", "c")).count()
    assert kept == sum(r.ok for r in flagged)


def test_row_access_without_columns_is_for_full_access_only(spark):
    df = spark.range(3)
    assert df.where(policies.row_access("RISK_MANAGER", None, None)).count() == 0
    assert df.where(policies.row_access("AUDIT_ROLE", None, None)).count() == 3


def test_row_access_case_option(spark):
    df = spark.createDataFrame([("INTERNAL",), ("Internal",)], "c string")
    assert df.where(policies.row_access("RISK_MANAGER", None, "c")).count() == 1
    assert df.where(policies.row_access("RISK_MANAGER", None, "c", case_sensitive=False)).count() == 2


VALUES = ["a@b.c@d", "no-at", "x@y", "", "0123456789", "0123456789A", "é@ü.fr-long", None]


@pytest.mark.parametrize("role", ["GOVERNANCE_ADMIN", "DATA_STEWARD", "AUDIT_ROLE", "ANALYST"])
def test_masks_and_their_sql_functions(spark, role):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    df.createOrReplaceTempView("mask_input")
    got = df.select(
        "v", policies.mask_sensitive("v", role), policies.mask_email("v", role),
        policies.mask_evidence("v", role),
    ).collect()

    def sensitive(v):
        return v[:3] + "*****" + v[-2:] if len(v) > 10 else "***MASKED***"

    def email(v):
        return "***" + (v.split("@")[1] if "@" in v else "")

    for v, s, e, ev in got:
        hidden = v is not None
        plain = role in ("GOVERNANCE_ADMIN", "DATA_STEWARD", "AUDIT_ROLE")
        assert s == (sensitive(v) if hidden and not plain else v)
        assert e == (email(v) if hidden and role in ("AUDIT_ROLE", "ANALYST") else v)
        assert ev == ("evidence://masked" if hidden and role in ("DATA_STEWARD", "ANALYST") else v)
    policies.register_sql_masks(spark, role)
    sql = spark.sql(
        "SELECT v, mask_sensitive(v), mask_email(v), mask_evidence(v) FROM mask_input"
    ).collect()
    assert [tuple(r) for r in sql] == [tuple(r) for r in got]
