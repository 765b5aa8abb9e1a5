from seed import AS_OF, ago

from stewardspark.functions.policies import mask_email
from stewardspark.operators import metrics as m
from stewardspark.operators import views as v


def test_today_health_keeps_newest_per_rule(seed, rows):
    got = v.today_health(seed["dim_dataset"], seed["dq_result"], seed["dq_run"])
    found = rows(got.where("dataset_id = 'DS-001'"), "last_dq_run_at", "last_dq_outcome")
    assert found == [(ago(days=1), "WARN"), (ago(hours=2), "PASS"), (ago(hours=2), "PASS")]
    assert rows(got.where("dataset_id = 'DS-003'"), "last_dq_outcome") == [(None,)]
    assert got.count() == 10


def test_results_of_unregistered_runs_vanish(seed, rows):
    got = v.dq_results_enriched(
        *[seed[n] for n in ("dq_result", "dq_run", "dim_dataset", "dq_rule", "dim_party")]
    )
    assert got.count() == 5
    assert rows(got.where("rule_id = 'DQR-005'"), "owner_name", "rule_name") == [(None, "rule 5")]


def test_owner_lists(seed, rows):
    got = v.dataset_owners(seed["dim_dataset"], seed["map_dataset_owner"], seed["dim_party"])
    lists = dict(rows(got, "dataset_id", "owner_emails"))
    assert lists["DS-001"] == "Ann <ann@company.com>; Cho <cho@company.com>"
    assert lists["DS-002"] == lists["DS-004"] == lists["DS-006"] == lists["DS-007"] == ""
    assert lists["DS-003"] == "Board <board@company.com>"
    assert len(lists) == 8


def test_masked_owner_lists_hide_every_local_part(seed):
    got = v.dataset_owners(
        seed["dim_dataset"], seed["map_dataset_owner"], seed["dim_party"],
        lambda c: mask_email(c, "ANALYST"),
    )
    text = " ".join(r.owner_emails for r in got.collect())
    assert "***company.com" in text
    assert not any(f"{name}@" in text for name in ("ann", "cho", "board"))


def test_a_role_sees_a_subset_of_admin(seed, rows):
    view = v.with_domain_label(
        v.dq_results_enriched(
            *[seed[n] for n in ("dq_result", "dq_run", "dim_dataset", "dq_rule", "dim_party")]
        ),
        seed["dim_domain"],
    )
    ids = {}
    for role in ("GOVERNANCE_ADMIN", "RETAIL_DATA_ANALYST", "PRIVACY_OFFICER", "RISK_MANAGER"):
        kept = v.govern(view, role, "domain_label", "classification", v.DQ_RESULT_MASKS)
        ids[role] = set(rows(kept, "run_id", "rule_id"))
    assert len(ids["GOVERNANCE_ADMIN"]) == 5
    assert all(found <= ids["GOVERNANCE_ADMIN"] for found in ids.values())
    assert len(ids["RETAIL_DATA_ANALYST"]) == 4 and not ids["RISK_MANAGER"]


def test_latest_rates(seed, rows):
    got = m.latest_dq(seed["dq_result"], seed["dq_run"])
    assert rows(got, "rule_id", "validity_rate", "completeness_rate") == [
        ("DQR-001", None, 99.8), ("DQR-002", 98.5, None), ("DQR-003", 92.3, None),
        ("DQR-005", None, None),
    ]
    whole = m.latest_dq(seed["dq_result"], seed["dq_run"], scale=0, ordered=True)
    assert [r.validity_rate for r in whole.collect()][1:3] == [99.0, 92.0]


def test_risk_order(seed):
    lexical = [r.risk_id for r in m.risk_register(seed["risk_item"]).collect()]
    ranked = [r.risk_id for r in m.risk_register(seed["risk_item"], ranked=True).collect()]
    assert lexical == ["RSK-3", "RSK-2", "RSK-1"]
    assert ranked == ["RSK-1", "RSK-2", "RSK-3"]


def test_daily_quality_totals_and_null_domain(seed, spark):
    got = m.daily_quality_metrics(
        seed["dq_result"], seed["dim_dataset"], seed["dim_domain"], AS_OF
    ).collect()
    assert sum(r.total_dq_tests for r in got) == 6
    assert all(
        r.total_dq_tests == r.passed_tests + r.failed_tests + r.warning_tests for r in got
    )


def test_governance_score_and_unjoined_null_domains(spark):
    d = "2024-01-02 00:00:00"
    one = lambda ddl, *data: spark.createDataFrame(list(data), ddl)
    ts = __import__("datetime").datetime.fromisoformat(d)
    run = one("started_at timestamp_ntz, ended_at timestamp_ntz, status string",
              (ts, ts, "SUCCESS"), (ts, None, "FAILED"))
    res = one("created_at timestamp_ntz, dataset_id string, outcome string",
              (ts, "A", "PASS"), (ts, "gone", "FAIL"))
    test = one("executed_at timestamp_ntz, control_id string, outcome string",
               (ts, "C", "PASS"), (ts, "gone", "WARN"))
    control = one("control_id string, scope_type string, scope_id string", ("C", "DATASET", "A"))
    ds = one("dataset_id string, domain_id string", ("A", "D"))
    domain = one("domain_id string, domain_name string", ("D", "Retail"))
    got = m.governance_metrics(run, res, test, control, ds, domain, "2024-01-05").collect()
    by = sorted(
        (str(r.domain_name), r.total_process_runs, r.total_dq_tests, r.total_control_tests,
         round(r.overall_health_score_pct, 6)) for r in got
    )
    assert by == [
        ("None", 0, 0, 1, 0.0), ("None", 0, 1, 0, 0.0), ("Retail", 0, 1, 1, 100.0),
        ("__ALL__", 2, 0, 0, 50.0),
    ]


def test_a_dataset_that_is_registered_twice_counts_twice(spark):
    ts = __import__("datetime").datetime(2024, 1, 2)
    res = spark.createDataFrame([(ts, "A", "PASS")] * 3, "created_at timestamp_ntz, dataset_id string, outcome string")
    ds = spark.createDataFrame([("A", "D"), ("A", "D")], "dataset_id string, domain_id string")
    domain = spark.createDataFrame([("D", "Retail")], "domain_id string, domain_name string")
    (row,) = m.daily_quality_metrics(res, ds, domain, "2024-01-05").collect()
    assert row.total_dq_tests == 6


def test_an_empty_domain_name_is_shown_as_null(spark):
    ts = __import__("datetime").datetime(2024, 1, 2)
    res = spark.createDataFrame([(ts, "A", "PASS")], "created_at timestamp_ntz, dataset_id string, outcome string")
    run = spark.createDataFrame([], "started_at timestamp_ntz, ended_at timestamp_ntz, status string")
    test = spark.createDataFrame([(ts, "C", "PASS")], "executed_at timestamp_ntz, control_id string, outcome string")
    control = spark.createDataFrame([("C", "DATASET", "A")], "control_id string, scope_type string, scope_id string")
    ds = spark.createDataFrame([("A", "D")], "dataset_id string, domain_id string")
    domain = spark.createDataFrame([("D", "")], "domain_id string, domain_name string")
    (row,) = m.governance_metrics(run, res, test, control, ds, domain, "2024-01-05").collect()
    assert row.domain_name is None and (row.total_dq_tests, row.total_control_tests) == (1, 1)


def test_no_broadcast_is_forced(spark):
    """A registry side with many rows of one id is merged, not broadcast."""
    ts = __import__("datetime").datetime(2024, 1, 2)
    res = spark.createDataFrame([(ts, "A", "PASS")], "created_at timestamp_ntz, dataset_id string, outcome string")
    ds = spark.createDataFrame([("A", "D")], "dataset_id string, domain_id string")
    domain = spark.range(3_000_000).selectExpr("'D' AS domain_id", "CAST(id AS STRING) AS domain_name")
    plan = m.daily_quality_metrics(res, ds, domain, "2024-01-05")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan.lower()


def test_month_arithmetic(spark):
    def months(day, n):
        return spark.range(1).select(m.months_before(day, n)).first()[0].date().isoformat()

    assert months("2024-03-31", 1) == "2024-02-29"
    assert months("2024-01-15", 12) == "2023-01-15"
    assert months("2024-12-31", 6) == "2024-06-30"
    assert months("2025-01-31", 2) == "2024-11-30"
