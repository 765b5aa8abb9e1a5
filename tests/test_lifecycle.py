import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from stewardspark.operators import lifecycle as k
from stewardspark.operators.common import last_known, running_max
from stewardspark.streaming.results import failure_sessions, stream_failure_sessions

START = dt.datetime(2024, 1, 1)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def hot_key(rng) -> str | None:
    """One key holds most rows; a few rows have none."""
    return rng.choices(["hot", "a", "b", "c", None], [12, 2, 2, 1, 1])[0]


@pytest.mark.parametrize(
    "bucket, split", [("hour", None), ("day", None), ("year", None), ("year", 10), ("day", 2)]
)
@pytest.mark.parametrize("seed_value", [1, 2])
def test_last_known_against_brute_force(spark, bucket, split, seed_value):
    rng = random.Random(seed_value)
    facts = [(i, hot_key(rng), at(rng.randrange(400)) if i % 17 else None) for i in range(150)]
    history = [
        (hot_key(rng), at(rng.randrange(400)) if i % 13 else None, f"p{i:03}") for i in range(60)
    ]
    got = last_known(
        spark.createDataFrame(facts, "id int, k string, ts timestamp_ntz"),
        spark.createDataFrame(history, "k string, since timestamp_ntz, who string"),
        ["k"], "ts", "since", ["who", "since"], bucket, split, "hour",
    )
    found = {r.id: r.who for r in got.collect()}
    expect = {}
    for i, key, ts in facts:
        known = [
            (s, w) for hk, s, w in history
            if None not in (key, ts, s) and hk == key and s <= ts
        ]
        expect[i] = max(known)[1] if known else None
    assert found == expect


def test_a_hot_key_is_cut_into_many_buckets(spark):
    """One key with most facts of a month: no window group holds more than a finer bucket."""
    from stewardspark.operators.common import _bucketed

    rows = [("hot", at(i / 50)) for i in range(5000)] + [("a", at(5)), ("b", at(7))]
    df = spark.createDataFrame(rows, "_k0 string, ts timestamp_ntz")
    cut = _bucketed(df, ["_k0"], "ts", "month", 1000, "hour").groupBy("_k0", "_bucket").count()
    assert cut.where("_k0 = 'hot'").count() == 100 and cut.agg(F.max("count")).first()[0] == 50
    assert cut.where("_k0 <> 'hot'").count() == 2


@pytest.mark.parametrize("bucket, split", [("hour", None), ("month", None), ("month", 5)])
@pytest.mark.parametrize("include_current", [True, False])
def test_running_max_against_brute_force(spark, bucket, split, include_current):
    rng = random.Random(7)
    data = [(i, hot_key(rng), at(rng.randrange(900)), rng.randrange(1000)) for i in range(200)]
    df = spark.createDataFrame(data, "id int, k string, ts timestamp_ntz, v int")
    got = running_max(df, ["k"], ["ts", "id"], "ts", F.col("v"), "top", bucket, include_current, split, "day")
    found = {r.id: r.top for r in got.collect()}
    for i, key, ts, v in data:
        seen = [w for j, kk, t, w in data if kk == key and (t, j) < (ts, i)]
        seen += [v] if include_current else []
        assert found[i] == (max(seen) if seen else None)


def test_sessions_split_by_time_equal_session_window(spark, rows):
    rng = random.Random(3)
    data = [
        ("hot" if rng.random() < 0.7 else f"r{rng.randrange(4)}", "FAIL" if rng.random() < 0.8 else "PASS",
         at(rng.random() * 300))
        for _ in range(300)
    ]
    df = spark.createDataFrame(data, "rule_id string, outcome string, created_at timestamp_ntz")
    columns = ("rule_id", "session_start", "session_end", "failures")
    expect = rows(stream_failure_sessions(df, "2 hours"), *columns)
    for bucket in ("hour", "day", "year"):
        assert rows(failure_sessions(df, "2 hours", bucket), *columns) == expect


def test_owner_as_of(spark):
    owners = spark.createDataFrame(
        [("D", "A", "OWNER", at(0), at(10)), ("D", "B", "OWNER", at(10), at(20)),
         ("D", "C", "OWNER", at(30), None), ("D", "E", "STEWARD", at(30), None)],
        "dataset_id string, party_id string, role_type string, effective_from timestamp_ntz, "
        "effective_to timestamp_ntz",
    )
    facts = spark.createDataFrame(
        [(0, "D", at(-1)), (1, "D", at(0)), (2, "D", at(10)), (3, "D", at(20)), (4, "D", at(31)),
         (5, "X", at(5))],
        "id int, dataset_id string, created_at timestamp_ntz",
    )
    got = {r.id: r.owner_party_id for r in k.result_owner_as_of(facts, owners).collect()}
    assert got == {0: None, 1: "A", 2: "B", 3: None, 4: "E", 5: None}
    assert {r.party_id for r in k.owners_as_of(owners, at(10)).collect()} == {"B"}


def test_versions_and_overlaps(spark, rows):
    df = spark.createDataFrame(
        [("c1", "D", "1", at(0), at(100)), ("c2", "D", "2", at(10), at(20)),
         ("c3", "D", "3", at(50), at(60)), ("c4", "D", "4", at(100), None), ("c5", "E", "1", at(0), None)],
        "contract_id string, dataset_id string, version string, effective_from timestamp_ntz, "
        "effective_to timestamp_ntz",
    )
    assert rows(k.version_in_force(df, at(15)), "contract_id") == [("c2",), ("c5",)]
    assert rows(k.version_in_force(df, at(30)), "contract_id") == [("c1",), ("c5",)]
    overlaps = k.interval_overlaps(df, "dataset_id", "contract_id", bucket="hour")
    assert rows(overlaps, "contract_id", "covered_until") == [("c2", at(100)), ("c3", at(100))]


def test_retention_exceptions_and_changes(spark, rows):
    ds = spark.createDataFrame(
        [("a", "p", at(0)), ("b", "h", at(0)), ("c", None, at(0)), ("d", "p", at(24 * 95))],
        "dataset_id string, retention_policy_id string, created_at timestamp_ntz",
    )
    policies = spark.createDataFrame(
        [("p", 90, "PURGE", False), ("h", 90, "PURGE", True)],
        "policy_id string, duration_days int, disposition string, legal_hold_flag boolean",
    )
    due = k.retention_due(ds, policies, at(24 * 100))
    assert rows(due, "dataset_id", "action") == [("a", "PURGE"), ("b", "KEEP"), ("d", "KEEP")]
    exceptions = spark.createDataFrame(
        [("1", "APPROVED", at(0), at(10)), ("2", "APPROVED", at(0), None),
         ("3", "APPROVED", at(50), None), ("4", "REVOKED", at(0), None)],
        "id string, status string, effective_from timestamp_ntz, effective_to timestamp_ntz",
    )
    assert rows(k.exception_status(exceptions, at(10)), "id", "effective_status") == [
        ("1", "EXPIRED"), ("2", "ACTIVE"), ("3", "PENDING"), ("4", "REVOKED")
    ]
    cr = spark.createDataFrame([("x", "SUBMITTED"), ("y", "SUBMITTED"), ("z", "DRAFT")], "cr_id string, status string")
    votes = spark.createDataFrame(
        [("1", "x", "p", "REJECT", at(0)), ("2", "x", "p", "APPROVE", at(1)),
         ("3", "y", "p", "APPROVE", at(0)), ("4", "y", "q", "REQUEST_CHANGES", at(0))],
        "approval_id string, cr_id string, approver_party_id string, decision string, decided_at timestamp_ntz",
    )
    assert rows(k.change_state(cr, votes), "cr_id", "decided_state", "approvers") == [
        ("x", "APPROVED", 1), ("y", "CHANGES_REQUESTED", 2), ("z", "PENDING", 0)
    ]


def test_interval_union(spark):
    """Random intervals against the set of days they hold; split or not, the spans are the same."""
    draw = random.Random(3)
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    rows = [(f"k{draw.randrange(4)}", (a := draw.randrange(120)), a + draw.randrange(-1, 9)) for _ in range(90)]
    frame = spark.createDataFrame(
        [(k, day(a), day(b)) for k, a, b in rows] + [("k0", None, day(5)), ("k0", day(5), None)], "k string, a date, b date"
    )
    want = set()
    for key in {k for k, _, _ in rows}:
        days = sorted({d for k, a, b in rows if k == key for d in range(a, b)})
        starts = [d for d in days if d - 1 not in days]
        ends = [d + 1 for d in days if d + 1 not in days]
        want |= {(key, day(a), day(b), day(p) if p is not None else None) for a, b, p in zip(starts, ends, [None, *ends])}
    for split in (None, 3):
        found = k.interval_union(frame, "k", "a", "b", split_rows=split)
        assert {tuple(r[c] for c in ("k", "span_from", "span_to", "previous_to")) for r in found.collect()} == want


def test_attested_days(spark):
    day = dt.date
    frame = spark.createDataFrame(
        [
            ("whole", day(2023, 1, 1), day(2025, 1, 1), "APPROVED"), ("none", day(2024, 1, 1), day(2024, 1, 31), "REJECTED"),
            ("two", day(2024, 1, 1), day(2024, 1, 10), "APPROVED"), ("two", day(2024, 1, 11), day(2024, 1, 12), "APPROVED"),
            ("two", day(2024, 1, 20), day(2024, 1, 22), "APPROVED"), ("outside", day(2024, 3, 1), day(2024, 3, 2), "APPROVED"),
        ],
        "scope_id string, period_start date, period_end date, status string",
    )
    found = {r["scope_id"]: tuple(r)[1:] for r in k.attested_days(frame, "2024-01-01", "2024-01-31").collect()}
    assert found == {"whole": (31, 0, 0, 0), "none": (0, 31, 1, 31), "two": (15, 16, 2, 9), "outside": (0, 31, 1, 31)}
