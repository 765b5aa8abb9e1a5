import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from stewardspark.session import scratch_path
from stewardspark.streaming import results as s
from stewardspark.streaming.runs import stream_run_pairs

START = dt.datetime(2024, 1, 1)
DDL = (
    "run_id string, rule_id string, dataset_id string, outcome string, evidence_ref string, "
    "created_at timestamp_ntz"
)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def make_results(n=240):
    rng = random.Random(5)
    return [
        (f"R{rng.randrange(12)}", f"Q{rng.randrange(3)}", f"D{rng.randrange(4)}",
         rng.choice(["PASS", "FAIL", "WARN"]), f"e{i:03}", at(i / 5 + rng.random()))
        for i in range(n)
    ]


def feed(spark, data, ddl, files, one_at_a_time=True):
    """Writes ``data`` as several files, in order, and reads them as a stream."""
    folder = scratch_path(spark, "feed")
    size = -(-len(data) // files)
    for i in range(files):
        old = set(glob.glob(f"{folder}/*.parquet"))
        part = spark.createDataFrame(data[i * size : (i + 1) * size], ddl)
        part.coalesce(1).write.mode("append").parquet(folder)
        for path in set(glob.glob(f"{folder}/*.parquet")) - old:
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    reader = spark.readStream.schema(ddl)
    if one_at_a_time:
        reader = reader.option("maxFilesPerTrigger", 1)
    return reader.parquet(folder)


@pytest.fixture
def results(spark):
    data = make_results()
    return spark.createDataFrame(data, DDL), data


@pytest.mark.parametrize("slide", [None, "1 hour"])
def test_windows_equal_batch_for_closed_windows(spark, rows, results, slide):
    batch, data = results
    stream = feed(spark, data, DDL, 6)
    got = s.drain(s.outcome_windows(stream, "2 hours", slide, "3 hours"), "w")
    watermark = max(r[5] for r in data) - dt.timedelta(hours=3)
    closed = [
        r for r in rows(s.outcome_windows(batch, "2 hours", slide)) if r[1] <= watermark
    ]
    assert rows(got) == closed and closed


def test_sessions_equal_batch_for_closed_sessions(spark, rows, results):
    batch, data = results
    got = s.drain(s.stream_failure_sessions(feed(spark, data, DDL, 5), "1 hour", "3 hours"), "s")
    watermark = max(r[5] for r in data if r[3] == "FAIL") - dt.timedelta(hours=3)
    columns = ("rule_id", "session_start", "session_end", "failures")
    closed = [r for r in rows(s.failure_sessions(batch, "1 hour"), *columns) if r[2] <= watermark]
    assert rows(got, *columns) == closed and closed


@pytest.mark.parametrize("slide", [None, "1 hour"])
def test_an_ended_stream_has_all_windows(spark, rows, results, slide):
    batch, data = results
    end = s.StreamEnd(feed(spark, data, DDL, 6), "created_at")
    got = s.drain(s.outcome_windows(end.stream, "2 hours", slide, "3 hours"), "w", [end])
    assert rows(got) == rows(s.outcome_windows(batch, "2 hours", slide))


def test_an_ended_stream_has_all_sessions(spark, rows, results):
    batch, data = results
    end = s.StreamEnd(feed(spark, data, DDL, 5), "created_at", outcome="FAIL")
    got = s.drain(s.stream_failure_sessions(end.stream, "1 hour", "3 hours"), "s", [end])
    columns = ("rule_id", "session_start", "session_end", "failures")
    assert rows(got, *columns) == rows(s.failure_sessions(batch, "1 hour"), *columns)


def test_ended_streams_have_all_pairs(spark, rows):
    starts = [("a", "p", at(0)), ("b", "p", at(1)), ("open", "p", at(60))]
    ends = [("a", at(1), "SUCCESS", None)]
    a = s.StreamEnd(feed(spark, starts, "run_id string, process_id string, started_at timestamp_ntz", 1), "started_at", run_id="end of starts")
    b = s.StreamEnd(feed(spark, ends, "run_id string, ended_at timestamp_ntz, status string, error_message string", 1), "ended_at", run_id="end of ends")
    got = s.drain(stream_run_pairs(a.stream, b.stream, "4 hours"), "pairs", [a, b])
    assert rows(got, "run_id", "ended_at", "status") == [
        ("a", at(1), "SUCCESS"), ("b", None, "UNFINISHED"), ("open", None, "UNFINISHED")
    ]


def test_rows_later_than_the_delay_are_dropped(spark, rows):
    # Late rows are judged by the watermark of the batch before: the drop shows one file later.
    hours = [1, 50, 52, 1, 90]
    data = [("R", "Q", "D", "PASS", f"e{i}", at(h)) for i, h in enumerate(hours)]
    got = s.drain(s.outcome_windows(feed(spark, data, DDL, 5), "1 hour", None, "1 hour"), "late")
    assert rows(got, "window_start", "results") == [(at(1), 1), (at(50), 1), (at(52), 1)]


@pytest.mark.parametrize("shuffled", [False, True])
def test_latest_does_not_depend_on_arrival(spark, rows, results, shuffled):
    batch, data = results
    run = spark.createDataFrame(
        [(f"R{i}", at((i * 7) % 12)) for i in range(10)], "run_id string, started_at timestamp_ntz"
    )
    arriving = list(data)
    if shuffled:
        random.Random(1).shuffle(arriving)
    target = scratch_path(spark, "latest")
    query = s.stream_latest(feed(spark, arriving, DDL, 4), run, target, f"{target}-progress")
    query.awaitTermination()
    from stewardspark.operators.views import latest_results

    columns = ("rule_id", "run_id", "evidence_ref")
    assert rows(s.latest_snapshot(spark, target), *columns) == rows(
        latest_results(batch, run), *columns
    )


@pytest.mark.parametrize("stream_of, snapshot", [(s.stream_latest, s.latest_snapshot), (s.stream_newest, s.newest_snapshot)])
def test_latest_restarts_idle_and_takes_late_runs(spark, rows, stream_of, snapshot):
    folder, target = scratch_path(spark, "input"), scratch_path(spark, "latest")

    def arrive(*data):
        spark.createDataFrame(list(data), DDL).coalesce(1).write.mode("append").parquet(folder)

    def go(runs):
        run = spark.createDataFrame(runs, "run_id string, started_at timestamp_ntz")
        stream = spark.readStream.schema(DDL).parquet(folder)
        stream_of(stream, run, target, f"{target}-progress").awaitTermination()
        return rows(snapshot(spark, target), "rule_id", "run_id")

    arrive(("R1", "Q", "D", "PASS", "e1", at(1)), ("R2", "Q", "D", "FAIL", "e2", at(2)))
    assert go([("R1", at(1))]) == [("Q", "R1")]
    # Nothing new: the last snapshot still answers.
    assert go([("R1", at(1))]) == [("Q", "R1")]
    # The run of the waiting result has been registered meanwhile.
    arrive(("R1", "P", "D", "PASS", "e3", at(3)))
    assert go([("R1", at(1)), ("R2", at(2))]) == [("P", "R1"), ("Q", "R2")]
    for hour in (4, 5, 6):
        arrive(("R1", "P", "D", "PASS", f"e{hour}", at(hour)))
        go([("R1", at(1)), ("R2", at(2))])
    from stewardspark.session import folder_names

    assert len(folder_names(spark, target)) <= 3


def test_newest_rewrites_touched_buckets_only(spark, rows):
    """One key per micro-batch: the other buckets stay where they were; a repeated batch changes nothing."""
    folder, target = scratch_path(spark, "input"), scratch_path(spark, "newest")
    run = spark.createDataFrame([(f"R{i}", at(i)) for i in range(9)], "run_id string, started_at timestamp_ntz")

    def go(*data):
        spark.createDataFrame(list(data), DDL).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(DDL).parquet(folder)
        s.stream_newest(stream, run, target, f"{target}-progress", buckets=16).awaitTermination()
        return s._versions(spark, target, "index")[-1]

    first = go(*[(f"R{i % 3}", f"Q{i}", "D", "PASS", f"e{i}", at(1)) for i in range(40)])
    held = s._index(spark, target, first)
    second = go(("R8", "Q7", "D", "FAIL", "late", at(2)), ("R0", "Q8", "D", "FAIL", "old", at(2)))
    now = s._index(spark, target, second)
    assert set(now) == set(held) and 1 <= sum(v == second for v in now.values()) <= 2
    found = {r["rule_id"]: r["run_id"] for r in s.newest_snapshot(spark, target).collect()}
    assert found == {f"Q{i}": "R8" if i == 7 else f"R{i % 3}" for i in range(40)}


def test_daily_dedup_keys(spark, rows, results):
    _, data = results
    got = s.drain(s.stream_dedup_daily(feed(spark, data, DDL, 5), "2 days"), "d")
    keys = sorted({(r[2], r[1], r[5].date()) for r in data})
    assert [(r.dataset_id, r.rule_id, r.created_at.date()) for r in
            sorted(got.collect(), key=lambda r: (r.dataset_id, r.rule_id, r.created_at))] == keys


def test_run_pairs_with_timeout_and_repeated_starts(spark, rows):
    starts = [("a", "p", at(0)), ("a", "p", at(0.1)), ("b", "p", at(1)), ("late", "p", at(2)),
              ("tail", "p", at(60))]
    ends = [("a", at(1), "SUCCESS", None), ("late", at(9), "SUCCESS", None),
            ("gone", at(3), "SUCCESS", None), ("tail", at(61), "FAILED", "x")]
    a = feed(spark, starts, "run_id string, process_id string, started_at timestamp_ntz", 1)
    b = feed(spark, ends, "run_id string, ended_at timestamp_ntz, status string, error_message string", 1)
    got = s.drain(stream_run_pairs(a, b, "4 hours"), "pairs")
    assert rows(got, "run_id", "ended_at", "status") == [
        ("a", at(1), "SUCCESS"), ("b", None, "UNFINISHED"), ("late", None, "UNFINISHED"),
        ("tail", at(61), "FAILED"),
    ]


def test_enrichment_equals_batch(spark, rows, seed):
    from stewardspark.operators.views import dq_results_enriched

    dims = [seed[n] for n in ("dq_run", "dim_dataset", "dq_rule", "dim_party")]
    data = [tuple(r) for r in seed["dq_result"].collect()]
    stream = feed(spark, data, seed["dq_result"].schema.simpleString()[7:-1].replace(":", " "), 3)
    got = s.drain(s.stream_enrich(stream, *dims), "enriched")
    assert rows(got) == rows(dq_results_enriched(seed["dq_result"], *dims))


def test_panes_equal_sliding_windows(spark):
    rows = [(f"2024-01-01 {h:02d}:{m:02d}:00", o) for h in range(24) for m in (0, 29, 59) for o in ("PASS", "FAIL")]
    frame = spark.createDataFrame(rows, "created_at string, outcome string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    want = s.outcome_windows(frame, "6 hours", "2 hours")
    found = s.outcome_panes(frame, "6 hours", "2 hours")
    assert found.dtypes == want.dtypes and sorted(found.collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="panes"):
        s.outcome_panes(frame, "5 hours", "2 hours")
