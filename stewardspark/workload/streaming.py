"""Streaming operators, run over all input at hand, and their batch counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import started_runs
from ..session import scratch_path
from ..sources.projections import project
from ..streaming import results as s
from ..streaming.runs import stream_run_pairs
from .lineage import run_events
from .metrics import LATEST
from .registry import query
from .views import ENRICHED, ENRICHED_TABLES

GAP = "12 hours"


def _results(t):
    return project(t.stream("events"), "dq_result")


def _ended(t, **values):
    return s.StreamEnd(_results(t), s.EVENT_TIME, **values)


TUMBLING = """SELECT time_bucket(INTERVAL '1' HOUR, created_at) AS window_start,
  time_bucket(INTERVAL '1' HOUR, created_at) + INTERVAL '1' HOUR AS window_end, outcome, count(*) AS results
FROM dq_result GROUP BY 1, 2, 3"""
SLIDING = """SELECT w AS window_start, w + INTERVAL '6' HOUR AS window_end, outcome, count(*) AS results FROM (
  SELECT outcome, unnest([time_bucket(INTERVAL '2' HOUR, created_at), time_bucket(INTERVAL '2' HOUR, created_at) - INTERVAL '2' HOUR,
    time_bucket(INTERVAL '2' HOUR, created_at) - INTERVAL '4' HOUR]) AS w FROM dq_result) GROUP BY 1, 2, 3"""


@query("dq_outcomes_tumbling", "dq_result", TUMBLING)
def _(t):
    return s.outcome_windows(t.dq_result, "1 hour")


@query("dq_outcomes_sliding", "dq_result", SLIDING)
def _(t):
    return s.outcome_windows(t.dq_result, "6 hours", "2 hours")


@query("stream_outcomes_tumbling", "dq_result", TUMBLING)
def _(t):
    end = _ended(t)
    return s.drain(s.outcome_windows(end.stream, "1 hour"), "outcomes-tumbling", [end])


@query("stream_outcomes_sliding", "dq_result", SLIDING)
def _(t):
    end = _ended(t)
    return s.drain(s.outcome_windows(end.stream, "6 hours", "2 hours"), "outcomes-sliding", [end])


@query("dq_outcomes_panes", "dq_result", SLIDING)
def _(t):
    return s.outcome_panes(t.dq_result, "6 hours", "2 hours")


@query("stream_outcomes_panes", "dq_result", SLIDING)
def _(t):
    end = _ended(t)
    return s.drain(s.outcome_panes(end.stream, "6 hours", "2 hours"), "outcomes-panes", [end])


SESSIONS = """WITH f AS (SELECT rule_id, created_at AS ts, lag(created_at) OVER (PARTITION BY rule_id ORDER BY created_at) AS before
  FROM dq_result WHERE outcome = 'FAIL'),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL '12' HOUR THEN 1 ELSE 0 END)
  OVER (PARTITION BY rule_id ORDER BY ts) AS island FROM f),
x AS (SELECT rule_id, min(ts) AS session_start, max(ts) + INTERVAL '12' HOUR AS session_end, count(*) AS failures
  FROM g GROUP BY rule_id, island)
SELECT * FROM x"""


@query("dq_failure_sessions", "dq_result", SESSIONS)
def _(t):
    return s.failure_sessions(t.dq_result, GAP)


@query(
    "dq_failure_sessions_by_session_window",
    "dq_result",
    SESSIONS,
)
def _(t):
    return s.stream_failure_sessions(t.dq_result, GAP)


@query("stream_failure_sessions", "dq_result", SESSIONS)
def _(t):
    end = _ended(t, outcome="FAIL")
    return s.drain(s.stream_failure_sessions(end.stream, GAP), "failure-sessions", [end])


@query("stream_dq_results_enriched", ENRICHED_TABLES, ENRICHED)
def _(t):
    stream = s.stream_enrich(_results(t), t.dq_run, t.dim_dataset, t.dq_rule, t.dim_party)
    return s.drain(stream, "results-enriched")


@query(
    "stream_latest_dq_per_rule",
    "dq_result dq_run",
    f"""WITH l AS ({LATEST.format(keys="r.rule_id")})
SELECT run_id, rule_id, dataset_id, outcome, evidence_ref, started_at FROM l WHERE rn = 1""",
)
def _(t):
    results = _results(t).select("run_id", "rule_id", "dataset_id", "outcome", "evidence_ref")
    target = scratch_path(t.spark, "latest")
    # The run table is small per key but read by every micro-batch.
    done = s.stream_latest(results, t.dq_run, target, f"{target}-progress")
    done.awaitTermination()
    return s.latest_snapshot(t.spark, target)


@query(
    "stream_newest_dq_per_rule",
    "dq_result dq_run",
    f"""WITH l AS ({LATEST.format(keys="r.rule_id")})
SELECT run_id, rule_id, dataset_id, outcome, evidence_ref, started_at FROM l WHERE rn = 1""",
)
def _(t):
    results = _results(t).select("run_id", "rule_id", "dataset_id", "outcome", "evidence_ref")
    target = scratch_path(t.spark, "newest")
    s.stream_newest(results, t.dq_run, target, f"{target}-progress").awaitTermination()
    return s.newest_snapshot(t.spark, target)


@query(
    "stream_dedup_daily",
    "dq_result",
    "SELECT DISTINCT dataset_id, rule_id, CAST(created_at AS DATE) AS day FROM dq_result",
)
def _(t):
    kept = s.stream_dedup_daily(_results(t)).select(
        "dataset_id", "rule_id", F.to_date("day").alias("day")
    )
    return s.drain(kept, "dedup-daily")


@query(
    "stream_run_pairs",
    "process_run",
    """SELECT run_id, process_id, started_at, ended_at, CASE WHEN ended_at IS NULL THEN 'UNFINISHED' ELSE status END AS status,
  CASE WHEN ended_at IS NULL THEN NULL ELSE error_message END AS error_message FROM process_run""",
)
def _(t):
    return _run_pairs(t, "4 hours")


@query(
    "stream_run_pairs_timeout",
    "process_run",
    """WITH r AS (SELECT *, ended_at <= started_at + INTERVAL '90' MINUTE AS done FROM process_run)
SELECT run_id, process_id, started_at, CASE WHEN done THEN ended_at END AS ended_at,
  CASE WHEN done THEN status ELSE 'UNFINISHED' END AS status, CASE WHEN done THEN error_message END AS error_message FROM r""",
)
def _(t):
    return _run_pairs(t, "90 minutes")


def _run_pairs(t, timeout):
    runs = project(t.stream("orders"), "process_run")
    starts = runs.select("run_id", "process_id", "started_at")
    ends = project(t.stream("orders"), "process_run").where("ended_at IS NOT NULL").select(
        "run_id", "ended_at", "status", "error_message"
    )
    first = s.StreamEnd(starts, "started_at", run_id="end of starts")
    last = s.StreamEnd(ends, "ended_at", run_id="end of ends")
    pairs = stream_run_pairs(first.stream, last.stream, timeout)
    return s.drain(pairs, "run-pairs", [first, last])


@query(
    "run_pairs_batch",
    "process_run",
    """SELECT run_id, process_id, started_at, ended_at, CASE WHEN ended_at IS NULL THEN 'UNFINISHED' ELSE status END AS status
FROM process_run""",
)
def _(t):
    started = started_runs(run_events(t))
    status = F.when(F.col("status") == "STARTED", "UNFINISHED").otherwise(F.col("status"))
    return started.select(
        "run_id", "process_id", "started_at", "ended_at", status.alias("status")
    )
