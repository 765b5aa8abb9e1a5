"""Sinks: append, daily materialisation, versioned tables, reading back with the declared schemas."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import moment
from ..operators import day_bitmaps, day_states
from ..session import scratch_path
from ..sources import snapshots, versioned
from .dml import MERGED, run_changes
from .metrics import governance_metrics, rounded
from .registry import AS_OF, ORACLES, QUERIES, TELEMETRY_AS_OF, query


def _written_daily(t):
    path = scratch_path(t.spark, "governance-metrics")
    metrics = governance_metrics(t)
    snapshots.write_daily(metrics, path)
    return t.spark.read.schema(metrics.schema).parquet(path)


QUERIES["governance_metrics_written"] = _written_daily
ORACLES["governance_metrics_written"] = ORACLES["governance_metrics"]


@query(
    "results_appended",
    "dq_result",
    """SELECT run_id, rule_id, dataset_id, outcome, metrics_summary, evidence_ref, created_at, NULL::TIMESTAMP AS updated_at FROM dq_result
UNION ALL BY NAME SELECT run_id || '-again' AS run_id, rule_id, dataset_id, outcome, metrics_summary, evidence_ref,
  created_at, NULL::TIMESTAMP AS updated_at FROM dq_result""",
)
def _(t):
    root = scratch_path(t.spark, "registry")
    snapshots.append(t.dq_result, root, "dq_result")
    again = t.dq_result.withColumn("run_id", F.concat("run_id", F.lit("-again")))
    snapshots.append(again, root, "dq_result")
    return snapshots.read_table(t.spark, root, "dq_result")


def _versioned(t, rows, order):
    root = scratch_path(t.spark, "versioned")
    versioned.create(rows.repartitionByRange(order), root)
    return root


@query("merge_touched_files", "process_run", MERGED)
def _(t):
    root = _versioned(t, t.process_run, "run_id")
    versioned.merge(
        root, run_changes(t), ["run_id"], ["ended_at", "status"], ["run_id", "process_id", "ended_at", "status"]
    )
    return versioned.read(t.spark, root)


def _inserted(t):
    root = _versioned(t, t.process_run, "run_id")
    versioned.merge(root, run_changes(t), ["run_id"], update_cols=[])
    return versioned.read(t.spark, root)


QUERIES["insert_touched_files"] = _inserted
ORACLES["insert_touched_files"] = ORACLES["upsert_insert_only"]


def _updated(t):
    root = _versioned(t, t.process_run, "started_at")
    versioned.update(
        t.spark, root, F.col("ended_at").isNull(), {"ended_at": moment(AS_OF), "status": F.lit("FAILED")}
    )
    return versioned.read(t.spark, root)


QUERIES["update_touched_files"] = _updated
ORACLES["update_touched_files"] = ORACLES["update_where"]


def _purged(t):
    root = _versioned(t, t.access_log, "ts")
    versioned.purge(t.spark, root, "ts", 90, TELEMETRY_AS_OF)
    return versioned.read(t.spark, root)


QUERIES["purge_touched_files"] = _purged
ORACLES["purge_touched_files"] = ORACLES["purge_older_than"]


def _incremental(t):
    """The logs in three batches, newest parts first, one batch taken twice."""
    folder = scratch_path(t.spark, "day-states")

    def part(rows, key, n):
        return rows.where(F.pmod(F.xxhash64(key), F.lit(3)) == n)

    for n in (2, 0, 1, 0):
        day_states.refresh(
            folder, f"batch-{n}", part(t.process_run, "run_id", n), part(t.dq_result, "evidence_ref", n),
            part(t.control_test, "test_id", n), t.control_registry, t.dim_dataset, t.dim_domain, AS_OF,
        )
    return rounded(day_states.recent(t.spark, folder, AS_OF))


QUERIES["governance_metrics_incremental"] = _incremental
ORACLES["governance_metrics_incremental"] = ORACLES["governance_metrics"]


def _seen_datasets(t):
    """The datasets of the results, day by day, in two batches; one is taken twice."""
    folder = scratch_path(t.spark, "day-bitmaps")
    rows = t.dq_result.select(
        F.to_date("created_at").alias("metric_date"), F.col("dataset_id").alias("value"),
        F.pmod(F.xxhash64("evidence_ref"), F.lit(2)).alias("half"),
    )
    for n in (1, 0, 1):
        day_bitmaps.take(folder, f"batch-{n}", rows.where(F.col("half") == n))
    return folder


@query(
    "rolling_distinct_datasets",
    "dq_result",
    """WITH x AS (SELECT DISTINCT created_at::DATE AS d, dataset_id FROM dq_result WHERE dataset_id IS NOT NULL)
SELECT a.d AS metric_date, count(DISTINCT b.dataset_id) AS distinct_values
FROM (SELECT DISTINCT d FROM x) a JOIN x b ON b.d BETWEEN a.d - 6 AND a.d GROUP BY a.d""",
)
def _(t):
    return day_bitmaps.rolling_distinct(t.spark, _seen_datasets(t), 7)


@query(
    "monitored_datasets_by_domain",
    "dq_result dim_dataset",
    """SELECT domain_id, count(DISTINCT r.dataset_id) AS distinct_values FROM dq_result r JOIN dim_dataset d ON d.dataset_id = r.dataset_id
WHERE r.created_at::DATE BETWEEN DATE '2024-01-06' AND DATE '2024-02-05' GROUP BY domain_id""",
)
def _(t):
    members = t.dim_dataset.select("domain_id", F.col("dataset_id").alias("value"))
    return day_bitmaps.distinct_by_group(t.spark, _seen_datasets(t), members, "domain_id", "2024-01-06", AS_OF)
