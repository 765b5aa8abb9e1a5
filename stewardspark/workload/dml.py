"""Snapshot DML on the projected tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import moment
from ..operators import upsert as u
from .registry import AS_OF, TELEMETRY_AS_OF, query

NUMBER = "CAST(substr({c}, {n}) AS BIGINT)"

# Every second run is known to the target; the others are new.
RUN_CHANGES = """SELECT CASE WHEN CAST(substr(run_id, 6) AS BIGINT) % 2 = 0 THEN run_id
    ELSE 'PRUN-N' || substr(run_id, 6) END AS run_id, process_id, {now} AS ended_at,
  'PARTIAL' AS status, system_id FROM process_run"""


def run_changes(t):
    known = F.expr("CAST(substr(run_id, 6) AS BIGINT) % 2 = 0")
    renamed = F.concat(F.lit("PRUN-N"), F.expr("substr(run_id, 6)"))
    return t.process_run.select(
        F.when(known, F.col("run_id")).otherwise(renamed).alias("run_id"),
        "process_id",
        moment(AS_OF).alias("ended_at"),
        F.lit("PARTIAL").alias("status"),
        "system_id",
    )


_NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"


MERGED = f"""WITH src AS ({RUN_CHANGES.format(now=_NOW)})
SELECT t.run_id, t.process_id, t.system_id, t.started_at,
  CASE WHEN s.run_id IS NOT NULL THEN s.ended_at ELSE t.ended_at END AS ended_at,
  CASE WHEN s.run_id IS NOT NULL THEN s.status ELSE t.status END AS status, t.error_message
FROM process_run t LEFT JOIN src s ON s.run_id = t.run_id
UNION ALL
SELECT run_id, process_id, NULL, NULL, ended_at, status, NULL FROM src s
WHERE NOT EXISTS (SELECT 1 FROM process_run t WHERE t.run_id = s.run_id)"""


def _merged(t, **how):
    return u.upsert(
        t.process_run,
        run_changes(t),
        ["run_id"],
        update_cols=["ended_at", "status"],
        insert_cols=["run_id", "process_id", "ended_at", "status"],
        **how,
    )


@query("upsert_update_insert", "process_run", MERGED)
def _(t):
    return _merged(t)


@query("upsert_large_source", "process_run", MERGED)
def _(t):
    return _merged(t, large_source=True)


@query(
    "upsert_insert_only",
    "process_run",
    f"""WITH src AS ({RUN_CHANGES.format(now=_NOW)})
SELECT run_id, process_id, system_id, started_at, ended_at, status, error_message FROM process_run
UNION ALL
SELECT run_id, process_id, system_id, NULL, ended_at, status, NULL FROM src s
WHERE NOT EXISTS (SELECT 1 FROM process_run t WHERE t.run_id = s.run_id)""",
)
def _(t):
    return u.upsert(t.process_run, run_changes(t), ["run_id"], update_cols=[])


@query(
    "upsert_casefold",
    "access_log",
    """WITH tgt AS (SELECT DISTINCT role_name, page_name, 'READ' AS access_level FROM access_log),
src AS (SELECT DISTINCT upper(role_name) AS role_name,
  CASE WHEN page_name = 'quality' THEN 'GLOSSARY' ELSE lower(page_name) END AS page_name,
  'WRITE' AS access_level FROM access_log)
SELECT t.role_name, t.page_name, coalesce(s.access_level, t.access_level) AS access_level
FROM tgt t LEFT JOIN src s ON upper(s.role_name) = upper(t.role_name) AND upper(s.page_name) = upper(t.page_name)
UNION ALL
SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM tgt t
  WHERE upper(s.role_name) = upper(t.role_name) AND upper(s.page_name) = upper(t.page_name))""",
)
def _(t):
    target = t.access_log.select("role_name", "page_name").distinct()
    page = F.when(F.col("page_name") == "quality", "GLOSSARY").otherwise(F.lower("page_name"))
    source = t.access_log.select(
        F.upper("role_name").alias("role_name"), page.alias("page_name")
    ).distinct()
    return u.upsert(
        target.withColumn("access_level", F.lit("READ")),
        source.withColumn("access_level", F.lit("WRITE")),
        ["role_name", "page_name"],
        update_cols=["access_level"],
        key_expr=F.upper,
    )


@query(
    "insert_once_per_day",
    "dq_result",
    """WITH src AS (SELECT run_id, rule_id, dataset_id, outcome, metrics_summary, rate,
  'again/' || evidence_ref AS evidence_ref, created_at + INTERVAL '1' DAY AS created_at FROM dq_result)
SELECT * FROM dq_result UNION ALL BY NAME
SELECT * FROM src s WHERE NOT EXISTS (SELECT 1 FROM dq_result t WHERE t.dataset_id = s.dataset_id
  AND t.rule_id = s.rule_id AND CAST(t.created_at AS DATE) = CAST(s.created_at AS DATE))""",
)
def _(t):
    batch = t.dq_result.withColumn(
        "evidence_ref", F.concat(F.lit("again/"), "evidence_ref")
    ).withColumn("created_at", F.expr("created_at + INTERVAL '1' DAY"))
    return u.insert_if_absent(t.dq_result, batch, ["dataset_id", "rule_id"], "created_at")


@query(
    "update_where",
    "process_run",
    """SELECT run_id, process_id, started_at, error_message, system_id,
  CASE WHEN ended_at IS NULL THEN TIMESTAMP '2024-02-05 00:00:00' ELSE ended_at END AS ended_at,
  CASE WHEN ended_at IS NULL THEN 'FAILED' ELSE status END AS status FROM process_run""",
)
def _(t):
    return u.update_where(
        t.process_run,
        F.col("ended_at").isNull(),
        {"ended_at": moment(AS_OF), "status": F.lit("FAILED")},
    )


@query(
    "update_where_key_list",
    "dim_dataset",
    """SELECT dataset_id, CASE WHEN dataset_id IN ('DS-1', 'DS-6', 'DS-9') THEN 'RET-1'
  ELSE retention_policy_id END AS retention_policy_id FROM dim_dataset""",
)
def _(t):
    return u.update_where(
        t.dim_dataset.select("dataset_id", "retention_policy_id"),
        F.col("dataset_id").isin("DS-1", "DS-6", "DS-9"),
        {"retention_policy_id": F.lit("RET-1")},
    )


@query(
    "purge_older_than",
    "access_log",
    "SELECT * FROM access_log WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' OR ts IS NULL",
)
def _(t):
    return u.purge_older_than(t.access_log, "ts", 90, TELEMETRY_AS_OF)


@query(
    "maintenance_touch",
    "dim_dataset",
    """SELECT dataset_id, certification, CASE WHEN updated_at < TIMESTAMP '2024-01-19 12:00:00'
  THEN TIMESTAMP '2024-01-20 12:00:00' ELSE updated_at END AS updated_at FROM dim_dataset""",
)
def _(t):
    touched, _log = u.maintenance(
        t.dim_dataset.select("dataset_id", "certification", "updated_at"),
        t.access_log,
        "2024-01-20T12:00:00",
    )
    return touched


@query(
    "maintenance_telemetry",
    "access_log",
    """WITH tel AS (SELECT ts, role_name, page_name, 'app' AS session_id, 'user' AS user_name,
  'VIEW' AS action FROM access_log)
SELECT * FROM tel WHERE ts >= TIMESTAMP '2024-01-16 00:00:00' UNION ALL BY NAME
SELECT TIMESTAMP '2024-04-15 00:00:00' AS ts, 'GOVERNANCE_ADMIN' AS role_name, 'MAINTENANCE' AS page_name,
  sha256('maintenance 2024-04-15T00:00:00') AS session_id, 'SYSTEM' AS user_name,
  'DAILY_CLEANUP' AS action""",
)
def _(t):
    telemetry = t.access_log.select(
        "ts",
        "role_name",
        "page_name",
        F.lit("app").alias("session_id"),
        F.lit("user").alias("user_name"),
        F.lit("VIEW").alias("action"),
    )
    return u.maintenance(t.dim_dataset, telemetry, TELEMETRY_AS_OF)[1]


@query(
    "merge_source_duplicates",
    "map_dataset_owner",
    "SELECT dataset_id, count(*) AS n FROM map_dataset_owner GROUP BY dataset_id HAVING count(*) > 1",
)
def _(t):
    return u.check_merge_source(t.map_dataset_owner, ["dataset_id"])
