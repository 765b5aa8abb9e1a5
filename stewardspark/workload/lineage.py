"""Lineage registration, impact, closure, audits and run tracking."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.clock import moment
from ..operators import lineage as g
from .registry import AS_OF, query

NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"


@query(
    "lineage_nodes",
    "dim_dataset lineage_node",
    """WITH s AS (SELECT dataset_id, catalog_name, description, updated_at FROM dim_dataset
  WHERE CAST(updated_at AS DATE) = DATE '2024-01-20')
SELECT n.node_id, n.node_type, coalesce(s.catalog_name, n.name) AS name,
  coalesce(s.description, n.description) AS description, coalesce(s.updated_at, n.updated_at) AS updated_at
FROM lineage_node n LEFT JOIN s ON s.dataset_id = n.node_id
UNION ALL SELECT dataset_id, 'DATASET', catalog_name, description, updated_at FROM s
WHERE NOT EXISTS (SELECT 1 FROM lineage_node n WHERE n.node_id = s.dataset_id)""",
)
def _(t):
    return g.lineage_nodes(t.dim_dataset, t.lineage_node, "2024-01-20")


@query(
    "lineage_edges",
    "lineage_edge",
    f"""WITH s AS (SELECT DISTINCT 'dbt_DB_S_' || src_node_id AS src, 'dbt_DB_S_' || tgt_node_id AS tgt,
  'dbt_model_' || tgt_node_id AS logic_ref FROM lineage_edge),
k AS (SELECT DISTINCT 'edge_dbt_DB_S_' || src_node_id || '_to_' || 'dbt_DB_S_' || tgt_node_id AS edge_id,
  'dbt_DB_S_' || src_node_id AS src_node_id, 'dbt_DB_S_' || tgt_node_id AS tgt_node_id, 'LOADS' AS edge_type,
  'old' AS logic_ref, FALSE AS active_flag FROM lineage_edge WHERE edge_type = 'CONSUMES'),
e AS (SELECT 'edge_' || src || '_to_' || tgt AS edge_id, * FROM s)
SELECT k.edge_id, k.src_node_id, k.tgt_node_id, k.edge_type, coalesce(e.logic_ref, k.logic_ref) AS logic_ref,
  e.edge_id IS NOT NULL AS active_flag FROM k LEFT JOIN e ON e.edge_id = k.edge_id
UNION ALL SELECT edge_id, src, tgt, 'TRANSFORMS', logic_ref, TRUE FROM e
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.edge_id = e.edge_id)""",
)
def _(t):
    edges = t.lineage_edge
    models = edges.select(
        F.lit("DB").alias("database_name"),
        F.lit("S").alias("schema_name"),
        F.col("tgt_node_id").alias("object_name"),
        F.array(F.concat(F.lit("model.proj."), "src_node_id"), F.lit("lonely")).alias(
            "depends_on"
        ),
    )
    src, tgt = (F.concat(F.lit("dbt_DB_S_"), c) for c in ("src_node_id", "tgt_node_id"))
    known = edges.where("edge_type = 'CONSUMES'").select(
        F.concat(F.lit("edge_"), src, F.lit("_to_"), tgt).alias("edge_id"),
        src.alias("src_node_id"),
        tgt.alias("tgt_node_id"),
        F.lit("LOADS").alias("edge_type"),
        F.lit("old").alias("logic_ref"),
        F.lit(False).alias("active_flag"),
    )
    return g.lineage_edges(models, known.distinct(), AS_OF)


@query(
    "impact_one_hop",
    "lineage_edge lineage_node",
    """WITH d AS (SELECT DISTINCT tgt, name, node_type, edge_type, n FROM (
  SELECT e.tgt_node_id AS tgt, v.name, v.node_type, e.edge_type, count(*) OVER (PARTITION BY e.tgt_node_id) AS n
  FROM lineage_edge e JOIN lineage_node v ON v.node_id = e.tgt_node_id
  WHERE e.src_node_id = 'DS-1' AND e.active_flag))
SELECT node_type, count(*) AS impacted_assets, avg(n) AS avg_dependencies,
  string_agg(name, ', ' ORDER BY name) AS asset_list FROM d GROUP BY node_type""",
)
def _(t):
    return g.impact_one_hop(t.lineage_node, t.lineage_edge, "DS-1")


WALK = """WITH RECURSIVE walk(node_id, depth) AS (
  SELECT {seed}, 0 UNION
  SELECT e.{to}, w.depth + 1 FROM walk w JOIN lineage_edge e ON e.{frm} = w.node_id
  WHERE e.active_flag AND e.src_node_id <> e.tgt_node_id)
SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE node_id <> {seed} GROUP BY node_id"""


@query(
    "lineage_downstream",
    "lineage_edge",
    WALK.format(seed="'DS-1'", to="tgt_node_id", frm="src_node_id"),
)
def _(t):
    return g.reachable(t.lineage_edge, _seed(t, "DS-1"), "downstream")


@query(
    "lineage_upstream",
    "lineage_edge",
    WALK.format(seed="'DS-199'", to="src_node_id", frm="tgt_node_id"),
)
def _(t):
    return g.reachable(t.lineage_edge, _seed(t, "DS-199"), "upstream")


def _seed(t, node: str):
    return t.spark.range(1).select(F.lit(node).alias("node_id"))


@query(
    "lineage_node_counts",
    "lineage_node",
    """SELECT count(*) AS total_nodes, count(*) FILTER (node_type = 'DATASET') AS dataset_nodes
FROM lineage_node WHERE updated_at >= TIMESTAMP '2024-02-04 00:00:00'""",
)
def _(t):
    return g.lineage_node_counts(t.lineage_node, AS_OF)


@query(
    "lineage_coverage",
    "lineage_edge map_dataset_owner",
    """WITH ds AS (SELECT DISTINCT dataset_id FROM map_dataset_owner),
x AS (SELECT ds.dataset_id, EXISTS (SELECT 1 FROM lineage_edge e WHERE e.src_node_id = ds.dataset_id)
  OR EXISTS (SELECT 1 FROM lineage_edge e WHERE e.tgt_node_id = ds.dataset_id) AS linked FROM ds)
SELECT count(*) AS total_datasets, count(*) FILTER (linked) AS linked_datasets,
  round(CAST(100 AS DOUBLE) * count(*) FILTER (linked) / count(*), 6) AS lineage_coverage_pct FROM x""",
)
def _(t):
    owned = t.map_dataset_owner.select("dataset_id").distinct()
    return g.lineage_coverage(t.lineage_edge, owned).withColumn(
        "lineage_coverage_pct", F.round("lineage_coverage_pct", 6)
    )


@query(
    "lineage_dangling",
    "lineage_edge lineage_node",
    """SELECT edge_id, 'SOURCE' AS side, src_node_id AS node_id FROM lineage_edge
WHERE src_node_id NOT IN (SELECT node_id FROM lineage_node)
UNION ALL SELECT edge_id, 'TARGET', tgt_node_id FROM lineage_edge
WHERE tgt_node_id NOT IN (SELECT node_id FROM lineage_node)""",
)
def _(t):
    return g.lineage_dangling(t.lineage_node, t.lineage_edge)


@query(
    "lineage_roots_leaves",
    "lineage_edge lineage_node",
    """SELECT * FROM (SELECT node_id, node_type, CASE
  WHEN NOT s AND NOT d THEN 'ISOLATED' WHEN NOT d THEN 'ROOT' WHEN NOT s THEN 'LEAF' END AS position
FROM (SELECT *, node_id IN (SELECT src_node_id FROM lineage_edge) AS s,
  node_id IN (SELECT tgt_node_id FROM lineage_edge) AS d FROM lineage_node)) WHERE position IS NOT NULL""",
)
def _(t):
    return g.lineage_roots_leaves(t.lineage_node, t.lineage_edge)


# --- run tracking ------------------------------------------------------------------------

EVENTS = """SELECT run_id, 'START' AS event, started_at AS event_at, process_id, lower(system_id) AS system_name,
  NULL AS status, NULL AS error_message FROM process_run
UNION ALL SELECT run_id, 'START', started_at + INTERVAL '1' SECOND, process_id, lower(system_id), NULL, NULL FROM process_run
UNION ALL SELECT run_id, 'COMPLETE', ended_at, NULL, NULL, status, error_message FROM process_run WHERE ended_at IS NOT NULL"""


def run_events(t):
    run = t.process_run
    start = run.select(
        "run_id",
        F.lit("START").alias("event"),
        F.col("started_at").alias("event_at"),
        "process_id",
        F.lower("system_id").alias("system_name"),
        F.lit(None).cast("string").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )
    again = start.withColumn("event_at", F.expr("event_at + INTERVAL '1' SECOND"))
    done = run.where("ended_at IS NOT NULL").select(
        "run_id",
        F.lit("COMPLETE").alias("event"),
        F.col("ended_at").alias("event_at"),
        F.lit(None).cast("string").alias("process_id"),
        F.lit(None).cast("string").alias("system_name"),
        "status",
        "error_message",
    )
    return start.unionByName(again).unionByName(done)


KNOWN_RUNS = """SELECT CASE WHEN CAST(substr(run_id, 6) AS BIGINT) % 2 = 0 THEN run_id
    ELSE 'PRUN-OLD' || substr(run_id, 6) END AS run_id, process_id, system_id, started_at, 'STARTED' AS status
  FROM process_run"""


@query(
    "process_run_events",
    "process_run",
    f"""WITH ev AS ({EVENTS}), k AS ({KNOWN_RUNS}),
s AS (SELECT run_id, process_id, upper(system_name) AS system_id, event_at, row_number() OVER (PARTITION BY run_id ORDER BY event_at) AS n
  FROM ev WHERE event = 'START'),
a AS (SELECT * FROM k UNION ALL SELECT run_id, process_id, system_id, event_at, 'STARTED' FROM s
  WHERE n = 1 AND run_id NOT IN (SELECT run_id FROM k)),
c AS (SELECT run_id, event_at, status, error_message, row_number() OVER (PARTITION BY run_id ORDER BY event_at DESC) AS n
  FROM ev WHERE event = 'COMPLETE')
SELECT a.run_id, a.process_id, a.system_id, a.started_at, c.event_at AS ended_at, coalesce(c.status, a.status) AS status,
  c.error_message FROM a LEFT JOIN c ON c.run_id = a.run_id AND c.n = 1""",
)
def _(t):
    known = F.expr("CAST(substr(run_id, 6) AS BIGINT) % 2 = 0")
    renamed = F.concat(F.lit("PRUN-OLD"), F.expr("substr(run_id, 6)"))
    runs = t.process_run.select(
        F.when(known, F.col("run_id")).otherwise(renamed).alias("run_id"),
        "process_id",
        "system_id",
        "started_at",
        F.lit(None).cast("timestamp_ntz").alias("ended_at"),
        F.lit("STARTED").alias("status"),
        F.lit(None).cast("string").alias("error_message"),
    )
    return g.apply_run_events(runs, run_events(t))


@query(
    "systems_from_events",
    "process_run dim_system",
    f"""WITH ev AS ({EVENTS}), k AS (SELECT CASE WHEN system_type = 'DB' THEN 'OLD-' || system_id ELSE system_id END AS system_id,
  system_name, system_type FROM dim_system)
SELECT * FROM k UNION ALL SELECT upper(system_name), min(system_name), 'ETL_TOOL' FROM ev
WHERE event = 'START' AND upper(system_name) NOT IN (SELECT system_id FROM k) GROUP BY 1""",
)
def _(t):
    old = F.concat(F.lit("OLD-"), "system_id")
    systems = t.dim_system.withColumn(
        "system_id", F.when(F.col("system_type") == "DB", old).otherwise(F.col("system_id"))
    )
    return g.systems_from_events(systems, run_events(t))


@query(
    "one_shot_run",
    "process_run",
    f"""SELECT * FROM process_run UNION ALL BY NAME SELECT 'sync_1' AS run_id, 'DBT_DAILY_RUN' AS process_id,
  {NOW} - INTERVAL '30' MINUTE AS started_at, {NOW} AS ended_at, 'SUCCESS' AS status""",
)
def _(t):
    return g.one_shot_run(t.process_run, AS_OF, "sync_1", "DBT_DAILY_RUN")


@query(
    "manager_chain",
    "dim_party",
    """WITH RECURSIVE up(party_id, manager_id, level) AS (
  SELECT party_id, manager_party_id, 1 FROM dim_party WHERE manager_party_id IS NOT NULL
  UNION ALL SELECT u.party_id, p.manager_party_id, u.level + 1 FROM up u JOIN dim_party p ON p.party_id = u.manager_id
  WHERE p.manager_party_id IS NOT NULL)
SELECT party_id, manager_id, CAST(min(level) AS INTEGER) AS level FROM up GROUP BY 1, 2""",
)
def _(t):
    return g.manager_chain(t.dim_party)


_UP = """SELECT * FROM (WITH RECURSIVE up(party_id, manager_id, level) AS (
  SELECT party_id, manager_party_id, 1 FROM dim_party WHERE manager_party_id IS NOT NULL
  UNION ALL SELECT u.party_id, p.manager_party_id, u.level + 1 FROM up u JOIN dim_party p ON p.party_id = u.manager_id
  WHERE p.manager_party_id IS NOT NULL)
SELECT party_id, manager_id, CAST(min(level) AS INTEGER) AS level FROM up GROUP BY 1, 2)"""


@query("manager_intervals", "dim_party", _UP)
def _(t):
    return g.managers_of(g.manager_tree(t.dim_party))


@query(
    "manager_reports",
    "dim_party",
    f"""WITH a AS ({_UP}), p AS (SELECT party_id FROM dim_party)
SELECT party_id, coalesce((SELECT arg_max(manager_id, level) FROM a WHERE a.party_id = p.party_id), party_id) AS top_id,
  (SELECT count(*) FROM a WHERE a.party_id = p.party_id) AS levels_up,
  (SELECT count(*) FROM a WHERE a.manager_id = p.party_id) AS reports, FALSE AS circular FROM p""",
)
def _(t):
    return g.reports_of(g.manager_tree(t.dim_party))


@query(
    "lineage_reach_all",
    "lineage_edge",
    """WITH RECURSIVE e AS (SELECT DISTINCT src_node_id AS s, tgt_node_id AS d FROM lineage_edge WHERE active_flag AND src_node_id <> tgt_node_id),
walk(seed, node_id) AS (SELECT s, d FROM e UNION SELECT w.seed, e.d FROM walk w JOIN e ON e.s = w.node_id)
SELECT seed, node_id FROM walk WHERE seed <> node_id""",
)
def _(t):
    edges = t.lineage_edge
    seeds = edges.select(F.col("src_node_id").alias("node_id")).distinct()
    return g.reached_from(g.reach_index(edges), seeds)
