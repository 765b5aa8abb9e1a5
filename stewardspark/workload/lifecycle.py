"""Effective dates, retention, exceptions, certifications, changes and executive numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as k
from ..plans.executive import executive_kpis
from .registry import AS_OF, CHANGE_AS_OF, query

NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"


@query(
    "owners_as_of",
    "map_dataset_owner",
    """SELECT dataset_id, party_id, role_type FROM map_dataset_owner
WHERE effective_from <= TIMESTAMP '1999-07-01' AND (effective_to IS NULL OR effective_to > TIMESTAMP '1999-07-01')""",
)
def _(t):
    return k.owners_as_of(t.map_dataset_owner, "1999-07-01")


def _asof_sql(facts: str, cols: str, ts: str) -> str:
    return f"""WITH f AS (SELECT * FROM {facts}),
o AS (SELECT dataset_id, effective_from, max(struct_pack(party_id, role_type, effective_to)) AS p
  FROM map_dataset_owner GROUP BY 1, 2),
j AS (SELECT {cols}, o.p FROM f ASOF LEFT JOIN o ON f.dataset_id = o.dataset_id AND f.{ts} >= o.effective_from)
SELECT * EXCLUDE (p), CASE WHEN p.effective_to IS NULL OR p.effective_to > {ts} THEN p.party_id END AS owner_party_id,
  CASE WHEN p.effective_to IS NULL OR p.effective_to > {ts} THEN p.role_type END AS owner_role FROM j"""


@query(
    "result_owner_as_of",
    "map_dataset_owner dq_result",
    _asof_sql("dq_result", "f.dataset_id, f.evidence_ref, f.created_at", "created_at"),
)
def _(t):
    facts = t.dq_result.select("dataset_id", "evidence_ref", "created_at")
    return k.result_owner_as_of(facts, t.map_dataset_owner)


SHIPPED = """(SELECT 'DS-' || CAST(l_partkey AS VARCHAR) AS dataset_id, l_orderkey, l_linenumber, l_quantity,
  l_shipdate AS created_at FROM lineitem)"""


@query(
    "shipment_owner_as_of",
    "map_dataset_owner",
    _asof_sql(
        SHIPPED, "f.dataset_id, f.l_orderkey, f.l_linenumber, f.l_quantity, f.created_at",
        "created_at",
    ),
)
def _(t):
    facts = t.lineitem.select(
        F.concat(F.lit("DS-"), F.col("l_partkey").cast("string")).alias("dataset_id"),
        "l_orderkey",
        "l_linenumber",
        "l_quantity",
        F.col("l_shipdate").alias("created_at"),
    )
    return k.result_owner_as_of(facts, t.map_dataset_owner, bucket="month", split_rows=1_000_000)


@query(
    "contract_in_force",
    "data_contract",
    """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id
  ORDER BY effective_from DESC, version DESC, contract_id DESC) AS n FROM data_contract
  WHERE effective_from <= TIMESTAMP '2024-01-01 12:00:00' AND (effective_to IS NULL OR effective_to > TIMESTAMP '2024-01-01 12:00:00'))
WHERE n = 1""",
)
def _(t):
    return k.version_in_force(t.data_contract, "2024-01-01T12:00:00")


@query(
    "policy_in_force",
    "policy_registry",
    """SELECT policy_type, max_by(policy_id, rank) AS policy_id, max_by(version, rank) AS version FROM (
  SELECT *, struct_pack(a := effective_from, b := list_transform(string_split(version, '.'), lambda z: z::INT), c := policy_id) AS rank
  FROM policy_registry WHERE effective_from <= DATE '2024-01-15' AND coalesce(effective_to > DATE '2024-01-15', TRUE)) GROUP BY policy_type""",
)
def _(t):
    found = k.version_in_force(t.policy_registry, "2024-01-15", "policy_type", "policy_id")
    return found.select("policy_type", "policy_id", "version")


def _overlap_sql(table: str, key: str, ident: str, kind: str = "TIMESTAMP") -> str:
    return f"""SELECT * FROM (SELECT {key}, {ident}, effective_from, effective_to,
  max(coalesce(effective_to, {kind} '9999-12-31')) OVER (PARTITION BY {key} ORDER BY effective_from, {ident}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS covered_until FROM {table}) WHERE effective_from < covered_until"""


@query("interval_overlaps", "data_contract", _overlap_sql("data_contract", "dataset_id", "contract_id"))
def _(t):
    return k.interval_overlaps(t.data_contract, "dataset_id", "contract_id")


@query(
    "owner_interval_overlaps",
    "map_dataset_owner",
    _overlap_sql("map_dataset_owner", "dataset_id", "map_id"),
)
def _(t):
    return k.interval_overlaps(t.map_dataset_owner, "dataset_id", "map_id")


@query(
    "policy_overlaps", "policy_registry", _overlap_sql("policy_registry", "policy_type", "policy_id", "DATE")
)
def _(t):
    return k.interval_overlaps(t.policy_registry, "policy_type", "policy_id")


RETENTION = f"""SELECT d.dataset_id, d.retention_policy_id, CAST(date_diff('day', d.created_at, {NOW}) AS INTEGER) AS age_days,
  r.legal_hold_flag, date_diff('day', d.created_at, {NOW}) > r.duration_days AND NOT r.legal_hold_flag AS expired,
  CASE WHEN date_diff('day', d.created_at, {NOW}) > r.duration_days AND NOT r.legal_hold_flag THEN r.disposition ELSE 'KEEP' END AS action
FROM dim_dataset d JOIN retention_policy r ON r.policy_id = d.retention_policy_id"""


@query("retention_due", "dim_dataset retention_policy", RETENTION)
def _(t):
    return k.retention_due(t.dim_dataset, t.retention_policy, AS_OF)


@query(
    "retention_summary",
    "dim_dataset retention_policy",
    f"SELECT action, count(*) AS datasets FROM ({RETENTION}) GROUP BY action",
)
def _(t):
    return k.retention_summary(k.retention_due(t.dim_dataset, t.retention_policy, AS_OF))


@query(
    "exception_status",
    "access_exception",
    """SELECT *, CASE WHEN status <> 'APPROVED' THEN status WHEN effective_to <= TIMESTAMP '2024-01-10' THEN 'EXPIRED'
  WHEN effective_from > TIMESTAMP '2024-01-10' THEN 'PENDING' ELSE 'ACTIVE' END AS effective_status FROM access_exception""",
)
def _(t):
    return k.exception_status(t.access_exception, "2024-01-10")


@query(
    "attestation_coverage",
    "attestation",
    """SELECT scope_id, count(*) AS attestations, count(*) FILTER (status = 'APPROVED') AS approved,
  bool_or(status = 'APPROVED') AS covered FROM attestation
WHERE period_start <= DATE '2024-01-15' AND period_end >= DATE '2024-01-01' GROUP BY scope_id""",
)
def _(t):
    return k.attestation_coverage(t.attestation, "2024-01-01", "2024-01-15")


@query(
    "attested_days",
    "attestation",
    """WITH day AS (SELECT unnest(generate_series(DATE '2023-12-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS d),
x AS (SELECT s.scope_id, d, EXISTS (SELECT 1 FROM attestation a WHERE a.scope_id = s.scope_id AND a.status = 'APPROVED'
    AND d BETWEEN a.period_start AND a.period_end) AS held FROM (SELECT DISTINCT scope_id FROM attestation) s, day),
g AS (SELECT scope_id, d - CAST(row_number() OVER (PARTITION BY scope_id ORDER BY d) AS INTEGER) AS island FROM x WHERE NOT held),
n AS (SELECT scope_id, island, count(*) AS n FROM g GROUP BY ALL)
SELECT scope_id, count(*) FILTER (held) AS covered_days, count(*) FILTER (NOT held) AS gap_days,
  (SELECT count(*) FROM n WHERE n.scope_id = x.scope_id) AS gaps,
  coalesce((SELECT max(n) FROM n WHERE n.scope_id = x.scope_id), 0) AS longest_gap FROM x GROUP BY scope_id""",
)
def _(t):
    return k.attested_days(t.attestation, "2023-12-01", "2024-01-31")


@query(
    "ownership_spans",
    "map_dataset_owner",
    """WITH o AS (SELECT dataset_id, effective_from AS a, effective_to AS b FROM map_dataset_owner WHERE effective_from < effective_to),
m AS (SELECT *, max(b) OVER (PARTITION BY dataset_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM o),
i AS (SELECT *, count(*) FILTER (r IS NULL OR a > r) OVER (PARTITION BY dataset_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m),
s AS (SELECT dataset_id, n, min(a) AS span_from, max(b) AS span_to FROM i GROUP BY ALL)
SELECT dataset_id, span_from, span_to, lag(span_to) OVER (PARTITION BY dataset_id ORDER BY span_from) AS previous_to FROM s""",
)
def _(t):
    return k.interval_union(t.map_dataset_owner, "dataset_id", "effective_from", "effective_to")


@query(
    "current_certification",
    "certification_event dim_dataset",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY effective_at DESC, event_id DESC) AS n FROM certification_event)
SELECT l.dataset_id, l.status AS event_status, l.effective_at, d.certification,
  l.status IS DISTINCT FROM upper(d.certification) AS drifted
FROM l LEFT JOIN dim_dataset d ON d.dataset_id = l.dataset_id WHERE n = 1""",
)
def _(t):
    return k.current_certification(t.certification_event, t.dim_dataset)


@query(
    "change_state",
    "change_request change_approval",
    """WITH l AS (SELECT *, row_number() OVER (PARTITION BY cr_id, approver_party_id ORDER BY decided_at DESC, approval_id DESC) AS n FROM change_approval),
v AS (SELECT cr_id, count(*) AS approvers, bool_or(decision = 'REJECT') AS rej, bool_or(decision = 'REQUEST_CHANGES') AS chg FROM l WHERE n = 1 GROUP BY 1)
SELECT c.cr_id, c.status, CASE WHEN approvers IS NULL THEN 'PENDING' WHEN rej THEN 'REJECTED' WHEN chg THEN 'CHANGES_REQUESTED'
  ELSE 'APPROVED' END AS decided_state, coalesce(approvers, 0) AS approvers FROM change_request c LEFT JOIN v ON v.cr_id = c.cr_id""",
)
def _(t):
    return k.change_state(t.change_request, t.change_approval)


@query(
    "raci_violations",
    "map_raci",
    """SELECT scope_type, scope_id, count(*) FILTER (raci_role = 'A') AS accountable, count(*) FILTER (raci_role = 'R') AS responsible
FROM map_raci GROUP BY 1, 2 HAVING count(*) FILTER (raci_role = 'A') <> 1 OR count(*) FILTER (raci_role = 'R') = 0""",
)
def _(t):
    return k.raci_violations(t.map_raci)


@query(
    "cde_coverage",
    "dim_cde map_dataset_attribute dq_rule",
    """WITH m AS (SELECT a.cde_id, bool_or(a.dataset_id IN (SELECT dataset_id FROM dq_rule WHERE enabled_flag)) AS ruled
  FROM map_dataset_attribute a WHERE a.cde_id IS NOT NULL GROUP BY 1)
SELECT c.materiality, count(*) AS cdes, count(m.cde_id) AS mapped_cdes, count(*) FILTER (m.ruled) AS ruled_cdes,
  round(100.0::DOUBLE * count(m.cde_id) / count(*), 6) AS mapped_pct FROM dim_cde c LEFT JOIN m ON m.cde_id = c.cde_id GROUP BY 1""",
)
def _(t):
    return k.cde_coverage(t.dim_cde, t.map_dataset_attribute, t.dq_rule).withColumn(
        "mapped_pct", F.round("mapped_pct", 6)
    )


_SCORE = "CASE {c} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 END"


@query(
    "executive_kpis",
    "dq_result dim_dataset dim_domain map_dataset_owner control_test control_registry policy_registry "
    "risk_item lineage_edge process_run privacy_assessment change_request change_approval",
    f"""WITH k AS (
SELECT 'data_quality_score' AS kpi, 'ALL' AS dimension, 100.0::DOUBLE * count(*) FILTER (outcome = 'PASS') / count(*) AS value
  FROM dq_result r JOIN dim_dataset d ON d.dataset_id = r.dataset_id JOIN dim_domain m ON m.domain_id = d.domain_id
  WHERE r.created_at >= TIMESTAMP '2024-01-06'
UNION ALL SELECT 'ownership_coverage_pct', 'ALL', 100.0::DOUBLE * count(*) FILTER (dataset_id IN (SELECT dataset_id FROM map_dataset_owner)) / count(*) FROM dim_dataset
UNION ALL SELECT 'policy_compliance_rate_pct', 'ALL', 100.0::DOUBLE * count(*) FILTER (t.outcome = 'PASS') / count(*)
  FROM control_test t JOIN control_registry c ON c.control_id = t.control_id JOIN policy_registry p ON p.policy_id = c.policy_id
  WHERE t.executed_at >= TIMESTAMP '2023-11-07'
UNION ALL SELECT 'risk_exposure', severity, CAST(sum({_SCORE.format(c="likelihood")} * {_SCORE.format(c="impact")}) AS DOUBLE) FROM risk_item WHERE status = 'OPEN' GROUP BY severity
UNION ALL SELECT 'lineage_coverage_pct', 'ALL', 100.0::DOUBLE * count(*) FILTER (dataset_id IN (SELECT src_node_id FROM lineage_edge) OR dataset_id IN (SELECT tgt_node_id FROM lineage_edge)) / count(*) FROM dim_dataset
UNION ALL SELECT 'data_freshness_days', 'ALL', CAST(date_diff('day', max(updated_at), {NOW}) AS DOUBLE) FROM dim_dataset
UNION ALL SELECT 'processing_success_rate_pct', 'ALL', 100.0::DOUBLE * count(*) FILTER (status = 'SUCCESS') / count(*) FROM process_run WHERE started_at >= TIMESTAMP '2024-01-06'
UNION ALL SELECT 'privacy_assessment_coverage_pct', 'ALL', 100.0::DOUBLE * count(*) FILTER (dataset_id IN (SELECT dataset_id FROM privacy_assessment)) / count(*) FROM dim_dataset WHERE classification IN ('PII', 'CONFIDENTIAL')
UNION ALL SELECT 'change_approval_days', 'ALL', avg(date_diff('day', c.created_at, a.at)) FROM change_request c
  JOIN (SELECT cr_id, max(decided_at) AS at FROM change_approval WHERE decision = 'APPROVE' GROUP BY 1) a ON a.cr_id = c.cr_id
  WHERE c.created_at >= TIMESTAMP '2000-08-01')
SELECT kpi, dimension, round(value, 6) AS value FROM k""",
)
def _(t):
    return executive_kpis(t, AS_OF, change_as_of=CHANGE_AS_OF).withColumn(
        "value", F.round("value", 6)
    )
