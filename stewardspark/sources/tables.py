"""Schemas and declared constraints of the governance tables.

Fixed values: table and column names, keys, references and vocabularies of the data model.
Column names are lower-case; semi-structured documents are JSON strings.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_STAMPS = "created_at timestamp, updated_at timestamp"

SCHEMAS: dict[str, str] = {
    # catalog
    "dim_domain": "domain_id string, domain_name string, description string, criticality string, "
    "owner_group string",
    "dim_system": "system_id string, system_name string, system_type string, owner_group string, "
    "description string",
    "dim_dataset": "dataset_id string, catalog_name string, system_id string, domain_id string, "
    "platform string, database_name string, schema_name string, object_name string, "
    "object_type string, dv_layer string, classification string, is_cde boolean, "
    "description string, retention_policy_id string, certification string",
    "dim_term": "term_id string, term_name string, definition string, domain_id string, "
    "steward_party_id string, status string",
    "dim_cde": "cde_id string, term_id string, name string, description string, "
    "materiality string, owner_group string",
    "map_dataset_attribute": "map_id string, dataset_id string, column_name string, "
    "term_id string, cde_id string, semantic_type string, quality_critical boolean, "
    "description string",
    # ownership
    "dim_party": "party_id string, party_type string, party_name string, email string, "
    "manager_party_id string",
    "map_dataset_owner": "map_id string, dataset_id string, party_id string, role_type string, "
    "effective_from timestamp, effective_to timestamp",
    "map_raci": "map_id string, scope_type string, scope_id string, party_id string, "
    "raci_role string",
    # governance
    "policy_registry": "policy_id string, policy_name string, policy_type string, version string, "
    "effective_from date, effective_to date, owner_party_id string, text string",
    "control_registry": "control_id string, control_name string, control_type string, "
    "policy_id string, scope_type string, scope_id string, description string, "
    "tolerance_abs decimal(38,6), tolerance_pct decimal(9,6), materiality_abs decimal(38,6), "
    "severity string, owner_party_id string, enabled_flag boolean",
    "data_contract": "contract_id string, dataset_id string, version string, "
    "contract_json string, producer_party_id string, consumer_party_id string, "
    "effective_from timestamp, effective_to timestamp, status string",
    "classification": "class_id string, class_name string, description string",
    "retention_policy": "policy_id string, policy_name string, duration_days int, "
    "disposition string, legal_hold_flag boolean",
    # lineage; system and error of a run serve the run-tracking operators
    "lineage_node": "node_id string, node_type string, ref_id string, name string, "
    "description string",
    "lineage_edge": "edge_id string, src_node_id string, tgt_node_id string, edge_type string, "
    "logic_ref string, active_flag boolean",
    "process": "process_id string, name string, orchestrator string, pipeline_job_id string, "
    "owner_party_id string, description string",
    "process_run": "run_id string, process_id string, system_id string, started_at timestamp, "
    "ended_at timestamp, status string, input_signature string, output_signature string, "
    "trigger_ref string, error_message string",
    # security
    "masking_policy_registry": "policy_id string, policy_name string, policy_kind string, "
    "logic_snippet string, owner_party_id string, description string",
    "row_access_policy_registry": "policy_id string, policy_name string, scope_desc string, "
    "owner_party_id string, description string",
    "privacy_assessment": "assessment_id string, dataset_id string, class_id string, "
    "risk_rating string, notes string, reviewed_by string, reviewed_at timestamp",
    "access_exception": "exception_id string, dataset_id string, party_id string, reason string, "
    "approved_by string, effective_from timestamp, effective_to timestamp, status string",
    # risk; the risk of a test links tests to risk items
    "risk_item": "risk_id string, title string, description string, category string, "
    "severity string, likelihood string, impact string, owner_party_id string, status string",
    "control_test": "test_id string, control_id string, run_id string, risk_id string, "
    "executed_at timestamp, outcome string, details string",
    "attestation": "attestation_id string, scope_type string, scope_id string, period_start date, "
    "period_end date, attestor_party_id string, statement string, status string",
    # quality
    "dq_rule": "rule_id string, rule_name string, rule_type string, dataset_id string, "
    "column_name string, config_json string, severity string, owner_party_id string, "
    "enabled_flag boolean",
    "dq_run": "run_id string, started_at timestamp, ended_at timestamp, orchestrator string, "
    "status string",
    "dq_result": "run_id string, rule_id string, dataset_id string, outcome string, "
    "metrics_summary string, evidence_ref string",
    # change
    "change_request": "cr_id string, scope_type string, scope_id string, title string, "
    "description string, requestor_party_id string, status string",
    "change_approval": "approval_id string, cr_id string, approver_party_id string, "
    "decision string, decided_at timestamp, comments string",
    "certification_event": "event_id string, dataset_id string, status string, reason string, "
    "effective_at timestamp, actor_party_id string",
}
SCHEMAS = {name: f"{ddl}, {_STAMPS}" for name, ddl in SCHEMAS.items()}
SCHEMAS |= {
    # application
    "app_feature_flag": "feature_name string, enabled boolean, description string, "
    "roles_allowed array<string>, config_json string, created_at timestamp",
    "role_page_access": "role_name string, page_name string, access_level string, "
    "created_at timestamp",
    "access_log": "ts timestamp, role_name string, page_name string, allowed boolean, "
    "reason string",
    "app_telemetry": "session_id string, user_name string, role_name string, page_name string, "
    "action string, ts timestamp, created_at timestamp",
}


def schema(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "dim_domain": ("domain_id",),
    "dim_system": ("system_id",),
    "dim_dataset": ("dataset_id",),
    "dim_term": ("term_id",),
    "dim_cde": ("cde_id",),
    "map_dataset_attribute": ("map_id",),
    "dim_party": ("party_id",),
    "map_dataset_owner": ("map_id",),
    "map_raci": ("map_id",),
    "policy_registry": ("policy_id",),
    "control_registry": ("control_id",),
    "data_contract": ("contract_id",),
    "classification": ("class_id",),
    "retention_policy": ("policy_id",),
    "lineage_node": ("node_id",),
    "lineage_edge": ("edge_id",),
    "process": ("process_id",),
    "process_run": ("run_id",),
    "masking_policy_registry": ("policy_id",),
    "row_access_policy_registry": ("policy_id",),
    "privacy_assessment": ("assessment_id",),
    "access_exception": ("exception_id",),
    "risk_item": ("risk_id",),
    "control_test": ("test_id",),
    "attestation": ("attestation_id",),
    "dq_rule": ("rule_id",),
    "dq_run": ("run_id",),
    "dq_result": ("run_id", "rule_id"),
    "change_request": ("cr_id",),
    "change_approval": ("approval_id",),
    "certification_event": ("event_id",),
}

# child table, child column, parent table, parent column
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("dim_dataset", "system_id", "dim_system", "system_id"),
    ("dim_dataset", "domain_id", "dim_domain", "domain_id"),
    ("dim_term", "domain_id", "dim_domain", "domain_id"),
    ("dim_cde", "term_id", "dim_term", "term_id"),
    ("map_dataset_attribute", "dataset_id", "dim_dataset", "dataset_id"),
    ("map_dataset_attribute", "term_id", "dim_term", "term_id"),
    ("map_dataset_attribute", "cde_id", "dim_cde", "cde_id"),
    ("dim_party", "manager_party_id", "dim_party", "party_id"),
    ("map_dataset_owner", "dataset_id", "dim_dataset", "dataset_id"),
    ("map_dataset_owner", "party_id", "dim_party", "party_id"),
    ("map_raci", "party_id", "dim_party", "party_id"),
    ("policy_registry", "owner_party_id", "dim_party", "party_id"),
    ("control_registry", "policy_id", "policy_registry", "policy_id"),
    ("control_registry", "owner_party_id", "dim_party", "party_id"),
    ("data_contract", "dataset_id", "dim_dataset", "dataset_id"),
    ("data_contract", "producer_party_id", "dim_party", "party_id"),
    ("data_contract", "consumer_party_id", "dim_party", "party_id"),
    ("lineage_edge", "src_node_id", "lineage_node", "node_id"),
    ("lineage_edge", "tgt_node_id", "lineage_node", "node_id"),
    ("process", "owner_party_id", "dim_party", "party_id"),
    ("process_run", "process_id", "process", "process_id"),
    ("masking_policy_registry", "owner_party_id", "dim_party", "party_id"),
    ("row_access_policy_registry", "owner_party_id", "dim_party", "party_id"),
    ("privacy_assessment", "dataset_id", "dim_dataset", "dataset_id"),
    ("privacy_assessment", "class_id", "classification", "class_id"),
    ("privacy_assessment", "reviewed_by", "dim_party", "party_id"),
    ("access_exception", "dataset_id", "dim_dataset", "dataset_id"),
    ("access_exception", "party_id", "dim_party", "party_id"),
    ("access_exception", "approved_by", "dim_party", "party_id"),
    ("risk_item", "owner_party_id", "dim_party", "party_id"),
    ("control_test", "control_id", "control_registry", "control_id"),
    ("attestation", "attestor_party_id", "dim_party", "party_id"),
    ("dq_rule", "dataset_id", "dim_dataset", "dataset_id"),
    ("dq_rule", "owner_party_id", "dim_party", "party_id"),
    ("dq_result", "run_id", "dq_run", "run_id"),
    ("dq_result", "rule_id", "dq_rule", "rule_id"),
    ("dq_result", "dataset_id", "dim_dataset", "dataset_id"),
    ("change_request", "requestor_party_id", "dim_party", "party_id"),
    ("change_approval", "cr_id", "change_request", "cr_id"),
    ("change_approval", "approver_party_id", "dim_party", "party_id"),
    ("certification_event", "dataset_id", "dim_dataset", "dataset_id"),
    ("certification_event", "actor_party_id", "dim_party", "party_id"),
)

NOT_NULL: dict[str, tuple[str, ...]] = {
    "dim_domain": ("domain_name",),
    "dim_system": ("system_name",),
    "dim_term": ("term_name",),
    "dim_cde": ("name",),
    "dim_party": ("party_type", "party_name"),
    "policy_registry": ("policy_name",),
    "control_registry": ("control_name",),
    "data_contract": ("version",),
    "classification": ("class_name",),
    "retention_policy": ("policy_name",),
    "lineage_node": ("node_type",),
    "process": ("name",),
    "masking_policy_registry": ("policy_name",),
    "row_access_policy_registry": ("policy_name",),
    "risk_item": ("title",),
    "dq_rule": ("rule_name",),
    "change_request": ("title",),
}

_LEVELS = ("HIGH", "MEDIUM", "LOW")
_SEVERITIES = ("CRITICAL", *_LEVELS)
_OUTCOMES = ("PASS", "FAIL", "WARN")
_RUN_STATES = ("SUCCESS", "FAILED", "PARTIAL")

VOCABULARIES: dict[tuple[str, str], tuple[str, ...]] = {
    ("dim_party", "party_type"): ("PERSON", "GROUP"),
    ("dim_term", "status"): ("Draft", "Approved", "Deprecated"),
    ("map_dataset_owner", "role_type"): ("OWNER", "STEWARD", "CUSTODIAN", "PRODUCER", "CONSUMER"),
    ("map_raci", "scope_type"): ("DATASET", "POLICY", "CONTROL", "TERM", "CDE"),
    ("map_raci", "raci_role"): ("R", "A", "C", "I"),
    ("policy_registry", "policy_type"): (
        "RETENTION", "CLASSIFICATION", "ACCESS", "LINEAGE", "QUALITY", "RECON", "SECURITY",
    ),
    ("control_registry", "control_type"): ("PREVENTIVE", "DETECTIVE", "CORRECTIVE"),
    ("control_registry", "scope_type"): ("DATASET", "PROCESS", "PIPELINE", "RULE"),
    ("control_registry", "severity"): _SEVERITIES,
    ("data_contract", "status"): ("DRAFT", "ACTIVE", "DEPRECATED"),
    ("retention_policy", "disposition"): ("ARCHIVE", "PURGE", "ANONYMIZE"),
    ("lineage_node", "node_type"): ("DATASET", "JOB", "REPORT", "API"),
    ("lineage_edge", "edge_type"): ("LOADS", "TRANSFORMS", "DERIVES", "CONSUMES"),
    ("process", "orchestrator"): (
        "Airflow", "Control-M", "dbt", "Qlik", "Informatica", "DataStage",
    ),
    ("process_run", "status"): _RUN_STATES,
    ("masking_policy_registry", "policy_kind"): ("STATIC", "DYNAMIC"),
    ("privacy_assessment", "risk_rating"): _LEVELS,
    ("access_exception", "status"): ("REQUESTED", "APPROVED", "REVOKED", "EXPIRED"),
    ("risk_item", "category"): ("Operational", "Security", "Compliance", "DataQuality"),
    ("risk_item", "severity"): _SEVERITIES,
    ("risk_item", "likelihood"): _LEVELS,
    ("risk_item", "impact"): _LEVELS,
    ("risk_item", "status"): ("OPEN", "MITIGATED", "ACCEPTED", "CLOSED"),
    ("control_test", "outcome"): _OUTCOMES,
    ("attestation", "scope_type"): ("DATASET", "DOMAIN", "POLICY", "CONTROL"),
    ("attestation", "status"): ("SUBMITTED", "APPROVED", "REJECTED"),
    ("dq_rule", "rule_type"): (
        "COMPLETENESS", "UNIQUENESS", "VALIDITY", "CONSISTENCY", "ACCURACY", "TIMELINESS",
        "SCHEMA_DRIFT",
    ),
    ("dq_rule", "severity"): _SEVERITIES,
    ("dq_run", "orchestrator"): ("Airflow", "dbt", "GreatExpectations", "Custom"),
    ("dq_run", "status"): _RUN_STATES,
    ("dq_result", "outcome"): _OUTCOMES,
    ("change_request", "scope_type"): ("DATASET", "TERM", "CDE", "POLICY", "CONTROL", "DQ_RULE"),
    ("change_request", "status"): ("DRAFT", "SUBMITTED", "APPROVED", "REJECTED", "IMPLEMENTED"),
    ("change_approval", "decision"): ("APPROVE", "REJECT", "REQUEST_CHANGES"),
    ("certification_event", "status"): ("CERTIFIED", "DEPRECATED", "UNDER_REVIEW"),
}
