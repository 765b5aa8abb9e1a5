"""A small hand-checked registry: eight datasets, their owners, rules, runs and lineage."""

from __future__ import annotations

import datetime as dt

AS_OF = dt.datetime(2024, 3, 10, 12, 0, 0)


def ago(**kw) -> dt.datetime:
    return AS_OF - dt.timedelta(**kw)


def tables(spark) -> dict:
    def frame(ddl, data):
        return spark.createDataFrame(data, ddl)

    classes = ["PII", "Confidential", "PCI", "Internal", "INTERNAL", "PII", None, "Public"]
    domains = ["DOM-001", "DOM-002", "DOM-003", "DOM-004", "DOM-005", "DOM-001", None, "DOM-099"]
    return {
        "dim_domain": frame(
            "domain_id string, domain_name string",
            [
                ("DOM-001", "Retail Banking"),
                ("DOM-002", "Lending"),
                ("DOM-003", "Cards & Payments"),
                ("DOM-004", "Treasury"),
                ("DOM-005", "Risk Management"),
            ],
        ),
        "dim_dataset": frame(
            "dataset_id string, catalog_name string, system_id string, domain_id string, "
            "platform string, database_name string, schema_name string, object_name string, "
            "object_type string, dv_layer string, classification string, is_cde boolean, "
            "description string, certification string, created_at timestamp_ntz, "
            "updated_at timestamp_ntz",
            [
                (
                    f"DS-00{i + 1}", f"DW.CORE.T{i + 1}", "SYS-007", domains[i], "S3", "DW", "CORE",
                    f"T{i + 1}", "TABLE", None, classes[i], i % 2 == 0, None, "Certified",
                    ago(days=100), ago(days=3 if i else 0),
                )
                for i in range(8)
            ],
        ),
        "dim_party": frame(
            "party_id string, party_name string, email string, manager_party_id string",
            [
                ("PTY-001", "Ann", "ann@company.com", "PTY-003"),
                ("PTY-002", "Ben", None, "PTY-003"),
                ("PTY-003", "Cho", "cho@company.com", "PTY-100"),
                ("PTY-100", "Board", "board@company.com", None),
            ],
        ),
        "map_dataset_owner": frame(
            "dataset_id string, party_id string",
            [
                ("DS-001", "PTY-003"), ("DS-001", "PTY-001"), ("DS-001", "PTY-001"),
                ("DS-002", "PTY-002"), ("DS-003", "PTY-002"), ("DS-003", "PTY-100"),
                ("DS-004", "PTY-404"),
            ],
        ),
        "dq_rule": frame(
            "rule_id string, rule_name string, severity string, owner_party_id string, "
            "enabled_flag boolean",
            [
                (f"DQR-00{i}", f"rule {i}", "HIGH", "PTY-001" if i < 4 else None, True)
                for i in range(1, 6)
            ],
        ),
        "dq_run": frame(
            "run_id string, started_at timestamp_ntz, ended_at timestamp_ntz",
            [
                ("R-1", ago(hours=2), ago(hours=1)),
                ("R-2", ago(days=1), ago(hours=23)),
                ("R-3", ago(hours=4), ago(hours=3)),
            ],
        ),
        "dq_result": frame(
            "run_id string, rule_id string, dataset_id string, outcome string, "
            "metrics_summary string, evidence_ref string, created_at timestamp_ntz",
            [
                ("R-1", "DQR-001", "DS-001", "PASS", '{"completeness_rate": 99.8}', "e1", ago(hours=1)),
                ("R-1", "DQR-002", "DS-001", "PASS", '{"validity_rate": 98.5}', "e2", ago(hours=1)),
                ("R-1", "DQR-003", "DS-002", "FAIL", '{"validity_rate": 92.3}', "e3", ago(hours=1)),
                ("R-2", "DQR-001", "DS-001", "FAIL", '{"completeness_rate": 99.9}', "e4", ago(days=1)),
                ("R-2", "DQR-005", "DS-001", "WARN", '{"uniqueness_rate": 99.1}', "e5", ago(days=1)),
                ("R-9", "DQR-004", "DS-003", "PASS", "{}", "e6", ago(hours=1)),
            ],
        ),
        "lineage_node": frame(
            "node_id string, node_type string, name string",
            [
                ("LN-001", "DATASET", "Accounts"), ("LN-002", "DATASET", "Loans"),
                ("LN-004", "JOB", "Customer load"), ("LN-005", "JOB", "Loan load"),
                ("LN-006", "REPORT", "Portfolio"), ("LN-007", "DATASET", "Raw events"),
                ("LN-008", "API", "Unused"),
            ],
        ),
        "lineage_edge": frame(
            "edge_id string, src_node_id string, tgt_node_id string, edge_type string, "
            "active_flag boolean",
            [
                ("LE-1", "LN-007", "LN-001", "TRANSFORMS", True),
                ("LE-2", "LN-001", "LN-006", "CONSUMES", True),
                ("LE-3", "LN-002", "LN-006", "CONSUMES", True),
                ("LE-4", "LN-004", "LN-001", "LOADS", True),
                ("LE-5", "LN-005", "LN-002", "LOADS", True),
                ("LE-6", "LN-007", "LN-001", "LOADS", True),
                ("LE-7", "LN-007", "LN-002", "LOADS", False),
                ("LE-8", "LN-006", "LN-001", "DERIVES", True),
                ("LE-9", "LN-006", "LN-404", "DERIVES", True),
            ],
        ),
        "risk_item": frame(
            "risk_id string, title string, category string, severity string, likelihood string, "
            "impact string, owner_party_id string, status string",
            [
                ("RSK-1", "a", "Security", "CRITICAL", "LOW", "HIGH", "PTY-001", "OPEN"),
                ("RSK-2", "b", "Security", "HIGH", "LOW", "LOW", "PTY-001", "MITIGATED"),
                ("RSK-3", "c", "Security", "LOW", "LOW", "HIGH", "PTY-404", "OPEN"),
                ("RSK-4", "d", "Security", "MEDIUM", "LOW", "MEDIUM", None, "CLOSED"),
            ],
        ),
    }
