"""Enriched and governed views, access policies and page access."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import policies as p
from ..operators import views as v
from .metrics import LATEST
from .registry import query

# The checks look every name up by its key, one lookup per column, instead of joining.


def _of(table: str, key: str, value: str, column: str) -> str:
    return f"(SELECT {column} FROM {table} AS x WHERE x.{key} = {value})"


def _party(value: str, column: str) -> str:
    return _of("dim_party", "party_id", value, column)


def _dataset(value: str, column: str) -> str:
    return _of("dim_dataset", "dataset_id", value, column)


TODAY = """WITH l AS ({latest}),
found AS (SELECT dataset_id, list(struct_pack(run_at := started_at, result := outcome)) AS hits FROM l WHERE rn = 1 GROUP BY dataset_id),
shown AS (SELECT *, unnest(coalesce((SELECT hits FROM found WHERE found.dataset_id = s.dataset_id), [NULL])) AS hit FROM dim_dataset s)
SELECT dataset_id, domain_id AS domain_name, classification, certification, hit.run_at AS last_dq_run_at,
  hit.result AS last_dq_outcome FROM shown"""


@query(
    "vw_today_health",
    "dim_dataset dq_result dq_run",
    TODAY.format(latest=LATEST.format(keys="r.rule_id")),
)
def _(t):
    return v.today_health(t.dim_dataset, t.dq_result, t.dq_run)


@query(
    "vw_today_health_per_dataset",
    "dim_dataset dq_result dq_run",
    TODAY.format(latest=LATEST.format(keys="r.dataset_id, r.rule_id")),
)
def _(t):
    return v.today_health(t.dim_dataset, t.dq_result, t.dq_run, ("dataset_id", "rule_id"))


ENRICHED_TABLES = "dq_result dq_run dim_dataset dq_rule dim_party"
ENRICHED = f"""
SELECT run_id, rule_id, dataset_id, outcome, metrics_summary, evidence_ref,
  {_dataset("r.dataset_id", "domain_id")} AS domain_name, {_dataset("r.dataset_id", "classification")} AS classification,
  {_of("dq_run", "run_id", "r.run_id", "started_at")} AS started_at, {_of("dq_run", "run_id", "r.run_id", "ended_at")} AS ended_at,
  {_of("dq_rule", "rule_id", "r.rule_id", "rule_name")} AS rule_name, {_of("dq_rule", "rule_id", "r.rule_id", "severity")} AS severity,
  {_party("r.owner", "party_name")} AS owner_name, {_party("r.owner", "email")} AS owner_email
FROM (SELECT *, {_of("dq_rule", "rule_id", "q.rule_id", "owner_party_id")} AS owner FROM dq_result q
  WHERE run_id IN (SELECT run_id FROM dq_run)) r"""


def enriched(t):
    return v.dq_results_enriched(t.dq_result, t.dq_run, t.dim_dataset, t.dq_rule, t.dim_party)


query("vw_dq_results_enriched", ENRICHED_TABLES, ENRICHED)(enriched)


_CONTROL = {c: _of("control_registry", "control_id", "k.control_id", c) for c in
            ("control_name", "severity", "scope_type", "scope_id", "owner_party_id")}
CONTROLS = f"""SELECT test_id, control_id, {_CONTROL["control_name"]} AS control_name, {_CONTROL["severity"]} AS severity,
  run_id, executed_at, outcome, details, {_CONTROL["scope_type"]} AS scope_type, {_CONTROL["scope_id"]} AS scope_id,
  {_party("k.owner", "party_name")} AS owner_name, {_party("k.owner", "email")} AS owner_email
FROM (SELECT *, {_CONTROL["owner_party_id"]} AS owner FROM control_test k) k"""


@query(
    "vw_control_results_enriched",
    "control_test control_registry dim_party",
    CONTROLS,
)
def _(t):
    return v.control_results_enriched(t.control_test, t.control_registry, t.dim_party)


OWNERS = """SELECT dataset_id, domain_id AS domain_name, classification,
  coalesce(array_to_string(list_sort(list_distinct(people)), '; '), '') AS owner_emails
FROM (SELECT *, (SELECT list(p.party_name || ' <' || {email} || '>') FROM dim_party p WHERE p.party_id IN
  (SELECT party_id FROM map_dataset_owner m WHERE m.dataset_id = s.dataset_id)) AS people FROM dim_dataset s)"""
OWNER_TABLES = "dim_dataset map_dataset_owner dim_party"


@query("vw_dataset_owners", OWNER_TABLES, OWNERS.format(email="p.email"))
def _(t):
    return v.dataset_owners(t.dim_dataset, t.map_dataset_owner, t.dim_party)


GLOSSARY = f"""SELECT term_id, term_name, definition, {_of("dim_domain", "domain_id", "g.domain_id", "domain_id")} AS domain_name,
  {_party("g.steward_party_id", "party_name")} AS steward_name, {{email}} AS steward_email, status FROM dim_term g"""


@query(
    "vw_business_glossary",
    "dim_term dim_domain dim_party",
    GLOSSARY.format(email=_party("g.steward_party_id", "email")),
)
def _(t):
    return v.business_glossary(t.dim_term, t.dim_domain, t.dim_party)


CONTRACTS = f"""SELECT contract_id, dataset_id, {_dataset("a.dataset_id", "domain_id")} AS domain_name,
  {_dataset("a.dataset_id", "classification")} AS classification, version, status,
  {_party("a.producer_party_id", "party_name")} AS producer_name, {{producer}} AS producer_email,
  {_party("a.consumer_party_id", "party_name")} AS consumer_name, {{consumer}} AS consumer_email FROM data_contract a"""


@query(
    "vw_data_contracts",
    "data_contract dim_dataset dim_party",
    CONTRACTS.format(producer=_party("a.producer_party_id", "email"), consumer=_party("a.consumer_party_id", "email")),
)
def _(t):
    return v.data_contracts(t.data_contract, t.dim_dataset, t.dim_party)


RISK_VIEW = f"""SELECT risk_id, title, category, severity, likelihood, impact, status,
  {_party("a.owner_party_id", "party_name")} AS risk_owner, {{email}} AS owner_email FROM risk_item a"""
RISK_EMAIL = _party("a.owner_party_id", "email")


@query("vw_risk_dashboard", "risk_item dim_party", RISK_VIEW.format(email=RISK_EMAIL))
def _(t):
    return v.risk_dashboard(t.risk_item, t.dim_party)


# --- policies: rows per role ----------------------------------------------------------------

_ADMIN = "TRUE"
_OPEN = "classification IN ('Public', 'Internal')"
ROLES = {
    "governance_admin": ("GOVERNANCE_ADMIN", _ADMIN),
    "retail": (
        "RETAIL_DATA_ANALYST",
        f"{_OPEN} OR domain_label ILIKE 'retail%' OR domain_label ILIKE 'deposit%'",
    ),
    "lending": ("LENDING_DATA_ANALYST", f"{_OPEN} OR domain_label ILIKE 'lending%'"),
    "cards": ("CARDS_DATA_ANALYST", f"{_OPEN} OR domain_label ILIKE 'cards%'"),
    "treasury": ("TREASURY_DATA_ANALYST", f"{_OPEN} OR domain_label ILIKE 'treasury%'"),
    "privacy_officer": ("PRIVACY_OFFICER", f"{_OPEN} OR classification = 'PII'"),
    "pci_analyst": ("PCI_ANALYST", f"{_OPEN} OR classification = 'PCI'"),
    "risk_manager": ("RISK_MANAGER", _OPEN),
}
# Whatever stands behind the first @, up to the next.
_EMAIL_SQL = "'***' || regexp_extract({c}, '^[^@]*@([^@]*)', 1)"
# The fixed text, as long as there is a reference at all.
_EVIDENCE_SQL = "left('evidence://masked' || evidence_ref, 17)"
_LABEL = _of("dim_domain", "domain_id", "{c}", "domain_name")


def _register_row_access(name: str, role: str, predicate: str) -> None:
    @query(
        f"row_access_{name}",
        "dim_dataset dim_domain",
        f"""SELECT * FROM (SELECT dataset_id, classification, {_LABEL.format(c="s.domain_id")} AS domain_label
FROM dim_dataset s) WHERE {predicate}""",
    )
    def _(t):
        shown = v.with_domain_label(
            t.dim_dataset.select("dataset_id", "classification", "domain_id"),
            t.dim_domain,
            key="domain_id",
        ).drop("domain_id")
        return v.govern(shown, role, "domain_label", "classification")

    evidence = "evidence_ref" if role in p.EVIDENCE_EXEMPT_ROLES else _EVIDENCE_SQL
    email = "owner_email" if role in p.EMAIL_EXEMPT_ROLES else _EMAIL_SQL.format(c="owner_email")

    @query(
        f"governed_dq_results_{name}",
        ENRICHED_TABLES + " dim_domain",
        f"""WITH e AS ({ENRICHED}), l AS (SELECT *, {_LABEL.format(c="e.domain_name")} AS domain_label FROM e)
SELECT * REPLACE ({evidence} AS evidence_ref, {email} AS owner_email) FROM l WHERE {predicate}""",
    )
    def _(t):
        return v.govern(
            v.with_domain_label(enriched(t), t.dim_domain),
            role,
            "domain_label",
            "classification",
            v.DQ_RESULT_MASKS,
        )


for _name, (_role, _predicate) in ROLES.items():
    _register_row_access(_name, _role, _predicate)


@query(
    "governed_glossary",
    "dim_term dim_domain dim_party",
    f"""SELECT * FROM (SELECT *, {_LABEL.format(c="g.domain_name")} AS domain_label
  FROM ({GLOSSARY.format(email=_EMAIL_SQL.format(c=_party("g.steward_party_id", "email")))}) g)
WHERE regexp_matches(domain_label, '^(retail|deposit)', 'i')""",
)
def _(t):
    view = v.with_domain_label(
        v.business_glossary(t.dim_term, t.dim_domain, t.dim_party), t.dim_domain
    )
    return v.govern(view, "RETAIL_DATA_ANALYST", "domain_label", None, v.GLOSSARY_MASKS)


@query(
    "governed_contracts",
    "data_contract dim_dataset dim_party",
    f"""SELECT * FROM ({CONTRACTS.format(
        producer=_EMAIL_SQL.format(c=_party("a.producer_party_id", "email")),
        consumer=_EMAIL_SQL.format(c=_party("a.consumer_party_id", "email")))})
WHERE classification IN ('Public', 'Internal', 'PII')""",
)
def _(t):
    view = v.data_contracts(t.data_contract, t.dim_dataset, t.dim_party)
    return v.govern(view, "PRIVACY_OFFICER", "domain_name", "classification", v.CONTRACT_MASKS)


@query(
    "governed_risks",
    "risk_item dim_party",
    RISK_VIEW.format(email=_EMAIL_SQL.format(c=RISK_EMAIL)),
)
def _(t):
    # No domain and no class: only full-access roles see rows, and this one is not mail-exempt.
    view = v.risk_dashboard(t.risk_item, t.dim_party)
    return v.govern(view, "GOVERNANCE_ANALYST", None, None, v.OWNER_EMAIL_MASK)


@query(
    "governed_today_health",
    "dim_dataset dq_result dq_run dim_domain",
    f"""WITH h AS ({TODAY.format(latest=LATEST.format(keys="r.rule_id"))})
SELECT * FROM (SELECT *, {_LABEL.format(c="h.domain_name")} AS domain_label FROM h)
WHERE classification IN ('Public', 'Internal') OR regexp_matches(domain_label, '^cards', 'i')""",
)
def _(t):
    view = v.with_domain_label(
        v.today_health(t.dim_dataset, t.dq_result, t.dq_run), t.dim_domain
    )
    return v.govern(view, "CARDS_DATA_ANALYST", "domain_label", "classification")


@query(
    "governed_control_results",
    "control_test control_registry dim_party dim_dataset dim_domain",
    f"""WITH c AS ({CONTROLS}), d AS (SELECT *, CASE scope_type WHEN 'DATASET' THEN {_dataset("c.scope_id", "classification")} END AS classification,
  CASE scope_type WHEN 'DATASET' THEN {_dataset("c.scope_id", "domain_id")} END AS domain_name FROM c)
SELECT * REPLACE ({_EMAIL_SQL.format(c="owner_email")} AS owner_email)
FROM (SELECT *, {_LABEL.format(c="d.domain_name")} AS domain_label FROM d)
WHERE classification IN ('Public', 'Internal') OR regexp_matches(domain_label, '^lending', 'i')""",
)
def _(t):
    rows = v.control_results_enriched(t.control_test, t.control_registry, t.dim_party)
    view = v.with_domain_label(v.with_scope(rows, t.dim_dataset), t.dim_domain)
    return v.govern(
        view, "LENDING_DATA_ANALYST", "domain_label", "classification", v.OWNER_EMAIL_MASK
    )


@query(
    "governed_owners",
    OWNER_TABLES,
    "SELECT * FROM ("
    + OWNERS.format(email=_EMAIL_SQL.format(c="p.email"))
    + ") WHERE classification IN ('Public', 'Internal', 'PCI')",
)
def _(t):
    role = "PCI_ANALYST"
    view = v.dataset_owners(
        t.dim_dataset, t.map_dataset_owner, t.dim_party, lambda c: p.mask_email(c, role)
    )
    return v.govern(view, role, "domain_name", "classification")


# --- masks ---------------------------------------------------------------------------------

_SAMPLE_SQL = (
    "['***MASKED***', substr({c}, 1, 3) || '*****' || substr({c}, -2)][1 + (length({c}) > 10)::INT]"
)


@query(
    "mask_sensitive",
    "dim_party",
    f"""SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, {_SAMPLE_SQL.format(c="text")} AS masked FROM documents
UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), {_SAMPLE_SQL.format(c="url")} FROM pages
UNION ALL SELECT 'turn', CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR), {_SAMPLE_SQL.format(c="text")} FROM conversations
UNION ALL SELECT 'party', party_id, {_SAMPLE_SQL.format(c="email")} FROM dim_party""",
)
def _(t):
    def masked(df, kind, key, column):
        return df.select(
            F.lit(kind).alias("kind"), key.cast("string").alias("id"),
            p.mask_sensitive(column, "ANALYST").alias("masked"),
        )

    turn = F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    return (
        masked(t.documents, "document", F.col("doc_id"), "text")
        .unionByName(masked(t.pages, "page", F.col("page_id"), "url"))
        .unionByName(masked(t.conversations, "turn", turn, "text"))
        .unionByName(masked(t.dim_party, "party", F.col("party_id"), "email"))
    )


@query(
    "mask_email",
    "dim_party",
    f"""SELECT 'document' AS kind, CAST(doc_id AS VARCHAR) AS id, {_EMAIL_SQL.format(c="text")} AS masked FROM documents
UNION ALL SELECT 'party', party_id, {_EMAIL_SQL.format(c="email")} FROM dim_party""",
)
def _(t):
    def masked(df, kind, key, column):
        return df.select(
            F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"),
            p.mask_email(column, "ANALYST").alias("masked"),
        )

    return masked(t.documents, "document", "doc_id", "text").unionByName(
        masked(t.dim_party, "party", "party_id", "email")
    )


@query(
    "mask_evidence",
    "dq_result",
    f"SELECT run_id, rule_id, {_EVIDENCE_SQL} AS evidence_ref FROM dq_result",
)
def _(t):
    return t.dq_result.select(
        "run_id", "rule_id", p.mask_evidence("evidence_ref", "DATA_STEWARD").alias("evidence_ref")
    )
