"""Classification and registration of datasets and columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import catalog as c
from ..operators import quality
from ..operators.common import counts_side_by_side, union_all
from ..plans import nightly_sync
from ..session import cut_lineage
from ..sources.driver_tables import DRIVER_SCHEMAS
from ..sources.projections import PROJECTIONS
from .registry import AS_OF, query


def _first(labels: list[str], *tests: str) -> str:
    """The label at the place of the first test that holds; the last label otherwise."""
    return f"{labels}[list_position([{', '.join(tests)}, TRUE], TRUE)]"


def _has(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}', 'is')"


LAYER = _first(
    ["BRONZE", "SILVER", "GOLD", "SILVER"],
    _has("{c}", "raw|bronze"), _has("{c}", "staging|silver"), _has("{c}", "mart|gold"),
)
SEMANTIC = _first(
    ["EMAIL", "PHONE", "SSN", "IDENTIFIER", "TEMPORAL", "NUMERIC", "GENERAL"],
    _has("{n}", "email"), _has("{n}", "phone"), _has("{n}", "ssn|social"), _has("{n}", "^id.|.id$"),
    _has("{t}", "timestamp|date"), _has("{t}", "number|decimal"),
)
CRITICAL = "regexp_full_match({n}, '((customer|account|transaction)_id|balance|amount)', 'i')"
NOW = f"TIMESTAMP '{AS_OF} 00:00:00'"


@query(
    "dv_layer",
    "dim_dataset",
    f"SELECT dataset_id, {LAYER.format(c='schema_name')} AS dv_layer FROM dim_dataset",
)
def _(t):
    return t.dim_dataset.select("dataset_id", labels.dv_layer("schema_name").alias("dv_layer"))


@query(
    "dv_layer_short",
    "dim_dataset",
    "SELECT dataset_id, "
    + _first(
        ["BRONZE", "SILVER", "GOLD", "SILVER"],
        _has("schema_name", "raw"), _has("schema_name", "staging"), _has("schema_name", "mart"),
    )
    + " AS dv_layer FROM dim_dataset",
)
def _(t):
    return t.dim_dataset.select(
        "dataset_id", labels.dv_layer("schema_name", short=True).alias("dv_layer")
    )


@query(
    "semantic_type",
    "map_dataset_attribute",
    f"""SELECT map_id, {SEMANTIC.format(n='column_name', t='data_type')} AS semantic_type
FROM map_dataset_attribute""",
)
def _(t):
    dtype = labels.warehouse_type("data_type")
    return t.map_dataset_attribute.select(
        "map_id", labels.semantic_type("column_name", dtype).alias("semantic_type")
    )


@query(
    "quality_critical",
    "map_dataset_attribute",
    f"""SELECT map_id, {CRITICAL.format(n='column_name')} AS by_default,
  list_contains(CASE WHEN term_id IS NULL THEN ['NOTES'] ELSE ['EMAIL_ADDR', 'PAID'] END, upper(column_name)) AS by_list
FROM map_dataset_attribute""",
)
def _(t):
    own = F.when(F.col("term_id").isNull(), F.array(F.lit("notes"))).otherwise(
        F.array(F.lit("Email_Addr"), F.lit("PAID"))
    )
    return t.map_dataset_attribute.select(
        "map_id",
        labels.quality_critical("column_name").alias("by_default"),
        labels.quality_critical("column_name", own).alias("by_list"),
    )


@query(
    "stable_keys",
    "map_dataset_attribute dim_dataset",
    """SELECT 'dbt_' || d.database_name || '_' || d.schema_name || '_' || d.object_name AS dataset_key,
  'attr_' || a.dataset_id || '_' || a.column_name AS attribute_key,
  'edge_' || d.system_id || '_to_' || d.dataset_id AS edge_key,
  d.dataset_id || '_rowcount_' || strftime(d.updated_at, '%Y-%m-%d') AS rowcount_key
FROM map_dataset_attribute a JOIN dim_dataset d ON d.dataset_id = a.dataset_id""",
)
def _(t):
    ds = t.dim_dataset.select(
        "dataset_id", "system_id", "database_name", "schema_name", "object_name",
        F.col("updated_at").alias("day"),
    )
    # Not by broadcast: Spark judges the columns' size by the datasets that they are made from.
    columns = t.map_dataset_attribute.select("dataset_id", "column_name")
    return columns.join(ds.hint("merge"), "dataset_id").select(
        labels.dataset_key("database_name", "schema_name", "object_name").alias("dataset_key"),
        labels.attribute_key("dataset_id", "column_name").alias("attribute_key"),
        labels.edge_key("system_id", "dataset_id").alias("edge_key"),
        labels.rowcount_run_key("dataset_id", F.col("day")).alias("rowcount_key"),
    )


@query(
    "normalize_labels",
    "dim_dataset",
    """SELECT dataset_id, coalesce(upper(nullif(classification, '')), 'INTERNAL') AS classification,
  CASE WHEN table_type = 'BASE TABLE' THEN 'TABLE' ELSE table_type END AS object_type,
  coalesce(nullif(domain_id, ''), 'ANALYTICS') AS domain_id
FROM (SELECT *, CASE object_type WHEN 'TABLE' THEN 'BASE TABLE' ELSE object_type END AS table_type FROM dim_dataset)""",
)
def _(t):
    return t.dim_dataset.select(
        "dataset_id",
        labels.normalize_classification("classification").alias("classification"),
        labels.object_type(_table_type()).alias("object_type"),
        labels.default_domain("domain_id").alias("domain_id"),
    )


def _table_type():
    return F.when(F.col("object_type") == "TABLE", "BASE TABLE").otherwise(F.col("object_type"))


def table_meta(t):
    return t.dim_dataset.select(
        F.col("database_name").alias("table_catalog"),
        F.col("schema_name").alias("table_schema"),
        F.col("object_name").alias("table_name"),
        _table_type().alias("table_type"),
        F.when(F.col("is_cde"), F.col("description")).alias("comment"),
    )


TRACKED = "regexp_matches(schema_name, 'DBT|STAGING|MART|RAW|SILVER|GOLD')"


@query(
    "tracked_objects",
    "dim_dataset",
    f"""SELECT database_name AS table_catalog, schema_name AS table_schema, object_name AS table_name
FROM dim_dataset WHERE {TRACKED}""",
)
def _(t):
    return c.tracked_objects(table_meta(t)).select("table_catalog", "table_schema", "table_name")


# Half of the registry is already known under its stable key.
KNOWN = """SELECT CASE WHEN CAST(substr(dataset_id, 4) AS BIGINT) % 2 = 0
    THEN 'dbt_' || database_name || '_' || schema_name || '_' || object_name ELSE dataset_id END AS key,
  * FROM dim_dataset"""


def known_registry(t):
    known = F.expr("CAST(substr(dataset_id, 4) AS BIGINT) % 2 = 0")
    key = labels.dataset_key("database_name", "schema_name", "object_name")
    return t.dim_dataset.withColumn(
        "dataset_id", F.when(known, key).otherwise(F.col("dataset_id"))
    )


_DATASET_COLUMNS = [col for col in PROJECTIONS["dim_dataset"].columns if col != "dataset_id"]
_UPDATED = {
    "catalog_name": "s.catalog_name", "object_type": "s.object_type", "dv_layer": "s.dv_layer",
    "description": "s.description", "updated_at": NOW,
}
_MERGED = ", ".join(
    f"CASE WHEN s.key IS NOT NULL THEN {_UPDATED[col]} ELSE k.{col} END AS {col}"
    if col in _UPDATED else f"k.{col} AS {col}"
    for col in _DATASET_COLUMNS
)
_INSERTED = {
    "system_id": "'DBT_PROD'", "domain_id": "'ANALYTICS'", "platform": "'SPARK'",
    "classification": "'INTERNAL'", "is_cde": "FALSE", "retention_policy_id": "NULL",
    "certification": "'DRAFT'", "created_at": NOW, "updated_at": NOW,
}
_NEW = ", ".join(f"{_INSERTED.get(col, 's.' + col)} AS {col}" for col in _DATASET_COLUMNS)


def _registered(updated, inserted, layer: str, where: str = "TRUE") -> str:
    """Registry after a registration: known rows with their updated columns, then the new ones."""
    given = {
        "catalog_name": "catalog_name", "object_type": "object_type", "dv_layer": layer,
        "description": "CASE WHEN is_cde THEN description ELSE 'dbt model: ' || object_name END",
        "classification": "coalesce(upper(nullif(classification, '')), 'INTERNAL')",
        "is_cde": "coalesce(is_cde, FALSE)", "domain_id": "coalesce(nullif(domain_id, ''), 'ANALYTICS')",
        "database_name": "database_name", "schema_name": "schema_name", "object_name": "object_name",
        "updated_at": NOW,
    }
    source = ", ".join(f"{v} AS {c}" for c, v in given.items())
    old = ", ".join(
        f"if(s.key IS NULL, k.{c}, s.{c}) AS {c}" if c in updated else f"k.{c} AS {c}" for c in _DATASET_COLUMNS
    )
    new = ", ".join(f"{inserted.get(c, 's.' + c)} AS {c}" for c in _DATASET_COLUMNS)
    return f"""WITH k AS ({KNOWN}),
s AS (SELECT 'dbt_' || database_name || '_' || schema_name || '_' || object_name AS key, {source} FROM dim_dataset WHERE {where})
SELECT k.key AS dataset_id, {old} FROM k LEFT JOIN s USING (key)
UNION ALL BY NAME SELECT s.key AS dataset_id, {new} FROM s ANTI JOIN k USING (key)"""


_DATASET_COLUMNS = [col for col in PROJECTIONS["dim_dataset"].columns if col != "dataset_id"]
_DEFAULTS = {
    "system_id": "'DBT_PROD'", "domain_id": "'ANALYTICS'", "platform": "'SPARK'", "classification": "'INTERNAL'",
    "is_cde": "FALSE", "retention_policy_id": "NULL", "certification": "'DRAFT'", "created_at": NOW,
}
_OWN = {c: v for c, v in _DEFAULTS.items() if c not in ("domain_id", "classification", "is_cde")}
_SHORT_LAYER = _first(
    ["BRONZE", "SILVER", "GOLD", "SILVER"],
    _has("schema_name", "raw"), _has("schema_name", "staging"), _has("schema_name", "mart"),
)


@query(
    "register_datasets",
    "dim_dataset",
    _registered(c.SYNC_UPDATES, _DEFAULTS, LAYER.format(c="schema_name"), TRACKED),
)
def _(t):
    return c.register_datasets(table_meta(t), known_registry(t), AS_OF)


def _model_meta(t):
    """Metadata as a model's own settings give it: domain, class and personal data."""
    return t.dim_dataset.select(
        F.col("database_name").alias("table_catalog"),
        F.col("schema_name").alias("table_schema"),
        F.col("object_name").alias("table_name"),
        _table_type().alias("table_type"),
        F.when(F.col("is_cde"), F.col("description")).alias("comment"),
        F.col("domain_id").alias("domain"),
        "classification",
        F.col("is_cde").alias("contains_pii"),
    )


@query(
    "register_by_hook",
    "dim_dataset",
    _registered(c.HOOK_UPDATES, _OWN, LAYER.format(c="schema_name")),
)
def _(t):
    return c.register_datasets(
        _model_meta(t), known_registry(t), AS_OF, c.HOOK_UPDATES, tracked_only=False
    )


@query("register_by_etl", "dim_dataset", _registered(c.ETL_UPDATES, _OWN, _SHORT_LAYER))
def _(t):
    return c.register_datasets(
        _model_meta(t), known_registry(t), AS_OF, c.ETL_UPDATES, tracked_only=False, short_layer=True
    )


# --- metadata scans feeding the registries ------------------------------------------------

_SCANNED = {name: [f.split(" ", 1) for f in ddl.split(", ")] for name, ddl in DRIVER_SCHEMAS.items()}
_SCAN_ROWS = ", ".join(f"('{n}')" for n in _SCANNED)
_SCAN_COLUMNS = ", ".join(f"('{n}', '{c}', '{k}')" for n, cols in _SCANNED.items() for c, k in cols)


def column_meta(t):
    place = t.dim_dataset.select("dataset_id", "database_name", "schema_name", "object_name")
    # Not by broadcast: Spark judges the columns' size by the datasets that they are made from.
    return t.map_dataset_attribute.join(place.hint("merge"), "dataset_id").select(
        F.col("database_name").alias("table_catalog"),
        F.col("schema_name").alias("table_schema"),
        F.col("object_name").alias("table_name"),
        "column_name",
        "data_type",
        F.lit(None).cast("string").alias("comment"),
    )


def _scanned(t):
    return {("LAKE", "RAW_FEED", name): t[name] for name in _SCANNED}


@query(
    "register_scanned_tables",
    "dim_dataset",
    f"""SELECT * FROM dim_dataset UNION ALL BY NAME
SELECT 'dbt_LAKE_RAW_FEED_' || n AS dataset_id, 'LAKE.RAW_FEED.' || n AS catalog_name, 'DBT_PROD' AS system_id, 'ANALYTICS' AS domain_id,
  'SPARK' AS platform, 'LAKE' AS database_name, 'RAW_FEED' AS schema_name, n AS object_name, 'TABLE' AS object_type, 'BRONZE' AS dv_layer,
  'INTERNAL' AS classification, FALSE AS is_cde, 'dbt model: ' || n AS description, 'DRAFT' AS certification, {NOW} AS created_at, {NOW} AS updated_at
FROM (VALUES {_SCAN_ROWS}) v(n)""",
)
def _(t):
    meta = c.describe_tables(t.spark, _scanned(t))
    return c.register_datasets(meta, t.dim_dataset, AS_OF)


@query(
    "register_scanned_columns",
    "dim_dataset map_dataset_attribute",
    f"""SELECT map_id, dataset_id, column_name, term_id, cde_id, quality_critical, updated_at FROM map_dataset_attribute
UNION ALL BY NAME SELECT 'attr_dbt_LAKE_RAW_FEED_' || n || '_' || x AS map_id, 'dbt_LAKE_RAW_FEED_' || n AS dataset_id, x AS column_name,
  {CRITICAL.format(n="x")} AS quality_critical, {NOW} AS updated_at FROM (VALUES {_SCAN_COLUMNS}) v(n, x, k)""",
)
def _(t):
    tables = _scanned(t)
    registry = c.register_datasets(c.describe_tables(t.spark, tables), t.dim_dataset, AS_OF)
    return c.register_attributes(
        c.describe_columns(t.spark, tables), registry, t.map_dataset_attribute.drop("data_type"), AS_OF
    )


@query(
    "register_attributes",
    "dim_dataset map_dataset_attribute",
    f"""WITH cols AS (SELECT d.database_name, d.schema_name, d.object_name,
    CASE WHEN a.column_name = 'NOTES' THEN 'REMARKS' ELSE a.column_name END AS column_name, a.data_type
  FROM map_dataset_attribute a JOIN dim_dataset d ON d.dataset_id = a.dataset_id),
s AS (SELECT 'attr_' || d.dataset_id || '_' || c.column_name AS map_id, d.dataset_id, c.column_name,
    {SEMANTIC.format(n='c.column_name', t='c.data_type')} AS semantic_type,
    {CRITICAL.format(n='c.column_name')} AS quality_critical
  FROM cols c JOIN dim_dataset d ON d.database_name = c.database_name
    AND d.schema_name = c.schema_name AND d.object_name = c.object_name)
SELECT a.map_id, a.dataset_id, a.column_name, a.term_id, a.cde_id,
  s.semantic_type, coalesce(s.quality_critical, a.quality_critical) AS quality_critical,
  CASE WHEN s.map_id IS NOT NULL THEN {NOW} ELSE a.updated_at END AS updated_at
FROM map_dataset_attribute a LEFT JOIN s ON s.map_id = a.map_id
UNION ALL
SELECT map_id, dataset_id, column_name, NULL, NULL, semantic_type, quality_critical, {NOW} FROM s
WHERE NOT EXISTS (SELECT 1 FROM map_dataset_attribute a WHERE a.map_id = s.map_id)""",
)
def _(t):
    renamed = F.when(F.col("column_name") == "NOTES", "REMARKS").otherwise(F.col("column_name"))
    cols = column_meta(t).withColumn("column_name", renamed)
    attrs = t.map_dataset_attribute.drop("data_type").withColumn(
        "semantic_type", F.lit(None).cast("string")
    )
    return c.register_attributes(cols, t.dim_dataset, attrs, AS_OF)


@query(
    "sync_summary",
    "dim_dataset map_dataset_attribute lineage_node dq_result",
    """SELECT (SELECT count(*) FROM dim_dataset WHERE CAST(updated_at AS DATE) = DATE '2024-01-20') AS datasets_synced,
  (SELECT count(*) FROM map_dataset_attribute WHERE CAST(updated_at AS DATE) = DATE '2024-01-20') AS attributes_synced,
  (SELECT count(*) FROM lineage_node WHERE CAST(updated_at AS DATE) = DATE '2024-01-20') AS nodes_created,
  (SELECT count(*) FROM dq_result WHERE CAST(created_at AS DATE) = DATE '2024-01-20') AS quality_checks_run""",
)
def _(t):
    return c.sync_summary(
        t.dim_dataset, t.map_dataset_attribute, t.lineage_node, t.dq_result, "2024-01-20"
    )


# --- the nightly sync ----------------------------------------------------------------------

_COUNTED = ("lineitem", "orders", "events", "documents")


@query(
    "nightly_row_counts",
    "",
    "\nUNION ALL ".join(
        f"""SELECT '{n}_rowcount_2024-02-05' AS run_id, 'row_count_check' AS rule_id, '{n}' AS dataset_id,
  if(count(*) >= 5000, 'PASS', 'FAIL') AS outcome, CAST(count(*) AS VARCHAR) AS row_count, {NOW} AS updated_at FROM {n}"""
        for n in _COUNTED
    )
    + "\nUNION ALL SELECT 'part_rowcount_2024-02-04', 'row_count_check', 'part', 'PASS', CAST(count(*) AS VARCHAR), TIMESTAMP '2024-02-04' FROM part",
)
def _(t):
    # Two of today's counts are there already, with another limit; one is yesterday's.
    known = quality.row_count_check({n: t[n] for n in _COUNTED[:2]}, 10**12, AS_OF).unionByName(
        quality.row_count_check({"part": t.part}, 0, "2024-02-04")
    )
    counted = nightly_sync.record_row_counts(cut_lineage(known), {n: t[n] for n in _COUNTED}, AS_OF, 5000)
    return counted.select(
        "run_id", "rule_id", "dataset_id", "outcome",
        F.get_json_object("metrics_summary", "$.row_count").alias("row_count"), "updated_at",
    )


@query(
    "nightly_sync",
    "dim_dataset map_dataset_attribute lineage_node dq_result process process_run control_test",
    f"""WITH today AS (SELECT dataset_id FROM dim_dataset WHERE updated_at::DATE = DATE '{AS_OF}'),
new AS (SELECT count(*) AS n FROM dim_dataset WHERE {TRACKED}),
old_nodes AS (SELECT count(*) AS n FROM lineage_node WHERE updated_at::DATE = DATE '{AS_OF}' AND node_id NOT IN (SELECT dataset_id FROM today)),
s AS (SELECT (SELECT count(*) FROM today) + (SELECT n FROM new) AS datasets,
  (SELECT count(*) FROM map_dataset_attribute) + 10 * (SELECT n FROM new) AS attributes)
SELECT 'dbt_sync_20240205_000000' AS batch_id, datasets AS datasets_synced, attributes AS attributes_synced,
  datasets + (SELECT n FROM old_nodes) AS nodes_created,
  (SELECT count(*) FROM dq_result WHERE created_at::DATE = DATE '{AS_OF}') + {len(_COUNTED)} AS quality_checks_run,
  (SELECT count(*) FROM process) + 1 AS processes, (SELECT count(*) FROM process_run) + 1 AS runs,
  (SELECT count(*) FROM control_test) + 2 AS log_rows, 'Datasets processed: ' || datasets AS last_entry FROM s""",
)
def _(t):
    names = ("dim_dataset", "map_dataset_attribute", "lineage_node", "dq_result", "process", "process_run", "control_test")
    registry = {n: t[n] for n in names}
    registry["map_dataset_attribute"] = t.map_dataset_attribute.drop("data_type")
    out = nightly_sync.sync(
        registry, table_meta(t), column_meta(t), {n: t[n] for n in _COUNTED}, AS_OF
    )
    last = out["control_test"].where(
        (F.col("control_id") == nightly_sync.SYNC_CONTROL) & F.col("test_id").endswith("_complete")
    )
    counts = {"processes": "process", "runs": "process_run", "log_rows": "control_test"}
    sizes = counts_side_by_side({k: out[n] for k, n in counts.items()})
    parts = [
        out["summary"].drop("completed_at"), sizes, last.select(F.col("details").alias("last_entry"))
    ]
    rows = union_all(parts, allow_missing=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def _profile_sql(table: str, columns: list[str]) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{x}' AS column_name, count(*) AS row_count, count(*) - count({x}) AS null_count, "
        f"count(DISTINCT {x}) AS distinct_count, CAST(min({x}) AS VARCHAR) AS min_value, "
        f"CAST(max({x}) AS VARCHAR) AS max_value FROM {table}"
        for x in columns
    )


LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


@query("profile_columns", "", _profile_sql("lineitem", LINEITEM))
def _(t):
    return c.profile_columns(t.lineitem)


@query(
    "profile_columns_with_nulls",
    "dim_party",
    _profile_sql("dim_party", ["party_id", "party_type", "email", "manager_party_id"]),
)
def _(t):
    return c.profile_columns(t.dim_party, ["party_id", "party_type", "email", "manager_party_id"])
