"""Classification of datasets and columns, and the stable registry keys."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns, labels, lists and key formats that registry rows depend on.
LAYER_PATTERNS = (
    (("%RAW%", "%BRONZE%"), "BRONZE"),
    (("%STAGING%", "%SILVER%"), "SILVER"),
    (("%MART%", "%GOLD%"), "GOLD"),
)
DEFAULT_LAYER = "SILVER"
NAME_PATTERNS = (
    (("%EMAIL%",), "EMAIL"),
    (("%PHONE%",), "PHONE"),
    (("%SSN%", "%SOCIAL%"), "SSN"),
    (("%_ID", "ID_%"), "IDENTIFIER"),
)
TYPE_PATTERNS = (
    (("%TIMESTAMP%", "%DATE%"), "TEMPORAL"),
    (("%NUMBER%", "%DECIMAL%"), "NUMERIC"),
)
DEFAULT_SEMANTIC_TYPE = "GENERAL"
CRITICAL_COLUMNS = ("CUSTOMER_ID", "ACCOUNT_ID", "TRANSACTION_ID", "BALANCE", "AMOUNT")
TRACKED_SCHEMA_PATTERNS = ("%DBT%", "%STAGING%", "%MART%", "%RAW%", "%SILVER%", "%GOLD%")
DEFAULT_CLASSIFICATION = "INTERNAL"
KEY_PREFIX = "dbt"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def like_any(c: Column, patterns: Iterable[str]) -> Column:
    """True when one LIKE pattern matches; ``_`` stays a one-character wildcard."""
    return reduce(lambda a, b: a | b, [c.like(p) for p in patterns])


def _first_label(rules: Iterable[tuple[Column, str]], default: str) -> Column:
    out = F.lit(default)
    for predicate, label in reversed(list(rules)):
        out = F.when(predicate, label).otherwise(out)
    return out


def dv_layer(schema_name: Column | str, short: bool = False) -> Column:
    """Data layer from the schema name; the short form tests RAW, STAGING and MART only."""
    name = F.upper(_col(schema_name))
    rules = [(like_any(name, p[:1] if short else p), label) for p, label in LAYER_PATTERNS]
    return _first_label(rules, DEFAULT_LAYER)


def warehouse_type(spark_type: Column | str) -> Column:
    """Spark type names as NUMBER or TIMESTAMP, so that ``semantic_type`` reads both."""
    t = F.lower(_col(spark_type))
    return (
        F.when(t.startswith("timestamp"), "TIMESTAMP")
        .when(t.isin("tinyint", "smallint", "int", "bigint", "float", "double"), "NUMBER")
        .otherwise(F.upper(_col(spark_type)))
    )


def semantic_type(column_name: Column | str, data_type: Column | str) -> Column:
    """Semantic type from the column name, then from its data type; first match wins."""
    name, dtype = F.upper(_col(column_name)), F.upper(_col(data_type))
    rules = [(like_any(name, p), label) for p, label in NAME_PATTERNS]
    rules += [(like_any(dtype, p), label) for p, label in TYPE_PATTERNS]
    return _first_label(rules, DEFAULT_SEMANTIC_TYPE)


def quality_critical(
    column_name: Column | str, names: Iterable[str] | Column | None = None
) -> Column:
    """Membership in a list of names, or in an array column of names, ignoring case."""
    name = F.upper(_col(column_name))
    if isinstance(names, Column):
        hit = F.array_contains(F.transform(names, F.upper), name)
    else:
        hit = name.isin([n.upper() for n in (CRITICAL_COLUMNS if names is None else names)])
    return F.coalesce(hit, F.lit(False))


def normalize_classification(label: Column | str) -> Column:
    return F.coalesce(F.upper(F.nullif(_col(label), F.lit(""))), F.lit(DEFAULT_CLASSIFICATION))


def object_type(table_type: Column | str) -> Column:
    t = _col(table_type)
    return F.when(t == "BASE TABLE", "TABLE").otherwise(t)


def default_domain(domain: Column | str, default: str = "ANALYTICS") -> Column:
    return F.coalesce(F.nullif(_col(domain), F.lit("")), F.lit(default))


def dataset_key(
    database: Column | str, schema: Column | str, table: Column | str, prefix: str = KEY_PREFIX
) -> Column:
    parts = [F.lit(prefix), _col(database), _col(schema), _col(table)]
    return _join(parts, "_")


def catalog_name(database: Column | str, schema: Column | str, table: Column | str) -> Column:
    return _join([_col(database), _col(schema), _col(table)], ".")


def attribute_key(dataset_id: Column | str, column_name: Column | str) -> Column:
    return F.concat(F.lit("attr_"), _col(dataset_id), F.lit("_"), _col(column_name))


def edge_key(src: Column | str, tgt: Column | str) -> Column:
    return F.concat(F.lit("edge_"), _col(src), F.lit("_to_"), _col(tgt))


def rowcount_run_key(dataset_id: Column | str, day: Column) -> Column:
    return F.concat(_col(dataset_id), F.lit("_rowcount_"), F.date_format(day, "yyyy-MM-dd"))


def _join(parts: list[Column], sep: str) -> Column:
    """Concatenation that is NULL when any part is NULL."""
    out: list[Column] = []
    for i, p in enumerate(parts):
        out += [F.lit(sep), p] if i else [p]
    return F.concat(*out)
