"""Registration of datasets and columns from metadata, and column profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.clock import AsOf, moment, on_day
from .common import counts_side_by_side, union_all
from .upsert import upsert

# What a newly registered dataset starts with, and what each style updates.
DATASET_DEFAULTS = {"system_id": "DBT_PROD", "domain_id": "ANALYTICS", "certification": "DRAFT"}
SYNC_UPDATES = ("catalog_name", "object_type", "dv_layer", "description", "updated_at")
HOOK_UPDATES = (
    "catalog_name", "object_type", "dv_layer", "classification", "is_cde", "description",
    "updated_at",
)
ETL_UPDATES = ("catalog_name", "updated_at")
ATTRIBUTE_UPDATES = ("semantic_type", "quality_critical", "description", "updated_at")
TRACKED_TYPES = ("BASE TABLE", "VIEW")

TABLE_META = "table_catalog string, table_schema string, table_name string, table_type string, comment string"
COLUMN_META = (
    "table_catalog string, table_schema string, table_name string, column_name string, "
    "data_type string, comment string"
)


def describe_tables(
    spark: SparkSession, tables: Mapping[tuple[str, str, str], DataFrame], table_type="BASE TABLE"
) -> DataFrame:
    """Table metadata of named DataFrames, one row each."""
    return spark.createDataFrame([(*name, table_type, None) for name in tables], TABLE_META)


def describe_columns(
    spark: SparkSession, tables: Mapping[tuple[str, str, str], DataFrame]
) -> DataFrame:
    """Column metadata of named DataFrames, one row per schema field."""
    rows = [
        (*name, f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment"))
        for name, df in tables.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(rows, COLUMN_META)


def tracked_objects(meta: DataFrame) -> DataFrame:
    """Base tables and views in tracked schemas; the schema test is case-sensitive."""
    return meta.where(
        F.col("table_type").isin(*TRACKED_TYPES)
        & (F.col("table_schema") != "INFORMATION_SCHEMA")
        & labels.like_any(F.col("table_schema"), labels.TRACKED_SCHEMA_PATTERNS)
    )


def dataset_rows(
    meta: DataFrame,
    as_of: AsOf,
    system_id: str = DATASET_DEFAULTS["system_id"],
    platform: str = "SPARK",
    short_layer: bool = False,
) -> DataFrame:
    """Registry rows for table metadata.

    Optional metadata columns ``dataset_id``, ``domain``, ``classification``,
    ``contains_pii`` override the defaults, as a model's own settings do.
    """
    name = ("table_catalog", "table_schema", "table_name")

    def given(column: str, default: Column) -> Column:
        return F.coalesce(F.col(column), default) if column in meta.columns else default

    def from_label(column: str, fn, default: str) -> Column:
        return fn(F.col(column)) if column in meta.columns else F.lit(default)

    return meta.select(
        given("dataset_id", labels.dataset_key(*name)).alias("dataset_id"),
        labels.catalog_name(*name).alias("catalog_name"),
        F.lit(system_id).alias("system_id"),
        from_label("domain", labels.default_domain, DATASET_DEFAULTS["domain_id"]).alias(
            "domain_id"
        ),
        F.lit(platform).alias("platform"),
        F.col("table_catalog").alias("database_name"),
        F.col("table_schema").alias("schema_name"),
        F.col("table_name").alias("object_name"),
        labels.object_type("table_type").alias("object_type"),
        labels.dv_layer("table_schema", short_layer).alias("dv_layer"),
        from_label(
            "classification", labels.normalize_classification, labels.DEFAULT_CLASSIFICATION
        ).alias("classification"),
        given("contains_pii", F.lit(False)).alias("is_cde"),
        F.coalesce("comment", F.concat(F.lit("dbt model: "), "table_name")).alias("description"),
        F.lit(DATASET_DEFAULTS["certification"]).alias("certification"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )


def register_datasets(
    meta: DataFrame,
    dim_dataset: DataFrame,
    as_of: AsOf,
    update_cols: Sequence[str] = SYNC_UPDATES,
    tracked_only: bool = True,
    **options,
) -> DataFrame:
    """New dataset registry after a metadata sync."""
    rows = dataset_rows(tracked_objects(meta) if tracked_only else meta, as_of, **options)
    # A sync lists every object, so the source is about as large as the registry.
    return upsert(dim_dataset, rows, ["dataset_id"], update_cols, large_source=True)


def attribute_rows(
    cols: DataFrame, dim_dataset: DataFrame, as_of: AsOf, critical: Column | None = None
) -> DataFrame:
    """Attribute rows of the columns that belong to a registered dataset.

    ``critical`` is an array column of names; without it the fixed list applies. A sync lists
    every column of every dataset, so both sides are sorted and merged whatever size Spark
    expects of them: a broadcast of either would have to pass the driver.
    """
    place = dim_dataset.select(
        "dataset_id",
        F.col("database_name").alias("table_catalog"),
        F.col("schema_name").alias("table_schema"),
        F.col("object_name").alias("table_name"),
    )
    known = cols.join(place.hint("merge"), ["table_catalog", "table_schema", "table_name"])
    dtype = labels.warehouse_type("data_type")
    return known.select(
        labels.attribute_key("dataset_id", "column_name").alias("map_id"),
        "dataset_id",
        "column_name",
        labels.semantic_type("column_name", dtype).alias("semantic_type"),
        labels.quality_critical("column_name", critical).alias("quality_critical"),
        F.coalesce("comment", F.lit("")).alias("description"),
        moment(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )


def register_attributes(
    cols: DataFrame,
    dim_dataset: DataFrame,
    attrs: DataFrame,
    as_of: AsOf,
    critical: Column | None = None,
) -> DataFrame:
    """New attribute registry after a metadata sync."""
    rows = attribute_rows(cols, dim_dataset, as_of, critical)
    updates = [c for c in ATTRIBUTE_UPDATES if c in attrs.columns]
    return upsert(attrs, rows, ["map_id"], updates, large_source=True)


def sync_summary(
    ds: DataFrame, attrs: DataFrame, nodes: DataFrame, results: DataFrame, as_of: AsOf
) -> DataFrame:
    """One row: datasets, attributes and nodes touched, and checks written, on a day."""
    return counts_side_by_side(
        {
            "datasets_synced": ds.where(on_day("updated_at", as_of)),
            "attributes_synced": attrs.where(on_day("updated_at", as_of)),
            "nodes_created": nodes.where(on_day("updated_at", as_of)),
            "quality_checks_run": results.where(on_day("created_at", as_of)),
        }
    )


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row, null and exact distinct counts and the value range of each column.

    Nulls and ranges come from one pass without a wide shuffle. Distinct values are
    counted column by column: on a columnar source each branch reads its own column, and
    repeated values collapse on the map side. One plan with several distinct counts would
    instead multiply every row by the number of columns.
    """
    columns = list(columns or df.columns)
    facts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(c).alias(f"_n{i}") for i, c in enumerate(columns)],
        *[F.min(c).cast("string").alias(f"_lo{i}") for i, c in enumerate(columns)],
        *[F.max(c).cast("string").alias(f"_hi{i}") for i, c in enumerate(columns)],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("rows").alias("row_count"),
            (F.col("rows") - F.col(f"_n{i}")).alias("null_count"),
            F.col(f"_lo{i}").alias("min_value"),
            F.col(f"_hi{i}").alias("max_value"),
        )
        for i, c in enumerate(columns)
    ]
    ranges = facts.select(F.inline(F.array(*entries)))
    distinct = union_all(
        [
            df.select(F.col(c).alias("v"))
            .where("v IS NOT NULL")
            .distinct()
            .agg(F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("distinct_count"))
            for c in columns
        ]
    )
    return ranges.join(distinct, "column_name").select(
        "column_name", "row_count", "null_count", "distinct_count", "min_value", "max_value"
    )
