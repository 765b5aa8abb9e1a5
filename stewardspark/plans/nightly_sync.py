"""Nightly metadata sync: registration, lineage nodes, row counts and the sync's own log."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions.clock import AsOf, day_start, moment, to_datetime
from ..operators import catalog, lineage, quality
from ..operators.upsert import insert_if_absent, upsert
from ..session import cut_lineage

# Identifiers and texts that the sync leaves in the log tables.
SYNC_CONTROL = "DBT_METADATA_SYNC"
BATCH_PREFIX = "dbt_sync_"
SYNC_PROCESS = {
    "process_id": "DBT_DAILY_RUN",
    "name": "DBT Daily Transformation Run",
    "orchestrator": "DBT",
    "owner_party_id": "DBT_SYSTEM",
}
RESULT_UPDATES = ("outcome", "metrics_summary", "updated_at")

Store = Callable[[str, DataFrame], DataFrame]


def batch_id(as_of: AsOf) -> str:
    return BATCH_PREFIX + to_datetime(as_of).strftime("%Y%m%d_%H%M%S")


def record_row_counts(
    results: DataFrame, tables: Mapping[str, DataFrame], as_of: AsOf, min_rows: int = 0
) -> DataFrame:
    """Result table with today's row count of each table; a second pass overwrites it.

    The counts are stored first: the merge reads its source several times, the tables once.
    """
    counts = cut_lineage(quality.row_count_check(tables, min_rows, as_of))
    updates = [c for c in RESULT_UPDATES if c in results.columns]
    return upsert(results, counts, ["run_id", "rule_id"], updates)


def record_row_counts_once(
    results: DataFrame, tables: Mapping[str, DataFrame], as_of: AsOf, min_rows: int = 0
) -> DataFrame:
    """Result table with a row count per table, unless the day already has one."""
    counts = cut_lineage(quality.row_count_check(tables, min_rows, as_of))
    shaped = counts.select(*[c for c in counts.columns if c in results.columns])
    present = results.select(*shaped.columns)
    return insert_if_absent(present, shaped, ["dataset_id", "rule_id"], "created_at")


def sync(
    registry: Mapping[str, DataFrame],
    table_meta: DataFrame,
    column_meta: DataFrame,
    tables: Mapping[str, DataFrame],
    as_of: AsOf,
    store: Store | None = None,
) -> dict[str, DataFrame]:
    """All registry tables after one sync, and its one-row ``summary``.

    ``registry`` holds dim_dataset, map_dataset_attribute, lineage_node, dq_result, process,
    process_run and control_test; ``tables`` the data tables by dataset id. ``store`` keeps
    each new snapshot before the next step reads it (a written table in production); the
    default writes it to the shared checkpoint folder.
    """
    store = store or (lambda _name, df: cut_lineage(df))
    batch = batch_id(as_of)
    out = dict(registry)

    def keep(name: str, df: DataFrame) -> None:
        out[name] = store(name, df)

    keep("dim_dataset", catalog.register_datasets(table_meta, registry["dim_dataset"], as_of))
    keep(
        "map_dataset_attribute",
        catalog.register_attributes(
            column_meta, out["dim_dataset"], registry["map_dataset_attribute"], as_of
        ),
    )
    # The sync has touched every tracked dataset, so the nodes are merged with as many rows.
    keep(
        "lineage_node",
        lineage.lineage_nodes(out["dim_dataset"], registry["lineage_node"], as_of, large_source=True),
    )
    if tables:
        keep("dq_result", record_row_counts(registry["dq_result"], tables, as_of))
    keep("process", _register_process(registry["process"], as_of))
    keep(
        "process_run",
        lineage.one_shot_run(registry["process_run"], as_of, batch, SYNC_PROCESS["process_id"]),
    )
    summary = store(
        "summary",
        catalog.sync_summary(
            out["dim_dataset"],
            out["map_dataset_attribute"],
            out["lineage_node"],
            out["dq_result"],
            as_of,
        ).select(F.lit(batch).alias("batch_id"), moment(as_of).alias("completed_at"), "*"),
    )
    keep("control_test", _log(registry["control_test"], summary, batch, as_of))
    return out | {"summary": summary}


def _register_process(process: DataFrame, as_of: AsOf) -> DataFrame:
    spark = process.sparkSession
    row = spark.createDataFrame([Row(**SYNC_PROCESS)]).select(
        "*",
        F.lit("Daily transformation process of the analytics models").alias("description"),
        day_start(as_of).alias("created_at"),
        moment(as_of).alias("updated_at"),
    )
    updates = [c for c in ("description", "updated_at") if c in process.columns]
    return upsert(process, row, ["process_id"], updates)


def _log(tests: DataFrame, summary: DataFrame, batch: str, as_of: AsOf) -> DataFrame:
    """Audit trail with the start and the completion of the sync."""

    def row(step: str, details) -> DataFrame:
        return summary.select(
            F.lit(f"{batch}_{step}").alias("test_id"),
            F.lit(SYNC_CONTROL).alias("control_id"),
            F.lit(batch).alias("run_id"),
            moment(as_of).alias("executed_at"),
            F.lit("PASS").alias("outcome"),
            details.alias("details"),
        )

    start = row("start", F.lit("Starting metadata sync"))
    done = row(
        "complete", F.concat(F.lit("Datasets processed: "), F.col("datasets_synced").cast("string"))
    )
    return tests.unionByName(start, allowMissingColumns=True).unionByName(
        done, allowMissingColumns=True
    )
