"""Tables as lists of Parquet files, so that a merge rewrites only the files it touches.

A version of a table is a manifest, itself a small Parquet table of the files that hold the
rows. A merge finds the files with matched rows by ``_metadata.file_path``, reading nothing
but the key columns of the others, writes the merged rows of those files and the inserted
rows as new files, and adds a manifest that names the untouched files as before. Earlier
versions stay readable until they expire. Data and manifests lie in one folder on shared
storage; a version exists once its manifest is complete, and the second of two writers of the
same version fails.

What comes to the driver are names of files, as many as Spark lists itself to read the table.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.clock import AsOf, moment, to_datetime
from ..operators.upsert import KeyExpr, unmatched, update_where, upsert
from ..session import drop_folder, folder_names, scratch_path

_MANIFEST = "file string, schema string"
# Where a data file lies below the table's folder.
_FILE = r"(data/[0-9a-f]+/[^/]+)$"


def _file_of_row() -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), _FILE, 1)


def versions(spark: SparkSession, root: str) -> list[int]:
    """The complete versions of a table, oldest first."""
    found = []
    for name in folder_names(spark, f"{root}/manifests"):
        if name.isdigit() and "_SUCCESS" in folder_names(spark, f"{root}/manifests/{name}"):
            found.append(int(name))
    return sorted(found)


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The files (file, schema) of a version, the newest one if none is named."""
    if version is None:
        known = versions(spark, root)
        if not known:
            raise ValueError(f"no version of a table in {root}")
        version = known[-1]
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifests/{version:08d}")


def _load(spark: SparkSession, root: str, schema: StructType, files: Sequence[str]) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in files])


def _listed(rows: DataFrame) -> tuple[StructType, list[str]]:
    found = rows.collect()
    schema = StructType.fromJson(json.loads(found[0]["schema"]))
    return schema, sorted(r["file"] for r in found if r["file"] is not None)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version."""
    return _load(spark, root, *_listed(manifest(spark, root, version)))


def _written(rows: DataFrame, root: str) -> list[str]:
    """Writes rows as files of their own and names those that hold any."""
    spark, commit = rows.sparkSession, uuid.uuid4().hex
    path = f"{root}/data/{commit}"
    rows.write.parquet(path)
    return [r[0] for r in spark.read.schema(rows.schema).parquet(path).select(_file_of_row()).distinct().collect()]


def _commit(spark: SparkSession, root: str, version: int, schema: StructType, files: Sequence[str]) -> int:
    # A manifest without files still tells the columns of an empty table.
    rows = [(f, schema.json()) for f in files] or [(None, schema.json())]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifests/{version:08d}")
    return version


def create(rows: DataFrame, root: str) -> int:
    """Version 0 of a table. Rows that are sorted or ranged by their keys make later merges touch fewer files."""
    return _commit(rows.sparkSession, root, 0, rows.schema, _written(rows, root))


def _rewrite(
    spark: SparkSession, root: str, touching: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame | None],
    keep_touched: bool = False,
) -> int:
    """The next version: rows of the touched files changed, all other files as they are.

    ``touching`` selects the rows whose files are touched, ``change`` makes the new rows out of
    all rows of those files. ``keep_touched`` leaves those files too, for new rows only.
    """
    version = versions(spark, root)[-1]
    schema, files = _listed(manifest(spark, root, version))
    whole = _load(spark, root, schema, files)
    if files:
        # Rows carry a number for the name of their file; two files of one number are both touched.
        named = touching(whole.withColumn("_file", F.xxhash64(_file_of_row())))
        found = {r[0] for r in named.select("_file").distinct().collect()}
        numbers = spark.createDataFrame([(f,) for f in files], "file string").select("file", F.xxhash64("file"))
        touched = {file for file, number in numbers.collect() if number in found}
    else:
        touched = set()
    changed = change(_load(spark, root, schema, sorted(touched)))
    new = [] if changed is None else _written(changed, root)
    kept = files if keep_touched else [f for f in files if f not in touched]
    return _commit(spark, root, version + 1, schema, [*kept, *new])


def merge(
    root: str, source: DataFrame, keys: Sequence[str], update_cols: Sequence[str] | None = None,
    insert_cols: Sequence[str] | None = None, key_expr: KeyExpr | None = None,
) -> int:
    """The merge of ``upsert`` into a versioned table; returns the new version.

    Only files that hold a row with a key of the source are rewritten; rows of other files
    have none, so their keys need not be seen again. A merge without columns to update leaves
    every file and adds one with the new rows.
    """
    spark = source.sparkSession
    stored = scratch_path(spark, "merge-source")
    source.write.parquet(stored)
    changes = spark.read.schema(source.schema).parquet(stored)
    expr = key_expr or (lambda c: c)
    wanted = changes.select(*[expr(F.col(k)).alias(f"_key_{i}") for i, k in enumerate(keys)]).distinct()

    def touching(rows: DataFrame) -> DataFrame:
        own = rows.select("_file", *[expr(F.col(k)).alias(f"_key_{i}") for i, k in enumerate(keys)])
        return own.join(wanted, [f"_key_{i}" for i in range(len(keys))], "left_semi")

    inserting = update_cols is not None and not update_cols

    def change(rows: DataFrame) -> DataFrame:
        if inserting:
            new = unmatched(changes, rows, keys, key_expr)
            return upsert(rows.limit(0), new, keys, [], insert_cols, key_expr)
        return upsert(rows, changes, keys, update_cols, insert_cols, key_expr)

    try:
        return _rewrite(spark, root, touching, change, keep_touched=inserting)
    finally:
        drop_folder(spark, stored)


def update(spark: SparkSession, root: str, predicate: Column, assignments: Mapping[str, Column]) -> int:
    """The conditional update of ``update_where``; files without a matching row stay."""
    return _rewrite(
        spark, root, lambda rows: rows.where(predicate), lambda rows: update_where(rows, predicate, assignments)
    )


def delete(spark: SparkSession, root: str, predicate: Column) -> int:
    """Rows for which the predicate is true go; files without such a row stay, empty ones are dropped."""
    return _rewrite(
        spark, root, lambda rows: rows.where(predicate), lambda rows: rows.where(~F.coalesce(predicate, F.lit(False)))
    )


def purge(spark: SparkSession, root: str, ts: str, days: int, as_of: AsOf) -> int:
    """Retention delete as in ``purge_older_than``; in a table ranged by time whole files go."""
    return delete(spark, root, F.col(ts) < moment(to_datetime(as_of) - dt.timedelta(days=days)))


def expire(spark: SparkSession, root: str, keep: int = 1) -> None:
    """Removes all versions but the newest ``keep`` and the commits that no kept version names."""
    known = versions(spark, root)
    for version in known[:-keep]:
        drop_folder(spark, f"{root}/manifests/{version:08d}")
    used = {f.split("/")[1] for v in known[-keep:] for f in _listed(manifest(spark, root, v))[1]}
    for commit in folder_names(spark, f"{root}/data"):
        if commit not in used:
            drop_folder(spark, f"{root}/data/{commit}")
