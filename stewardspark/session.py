"""Session helpers: the shared checkpoint folder and a local session for tests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, on storage that all executors see.

    It has to be named on a cluster. A local master, where all tasks see the same disk, may
    leave it out and gets a folder of its own once per session.
    """
    folder = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def _file_system(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folder_names(spark: SparkSession, folder: str) -> list[str]:
    """Names inside a folder, none if it does not exist."""
    fs, path = _file_system(spark, folder)
    return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Removes a folder that this library has written."""
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that a lost executor costs a re-read."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder for stream sinks and stream checkpoints."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def local_session(
    cores: int | str = "*", partitions: int = 8, folder: str | None = None, **conf: str
) -> SparkSession:
    """A session for tests and benches; ``folder`` holds what it writes in between."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stewardspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    if folder:
        conf = {CHECKPOINT_KEY: folder, "spark.sql.warehouse.dir": f"{folder}/warehouse"} | conf
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
