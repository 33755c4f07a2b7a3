"""Session settings and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    app: str = "shelfscope",
    master: str | None = None,
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """A session with the settings the jobs are written for.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster they
    come from spark-submit, and AQE coalesces the shuffle partitions it is given.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # checkpoints go when nothing refers to them any more
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no call-site bookkeeping for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # crawled pages are wide rows: keep Arrow batches to Python short
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    )
    if master:
        builder = (
            builder.master(master)
            .config("spark.ui.enabled", "false")
            .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_local_folder(spark: SparkSession) -> None:
    """Name a temporary folder for checkpoints where a local session has none.

    For tests, benches and other local runs only: there, driver and executors share one
    disk. On a cluster the folder is named in ``spark.checkpoint.dir``.
    """
    if spark.sparkContext.master.startswith("local[") and not _named_folder(spark):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def _named_folder(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints and written intermediate tables, which all executors
    reach: the one named in ``spark.checkpoint.dir``."""
    named = _named_folder(spark)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors reach")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and cut from its lineage; for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str = "stored", codec: str = "snappy") -> DataFrame:
    """``df`` as Parquet in the shared folder, read back; for wide rows. ``zstd`` as ``codec``
    writes fewer bytes."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.parquet(path)


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what is directly in a folder."""
    fs, target = _file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(target)]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of a table."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for files of this session only: they are
    deleted when it ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, target = _file_system(spark, path)
    fs.deleteOnExit(target)
    return path
