"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import functools
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_FREED_AT = 0.0
_FREE_EVERY = 5.0


@functools.cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@functools.cache
def _run_folder(root: str, application: str) -> str:
    """The one folder that holds all scratch tables of an application; it goes when the driver ends."""
    path = f"{root.rstrip('/')}/lodestone-{application}"
    # The JVM and its file systems outlive ``spark.stop()``, the session doesn't.
    spark = SparkSession.getActiveSession()
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())

    def remove() -> None:
        with contextlib.suppress(Exception):  # the JVM is gone before this, if it was killed
            files.delete(where, True)

    atexit.register(remove)
    return path


def scratch_root(spark: SparkSession) -> str:
    """This application's folder below the one that the cluster names in ``spark.checkpoint.dir``. Where that is unset a temporary
    folder serves, but only if driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    master = spark.sparkContext.master
    if not root and not (master.startswith("local") and not master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return _run_folder(root or _own_folder(), spark.sparkContext.applicationId)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back: lineage is cut, and a lost executor costs no recomputation of what was written."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove the files of staged tables that nothing will read again, and let go of the plans that read them."""
    for df in staged:
        _delete(df.sparkSession, df._staged_path)
    if staged:
        release(staged[0].sparkSession)


def release(spark: SparkSession) -> None:
    """Now and then let go of plans that have run: Spark removes shuffle files once the driver has collected the plans they belong to."""
    global _FREED_AT
    if time.monotonic() - _FREED_AT > _FREE_EVERY:
        _FREED_AT = time.monotonic()
        gc.collect()
        spark._jvm.System.gc()


def shuffle_width(spark: SparkSession) -> int:
    """The number of shuffle partitions that the cluster's settings give for the present data size."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
