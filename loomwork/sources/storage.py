"""The folder that driver and executors share, and tables staged in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own on a local master; on a cluster, which wouldn't see it, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='loomwork-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed at the end of the program."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(removed, spark, path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read back: what reads it several times doesn't compute it again, with any executor lost."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged_wide(df: DataFrame, name: str) -> DataFrame:
    """staged, for rows that take many times their file's size in memory (paths, texts): Spark would broadcast them by the size of the file, so their joins are merge joins."""
    return staged(df, name).hint("merge")


def dropped(*frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    for df in frames:
        removed(df.sparkSession, df._staged_at)
