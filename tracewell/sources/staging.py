"""Tables between the steps of an analysis, in the cluster's shared folder: plans stay small, and a lost executor loses nothing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has written and nobody has removed yet.
_LEFT: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a local session gets a temporary one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df below the shared folder and read it back. What is left goes when the driver's process ends, or by clear()."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(spark: SparkSession, path: str) -> None:
    """Remember a folder, so that it goes with the others."""
    if not _LEFT:
        atexit.register(_end, spark)
    _LEFT.append(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables staged after the first `since`; results that still read them must have been written."""
    while len(_LEFT) > since:
        at = spark._jvm.org.apache.hadoop.fs.Path(_LEFT.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def mark() -> int:
    """For clear(): how many tables there are now."""
    return len(_LEFT)


def _end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        clear(spark)
