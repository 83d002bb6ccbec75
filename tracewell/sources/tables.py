"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables whose rows are long, so that much is done with each.
LONG = ("documents", "pages", "conversations")


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or dealt to all cores where it is read in fewer parts than there are cores: one small file, say."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def small_batches(spark: SparkSession, most: int) -> None:
    """Let Arrow batches to Python have at most so many bytes, where the session allows more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if not 0 < now <= most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name in LONG else df
