"""The job log: appended states, the latest of each job, listings."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG = "id string, status string, repo_url string, result_json string, created_at timestamp, updated_at timestamp"


def init(spark: SparkSession, path: str) -> DataFrame:
    """The log at a path, made empty if there is none; as often as one likes."""
    spark.createDataFrame([], LOG).write.mode("ignore").parquet(path)
    return spark.read.schema(LOG).parquet(path)


def append(spark: SparkSession, path: str, id_: str, status: str, repo_url: str = "", result: dict | None = None, created_at: dt.datetime | None = None) -> None:
    """Add a state: running, done (with the result) or error (with {"error": ...}). Earlier states stay as they are."""
    now = dt.datetime.now()
    row = (id_, status, repo_url, None if result is None else json.dumps(result), created_at or now, now)
    spark.createDataFrame([row], LOG).coalesce(1).write.mode("append").parquet(path)


def run(spark: SparkSession, path: str, id_: str, repo_url: str, work) -> str:
    """Call work(), log it as running and then as done or error, and give the last state."""
    began = dt.datetime.now()
    append(spark, path, id_, "running", repo_url, created_at=began)
    try:
        result, status = work(), "done"
    except Exception as e:  # noqa: BLE001  whatever goes wrong is the job's state
        result, status = {"error": f"{type(e).__name__}: {e}"}, "error"
    append(spark, path, id_, status, repo_url, result, began)
    return status


def latest(log: DataFrame) -> DataFrame:
    """The last state of each job (id, created_at, updated_at, status, ...); of equal times the greatest status."""
    order = Window.partitionBy("id").orderBy(F.col("updated_at").desc(), F.col("status").desc())
    return log.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def listing(jobs: DataFrame, limit: int = 50, status: str | None = None) -> DataFrame:
    """The newest jobs, then those of them with this status or verdict: an old one behind the newest `limit` isn't found."""
    newest = jobs.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(min(max(limit, 1), 200))
    return newest if status is None else newest.where((F.col("status") == status) | (F.get_json_object("result_json", "$.verdict") == status))


def by_id(jobs: DataFrame, id_: str) -> DataFrame:
    return jobs.where(F.col("id") == id_)


def record(states: DataFrame, path: str) -> None:
    """Add states of any number of jobs at once: rows as LOG has them, written by the tasks that have them."""
    init(states.sparkSession, path)
    states.select(*[F.col(f.split()[0]).cast(f.split()[1]) for f in LOG.split(", ")]).write.mode("append").parquet(path)
