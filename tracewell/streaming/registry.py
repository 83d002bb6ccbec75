"""An extension: the registry as a stream of submissions, each micro-batch checked against what came before it and then added."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.minhash import prior, upsert
from ..sources import versions


def run(submissions: DataFrame, folder: str, results: str, checkpoint: str) -> StreamingQuery:
    """submissions (slug, owner, repo_name, repo_url, repo_created_at, ingested_at, signature): matches go to `results`, versions to `folder`.

    A submission meets what was submitted before it by (ingested_at, slug), in the registry or in its own batch, so of two like ones
    that come together only the later has a match. A batch's version is published under its number: a batch that is repeated after a
    failure reads the version before its own and writes none twice, and what a killed one left is never read.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        have = [v for v in versions.versions(spark, folder) if versions.manifest(spark, folder, v)["tag"] != f"batch {number}"]
        before = versions.read(spark, folder, have[-1]) if have else None
        timed = lambda x: x.select("slug", "owner", F.col("ingested_at").alias("at"), "signature")
        found = prior(timed(df), None if before is None else timed(before))
        out = df.select("slug", F.col("ingested_at").alias("at")).join(found, ["slug", "at"], "left")
        out.select("slug", "at", "other", F.coalesce("jaccard", F.lit(0.0)).alias("registry_match")).write.mode("overwrite").parquet(f"{results}/batch={number}")
        rows = upsert(df.limit(0) if before is None else before, df if before is None else df.select(*before.columns))
        versions.publish(rows, folder, after=have[-1] if have else 0, tag=f"batch {number}", data=f"v={number}")

    return submissions.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
