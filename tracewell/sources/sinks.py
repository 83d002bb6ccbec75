"""Results as payloads, reports and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fields of a result, in order.
PAYLOAD = (
    "repo_url", "owner", "repo_name", "verdict", "composite_score", "sub_scores", "coverage_ratio", "commit_count", "total_loc", "compared_loc",
    "evidence", "readme_claims", "commit_timeline", "self_excluded_candidates", "matcher", "report_text", "ai_opinion", "interview_probes",
)
HEADLINES = {
    "clean": "No sign of copied or made-up work.",
    "flagged": "Strong signs that this is not the author's own work.",
    "needs_human_review": "Some signs; a person should look.",
    "insufficient_signal": "Too little to judge.",
}


def payload(results: DataFrame) -> DataFrame:
    """repo_id and payload (JSON) of results; fields that a result lacks are null. analysis.payloads() has all but the advisory ones."""
    fields = [(F.col(c) if c in results.columns else F.lit(None).cast("string")).alias(c) for c in PAYLOAD]
    return results.select("repo_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("payload"))


def _two(c: str) -> Column:
    return F.format_string("%.2f", F.col(c))


def report(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo_id and report_text: verdict, score, parts, coverage and evidence, the surest first."""
    item = F.struct((-F.col("confidence")).alias("o"), F.col("id").alias("i"), F.concat(F.lit("  ["), F.col("id"), F.lit("] "), F.format_string("%.2f", "confidence"), F.lit(" "), F.col("summary")).alias("t"))
    lines = evidence.groupBy("repo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["t"]), "\n").alias("_e"))
    head = F.lit("")
    for v, t in HEADLINES.items():
        head = F.when(F.col("verdict") == v, t).otherwise(head)
    parts = [F.concat(F.lit(f"  {s}: "), _two(s)) for s in ("clone_similarity", "registry_match", "readme_consistency", "commit_forensics")]
    cover = F.format_string("Compared %.0f%% of the code; %d commits.", F.col("coverage_ratio") * 100, F.col("commit_count").cast("int"))
    text = F.concat_ws("\n", F.concat(F.lit("Report on "), "repo_id"), head, F.concat(F.lit("Composite suspicion: "), _two("composite")), *parts, cover, F.coalesce("_e", F.lit("No evidence.")))
    return scores.join(lines, "repo_id", "left").select("repo_id", text.alias("report_text"))


def snapshot(df: DataFrame, folder: str, version: int) -> str:
    """Write a version of a table to its own folder; a failed write never touches the version before."""
    path = f"{folder}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
