"""Commit-history forensics over all repositories at once.

Commits: repo_id, ts (the instant), local (the commit's own clock), message. Every measure is a suspicion in [0, 1] per repo_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clamp, rescale, round4, strip

WEIGHTS = {"fixed_time": 0.30, "regularity": 0.30, "message": 0.25, "collision": 0.15}
RELIABLE = 10
# Messages that say nothing.
GENERIC = (
    "update", "updates", "updated", "commit", "commits", "changes", "change", "changed", "fix", "fixes", "fixed", "wip", "stuff", "edit", "edits",
    "misc", ".", "..", "...", "minor", "temp", "tmp", "asdf", "test", "testing", "initial commit", "first commit", "add files via upload",
)


def confidence(n: Column) -> Column:
    return F.least(F.lit(1.0), n / float(RELIABLE))


def fixed_time(commits: DataFrame) -> DataFrame:
    """Share of the commonest time of day (to the second, by the commit's own clock) above 0.25; under three commits 0."""
    per = commits.groupBy("repo_id", F.date_format("local", "HH:mm:ss").alias("hms")).agg(F.count("*").alias("n"))
    got = per.groupBy("repo_id").agg(F.max("n").alias("most"), F.sum("n").alias("n"))
    return got.select("repo_id", F.when(F.col("n") < 3, 0.0).otherwise(rescale(F.col("most") / F.col("n"), 0.25)).alias("fixed_time"))


def regularity(commits: DataFrame) -> DataFrame:
    """How even the gaps between commits are: (1 - cv) / 0.8. Five commits and four gaps above zero are needed."""
    order = Window.partitionBy("repo_id").orderBy("ts")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gaps = commits.select("repo_id", "ts", ((micros - F.lag(micros).over(order)) / 1e6).alias("gap"))
    some = F.when(F.col("gap") > 0, F.col("gap"))
    got = gaps.groupBy("repo_id").agg(F.count("*").alias("n"), F.count(some).alias("k"), F.avg(some).alias("mean"), F.stddev_pop(some).alias("dev"))
    even = clamp((1.0 - F.col("dev") / F.col("mean")) / 0.8)
    return got.select("repo_id", F.when((F.col("n") < 5) | (F.col("k") < 4), 0.0).otherwise(even).alias("regularity"))


def message_quality(commits: DataFrame) -> DataFrame:
    """Half the share of generic first lines, half that of repeated ones; merges and blanks aside; under three messages 0."""
    said = commits.select("repo_id", F.lower(strip(F.col("message"))).alias("m"))
    said = said.select("repo_id", F.when((F.col("m") != "") & ~F.col("m").startswith("merge "), strip(F.element_at(F.split("m", r"\r?\n"), 1))).alias("m"))
    got = said.groupBy("repo_id").agg(F.count("m").alias("n"), F.count(F.when(F.col("m").isin(*GENERIC), 1)).alias("g"), F.countDistinct("m").alias("d"))
    blend = clamp(0.5 * F.col("g") / F.col("n") + 0.5 * (1.0 - F.col("d") / F.col("n")))
    return got.select("repo_id", F.when(F.col("n") < 3, 0.0).otherwise(blend).alias("message"))


def collisions(commits: DataFrame) -> DataFrame:
    """Share of commits at an instant that another one has, above 0.10; under three commits 0."""
    per = commits.groupBy("repo_id", "ts").agg(F.count("*").alias("n"))
    got = per.groupBy("repo_id").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("c"))
    return got.select("repo_id", F.when(F.col("n") < 3, 0.0).otherwise(rescale(F.col("c") / F.col("n"), 0.10)).alias("collision"))


def forensics(commits: DataFrame) -> DataFrame:
    """repo_id, commit_count, the four parts, confidence and commit_forensics (rounded to four decimals)."""
    out = commits.groupBy("repo_id").agg(F.count("*").alias("commit_count"))
    for part in (fixed_time, regularity, message_quality, collisions):
        out = out.join(part(commits), "repo_id")
    out = out.withColumn("confidence", confidence(F.col("commit_count")))
    raw = sum((F.lit(w) * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("commit_forensics", round4(clamp(raw * F.col("confidence"))))


def timeline(commits: DataFrame) -> DataFrame:
    """Per commit: first seven characters of its id, its time as text, the first line's first hundred characters, churn."""
    return commits.select("repo_id", F.substring("sha", 1, 7).alias("sha"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("at"), F.substring(F.element_at(F.split("message", r"\r?\n"), 1), 1, 100).alias("message"), (F.col("additions") + F.col("deletions")).alias("churn"))


def evidence(scores: DataFrame) -> DataFrame:
    """A row for each part that is at least 0.4."""
    kinds = F.expr("stack(4, 'fixed_time', fixed_time, 'regularity', regularity, 'message', message, 'collision', collision) as (kind, confidence)")
    return scores.select("repo_id", kinds).where("confidence >= 0.4")
