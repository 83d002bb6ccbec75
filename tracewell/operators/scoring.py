"""Composite score and verdict from a rulebook that is data."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round4

SIGNALS = ("clone_similarity", "registry_match", "readme_consistency", "commit_forensics")


@dataclass(frozen=True)
class Rulebook:
    # The published weights and thresholds.
    weights: dict[str, float] = field(default_factory=lambda: {"clone_similarity": 0.45, "registry_match": 0.20, "readme_consistency": 0.20, "commit_forensics": 0.15})
    flagged: float = 0.65
    review_low: float = 0.45
    critical: dict[str, float] = field(default_factory=lambda: {"clone_similarity": 0.85, "registry_match": 0.90})
    min_commits: int = 3
    min_coverage: float = 0.35

    @staticmethod
    def load(path: str | Path) -> Rulebook:
        """From a YAML file with the sections weights, thresholds, critical_signals and insufficient_signal."""
        import yaml

        raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
        base, limits, thin = Rulebook(), raw.get("thresholds", {}), raw.get("insufficient_signal", {})
        return Rulebook(raw.get("weights", base.weights), limits.get("flagged", base.flagged), limits.get("review_low", base.review_low), raw.get("critical_signals", {}), thin.get("min_commits", base.min_commits), thin.get("min_coverage", base.min_coverage))


def composite(rules: Rulebook) -> Column:
    total = sum(rules.weights.values()) or 1.0
    return round4(sum((F.lit(float(w)) * F.col(s) for s, w in rules.weights.items()), F.lit(0.0)) / F.lit(float(total)))


def verdict(rules: Rulebook) -> Column:
    """In this order: a critical signal, too little to judge, flagged, review, clean."""
    critical = F.lit(False)
    for s, cut in rules.critical.items():
        critical = critical | (F.col(s) >= cut)
    thin = (F.col("coverage_ratio") < rules.min_coverage) | (F.col("commit_count") < rules.min_commits)
    score = F.col("composite")
    return F.when(critical, "flagged").when(thin & (score < rules.flagged), "insufficient_signal").when(score >= rules.flagged, "flagged").when(score >= rules.review_low, "needs_human_review").otherwise("clean")


def scored(signals: DataFrame, rules: Rulebook | None = None) -> DataFrame:
    """signals (the four columns, coverage_ratio, commit_count) with composite and verdict; a missing signal counts as 0."""
    rules = rules or Rulebook()
    filled = signals.withColumns({s: F.coalesce(F.col(s), F.lit(0.0)) for s in SIGNALS})
    return filled.withColumn("composite", composite(rules)).withColumn("verdict", verdict(rules))


def contributions(scores: DataFrame, rules: Rulebook | None = None) -> DataFrame:
    """A row per signal: its value times its weight."""
    rules = rules or Rulebook()
    pairs = ", ".join(f"'{s}', {s}, cast({rules.weights.get(s, 0.0)} as double)" for s in SIGNALS)
    return scores.select("repo_id", F.expr(f"stack({len(SIGNALS)}, {pairs}) as (signal, value, weight)")).withColumn("contribution", F.col("value") * F.col("weight"))
