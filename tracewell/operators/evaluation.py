"""Metrics of verdicts against labels."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import round4, safe_div

MINUTES = {"manual": 12, "queued": 4, "other": 1}


def _if(c: Column) -> Column:
    return F.count(F.when(c, 1))


def _matrix() -> list[Column]:
    flagged, fake = F.col("verdict") == "flagged", ~F.col("authentic")
    return [_if(flagged & fake).alias("tp"), _if(flagged & ~fake).alias("fp"), _if(~flagged & ~fake).alias("tn"), _if(~flagged & fake).alias("fn")]


def confusion(outcomes: DataFrame, *keys: str) -> DataFrame:
    """outcomes (authentic, verdict): tp, fp, tn, fn and their rates; positive is flagged."""
    return _rated(outcomes.groupBy(*keys).agg(*_matrix()))


def _rated(c: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    precision, recall = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
    f1 = safe_div(2 * precision * recall, precision + recall)
    rates = {"precision": precision, "recall": recall, "f1": f1, "false_positive_rate": safe_div(fp, fp + tn), "accuracy": safe_div(tp + tn, tp + fp + tn + fn)}
    return c.withColumns({k: round4(v) for k, v in rates.items()})


def breakdown(outcomes: DataFrame, *keys: str) -> DataFrame:
    """confusion() with queued and insufficient cases for every set of keys at once, in one pass: a key that a row doesn't go by is null.

    level is the grouping id: 0 by all keys, and all ones for the total; it tells a null of the data from a key left out.
    """
    sets = [[F.col(k) for k in some] for n in range(len(keys), -1, -1) for some in combinations(keys, n)]
    queued = [_if(F.col("verdict") == v).alias(n) for v, n in (("needs_human_review", "review_queue"), ("insufficient_signal", "insufficient"))]
    return _rated(outcomes.groupingSets(sets, *keys).agg(F.grouping_id(*keys).cast("long").alias("level"), *_matrix(), *queued))


def triage(outcomes: DataFrame, *keys: str) -> DataFrame:
    """Counts of resolved, queued and insufficient cases, the share of fakes flagged or queued, and reviewer minutes saved."""
    v = F.col("verdict")
    t = outcomes.groupBy(*keys).agg(F.count("*").alias("total"), _if(v.isin("flagged", "clean")).alias("auto_resolved"), _if(v == "needs_human_review").alias("review_queue"), _if(v == "insufficient_signal").alias("insufficient"), _if(~F.col("authentic")).alias("fakes"), _if(~F.col("authentic") & v.isin("flagged", "needs_human_review")).alias("detected"))
    t = t.withColumns({f"{k}_pct": round4(safe_div(F.col(k).cast("double"), F.col("total"))) for k in ("auto_resolved", "review_queue", "insufficient")})
    t = t.withColumn("detection_rate", round4(safe_div(F.col("detected").cast("double"), F.col("fakes"))))
    t = t.withColumn("baseline_minutes", F.col("total") * MINUTES["manual"]).withColumn("tool_minutes", (F.col("total") - F.col("review_queue")) * MINUTES["other"] + F.col("review_queue") * MINUTES["queued"])
    return t.withColumn("saved_minutes", F.col("baseline_minutes") - F.col("tool_minutes")).withColumn("saved_pct", round4(safe_div(F.col("saved_minutes").cast("double"), F.col("baseline_minutes"))))


def correct(authentic: Column, verdict: Column) -> Column:
    """Whether a verdict is right: authentic ones aren't flagged, others are flagged or queued."""
    return F.when(authentic, verdict != "flagged").otherwise(verdict.isin("flagged", "needs_human_review"))


def markdown(split: str, matrix: dict, counts: dict, outcomes: list[dict]) -> str:
    """The report of an evaluation: rows of confusion() and triage(), and the outcomes (repo_id, category, verdict, composite, clone_similarity, correct)."""
    m, t = matrix, counts
    share = lambda k: f"{t[k]}/{t['total']} ({t[k] / max(1, t['total']):.1%})"
    table = lambda title, rows: [f"## {title}", "", "| Metric | Value |", "|---|---|", *(f"| {a} | {b} |" for a, b in rows), ""]
    lines = [f"# Evaluation of the {split} split", ""]
    lines += table("Detection (positive: flagged)", [("Repositories", m["tp"] + m["fp"] + m["tn"] + m["fn"]), *((k.replace("_", " ").capitalize(), f"{m[k]:.3f}") for k in ("precision", "recall", "f1", "false_positive_rate", "accuracy")), ("tp / fp / tn / fn", f"{m['tp']} / {m['fp']} / {m['tn']} / {m['fn']}")])
    lines += table("Triage", [("Auto-resolved", share("auto_resolved")), ("Review queue", share("review_queue")), ("Insufficient signal", share("insufficient")), ("Flagged or queued fakes", f"{t['detected']}/{t['fakes']} ({t['detection_rate']:.1%})"), ("Reviewer minutes (assumed)", f"{t['baseline_minutes']} to {t['tool_minutes']} ({t['saved_pct']:.0%} saved)")])
    lines += ["## Outcomes", "", "| repository | category | verdict | composite | clone | right |", "|---|---|---|---|---|---|"]
    lines += [f"| {o['repo_id']} | {o['category']} | {o['verdict']} | {o['composite']:.3f} | {o['clone_similarity']:.3f} | {'yes' if o['correct'] else 'no'} |" for o in outcomes]
    return "\n".join([*lines, ""])


def leaks(labelled: DataFrame) -> DataFrame:
    """repo_ids that stand in more than one split or more than once."""
    return labelled.groupBy("repo_id").agg(F.count("*").alias("rows"), F.countDistinct("split").alias("splits")).where("rows > 1 or splits > 1")
