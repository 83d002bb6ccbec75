"""Advice beside a score: never an input to one. A chat callable is handed in; without it, or if it fails, there is none."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (system, user) to an answer, or None if there is none.
Chat = Callable[[str, str], str | None]

_SYSTEM = "Explain the findings below in plain words. They are settled; don't judge them."


def review_id(name: Column, verdict: Column, composite: Column) -> Column:
    """A short id that depends on name, verdict and score alone."""
    return F.concat(F.lit("rev_"), F.substring(F.sha1(F.concat_ws("|", name, verdict, F.format_string("%.4f", composite)).cast("binary")), 1, 12))


def contexts(scores: DataFrame, evidence: DataFrame) -> DataFrame:
    """repo_id, review_id, context: verdict, score, and the summaries of evidence, the surest first; no source code."""
    item = F.struct((-F.col("confidence")).alias("o"), "id", "summary")
    facts = evidence.groupBy("repo_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(item)), lambda x: F.concat(F.lit("- ["), x["id"], F.lit("] "), x["summary"])), "\n").alias("f"))
    head = F.concat(F.lit("Verdict: "), "verdict", F.lit("\nComposite: "), F.format_string("%.4f", "composite"))
    return scores.join(facts, "repo_id", "left").select("repo_id", review_id(F.col("repo_id"), F.col("verdict"), F.col("composite")).alias("review_id"), F.concat_ws("\n", head, "f").alias("context"))


def probes(answers: DataFrame) -> DataFrame:
    """repo_id, question, target of JSON answers {"probes": [{"question", "targets"}]}; what isn't a question is left out, a missing target is "general"."""
    parsed = answers.select("repo_id", F.explode(F.from_json("answer", "struct<probes:array<struct<question:string,targets:string>>>").getField("probes")).alias("p"))
    return parsed.where(F.trim(F.coalesce("p.question", F.lit(""))) != "").select("repo_id", F.col("p.question").alias("question"), F.coalesce("p.targets", F.lit("general")).alias("target"))


def review(context: str, chat: Chat | None) -> str | None:
    """An explanation of one context, on the driver, after the scores are written."""
    if chat is None:
        return None
    try:
        return chat(_SYSTEM, context)
    except Exception:  # noqa: BLE001  advice may fail in any way and must never fail an analysis
        return None


def probe_evidence(probes_: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each probe with the evidence it aims at; a general one, or one at nothing known, without."""
    return probes_.join(evidence.select("repo_id", F.col("id").alias("target"), "type", "summary"), ["repo_id", "target"], "left")


def reviewed(context: str, chat: Chat | None) -> tuple[str | None, list[dict]]:
    """Explanation and interview questions of one context from a chat that answers in JSON; nothing if there is no chat or it fails."""
    answer = review(context, chat)
    try:
        data = json.loads(answer) if answer else {}
    except ValueError:
        return None, []
    if not isinstance(data, dict):
        return None, []
    asked = data.get("interview_questions")
    some = [x for x in (asked if isinstance(asked, list) else []) if isinstance(x, dict) and str(x.get("question", "")).strip()]
    told = str(data.get("explanation") or data.get("summary") or "").strip() or None
    return told, [{"question": str(x["question"]).strip(), "target": str(x.get("targets") or "general").strip()} for x in some]


#: What advice adds to a result.
ADVICE = "ai_opinion struct<review_id:string,summary:string>, interview_probes array<struct<question:string,target:string>>"


def advised(contexts_: DataFrame, chat: Chat) -> DataFrame:
    """repo_id, ai_opinion (null where the chat has nothing to say) and interview_probes of rows as contexts() gives them.

    The chat is called once a repository, where its row is; it is sent to the executors, so it must be a function that can be
    pickled. Whatever goes wrong with it leaves that repository without advice.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            told = [reviewed(c, chat) for c in b["context"]]
            opinion = [{"review_id": i, "summary": t} if t else None for i, (t, _) in zip(b["review_id"], told, strict=True)]
            yield pd.DataFrame({"repo_id": b["repo_id"], "ai_opinion": opinion, "interview_probes": [q for _, q in told]})

    return contexts_.select("repo_id", "review_id", "context").mapInPandas(ask, f"repo_id {contexts_.schema['repo_id'].dataType.simpleString()}, {ADVICE}")
