"""The command: `python -m tracewell analyze TARGET ...` and `python -m tracewell eval ...`; --help tells the options."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import sys
from argparse import ArgumentParser, Namespace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis, corpus
from .operators import advisory, ingest, jobs, minhash
from .settings import Settings
from .sources import repos, staging, versions

#: Options of each command.
OPTIONS: dict[str, dict[str, dict]] = {
    "analyze": {
        "target": {"help": "folder of a repository, or its address"},
        "--candidate": {"action": "append", "default": [], "help": "folder of a repository that may have been copied; as often as need be"},
        "--top-k": {"type": int, "default": ingest.TOP_K, "help": "number of files that are compared, the most significant first"},
        "--registry": {"help": "folder or address of the registry, in place of TRACEWELL_REGISTRY"},
        "--jobs": {"help": "folder or address of the job log, in place of TRACEWELL_JOBS"},
        "--no-register": {"action": "store_true", "help": "only look into the registry"},
        "--explain": {"action": "store_true", "help": "ask the chat that TRACEWELL_CHAT names for an explanation and questions"},
        "--json": {"action": "store_true", "help": "whole payload, not the report"},
    },
    "eval": {
        "--split": {"choices": ["heldout", "tuning", "all"], "default": "heldout", "help": "part of the labelled corpus"},
        "--out": {"help": "file for the report"},
        "--json": {"action": "store_true", "help": "metrics, not the report"},
    },
}


def parsed(args: list[str] | None) -> Namespace:
    top = ArgumentParser(prog="tracewell", description="Is a repository its author's own work?")
    commands = top.add_subparsers(dest="command", required=True)
    for name, options in OPTIONS.items():
        command = commands.add_parser(name)
        for option, how in options.items():
            command.add_argument(option, **how)
    return top.parse_args(args)


def _chat(name: str) -> advisory.Chat | None:
    """The function that package.module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function) if function else None


def _entry(found: analysis.Results, at: repos.Target) -> DataFrame:
    """What the registry keeps of an analysis."""
    rows = found.signatures.join(found.created.select(F.col("repo_id").alias("slug"), F.col("created_at").alias("repo_created_at")), "slug", "left")
    return rows.withColumns({"repo_url": F.lit(at.url), "repo_name": F.lit(at.name), "ingested_at": F.lit(dt.datetime.now())})


def _register(spark: SparkSession, folder: str, new: DataFrame, tries: int = 5) -> int:
    """Publish the registry with new rows; if somebody else published meanwhile, again upon theirs."""
    for left in range(tries, 0, -1):
        have = versions.versions(spark, folder)
        before = versions.read(spark, folder, have[-1]) if have else None
        rows = minhash.upsert(new.limit(0) if before is None else before, new if before is None else new.select(*before.columns))
        try:
            return versions.publish(rows, folder, after=have[-1] if have else 0)
        except versions.Conflict:
            if left == 1:
                raise
    raise AssertionError


def _evaluate(spark: SparkSession, given: Namespace) -> int:
    metrics, text = corpus.report(spark, given.split)
    if given.out:
        out = Path(given.out)
        out.parent.mkdir(parents=True, exist_ok=True)
        out.write_text(text, encoding="utf-8")
    print(json.dumps(metrics, indent=2, default=str) if given.json else text)
    return 0


def _analyze(spark: SparkSession, given: Namespace, settings: Settings) -> int:
    try:
        at = repos.target(given.target, settings.cache)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    chat = _chat(settings.chat) if given.explain else None
    if given.explain and chat is None:
        print("no advice: TRACEWELL_CHAT names no chat", file=sys.stderr)
    registry, log = given.registry or settings.registry, given.jobs or settings.jobs
    others = {Path(c).resolve().name: str(Path(c).resolve()) for c in given.candidate}
    shown: dict = {}

    def work() -> dict:
        began = staging.mark()
        earlier = versions.read(spark, registry) if registry else None
        inputs = analysis.of_folders(spark, {at.slug: str(at.folder)}, others, earlier, {at.slug: repos.created(at)})
        found = analysis.analyze(spark, inputs, top_k=given.top_k, chat=chat)
        shown["payload"], shown["report"] = json.loads(found.payloads.first().payload), found.reports.first().report_text
        if registry and not given.no_register:
            _register(spark, registry, _entry(found, at))
        staging.clear(spark, began)
        return shown["payload"]

    if log:
        jobs.init(spark, log)
        jobs.run(spark, log, f"{at.slug}@{dt.datetime.now().isoformat()}", at.url, work)
    else:
        work()
    if "report" not in shown:
        print("the analysis failed; the job log says why", file=sys.stderr)
        return 1
    print(json.dumps(shown["payload"], indent=2) if given.json else shown["report"])
    return 0


def main(args: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> int:
    given = parsed(args)
    spark = spark or SparkSession.builder.appName("tracewell").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return _evaluate(spark, given) if given.command == "eval" else _analyze(spark, given, settings or Settings())


if __name__ == "__main__":
    sys.exit(main())
