"""One analysis from files and histories to verdicts, evidence and payloads, for any number of repositories at once."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import round4
from .operators import advisory, clone, evidence, forensics, ingest, minhash, readme, scoring
from .operators.similarity import COMPARERS
from .sources import repos, sinks
from .sources.staging import staged

SIGNALS = scoring.SIGNALS


@dataclass(frozen=True)
class Inputs:
    """repos (repo_id, repo_url, owner, repo_name), contents (repo_id, path, length, content) and commits of the repositories in question.

    repos may also have created_at (timestamp): a date that is known goes before that of the first commit.
    candidates are files of repositories to compare with (slug, owner, created_at, path, language, text); pairs (repo_id, slug) say
    who is compared with whom; registry has earlier submissions (slug, owner, signature).
    """

    repos: DataFrame
    contents: DataFrame
    commits: DataFrame
    candidates: DataFrame | None = None
    pairs: DataFrame | None = None
    registry: DataFrame | None = None


@dataclass(frozen=True)
class Results:
    """Tables by repo_id; signatures are what a registry would keep of the repositories."""

    files: DataFrame
    scores: DataFrame
    evidence: DataFrame
    claims: DataFrame
    excluded: DataFrame
    timeline: DataFrame
    reports: DataFrame
    signatures: DataFrame
    created: DataFrame
    payloads: DataFrame


_CANDIDATE = "slug string, owner string, created_at timestamp, path string, language string, text string"


def candidate_files(contents: DataFrame, about: DataFrame, commits: DataFrame | None = None) -> DataFrame:
    """Files of candidates from contents (repo_id, ...) and about (repo_id, slug, owner, created_at): every file that isn't excluded, however many.

    A missing date is the first commit's.
    """
    about = about if commits is None else ingest.created_at(about, commits)
    files = ingest.classified(contents, None).where("not excluded")
    return files.join(about, "repo_id").select("slug", "owner", F.col("created_at").cast("timestamp").alias("created_at"), "path", "language", "text")


def analyze(spark: SparkSession, given: Inputs, rules: scoring.Rulebook | None = None, matcher: str = "python", top_k: int = ingest.TOP_K, chat: advisory.Chat | None = None) -> Results:
    """All four signals, the verdicts, and what they rest on. The registry is only read here, so nobody meets their own entry.

    With a chat, each payload gets its explanation and questions; they are asked for when all else is written, and change nothing.
    """
    files = staged(ingest.classified(given.contents), "files")
    files = files.join(ingest.centrality(files), ["repo_id", "path"], "left").fillna(0.0, ["import_centrality"])
    files = staged(ingest.ranked(files, top_k), "ranked")
    significant = files.where("significance_rank > 0")
    texts = significant.select("repo_id", "path", "text")
    known = F.col("created_at").cast("timestamp") if "created_at" in given.repos.columns else F.lit(None).cast("timestamp")
    created = ingest.created_at(given.repos.select("repo_id", known.alias("created_at")), given.commits)
    created = staged(created.select("repo_id", F.col("created_at").cast("timestamp").alias("created_at")), "created")
    targets = significant.join(given.repos.select("repo_id", "owner"), "repo_id").join(created, "repo_id", "left")
    targets = staged(targets.select("repo_id", "owner", "created_at", "path", "language", "loc", "text"), "targets")

    history = staged(forensics.forensics(given.commits), "history")
    candidates = staged(given.candidates, "candidates") if given.candidates is not None else spark.createDataFrame([], _CANDIDATE)
    pairs = given.pairs
    if pairs is None:  # whole collections: who shares a gram with whom, and no more
        least = None if matcher in COMPARERS else clone.EVIDENCE
        best, dates = clone.compared_files(targets, candidates, matcher, least=least)
        pairs = same_or_own(given.repos, candidates)
    else:
        best, dates = clone.compared_files(targets, candidates, matcher, pairs)
    best, dates = staged(best, "best"), staged(dates, "dates")
    matches = clone.match_scores(best, targets.groupBy("repo_id").agg(F.sum("loc").alias("total_loc")), dates)
    matches = staged(matches, "matches")
    copied = clone.clone_scores(matches)
    excluded = clone.excluded(given.repos, candidates, pairs)

    readmes = given.repos.select("repo_id").join(ingest.readme(given.contents), "repo_id", "left").fillna("", ["readme_text"])
    vocab = readme.vocabulary(spark)
    claims, kept = readme.analyze_readmes(readmes, files.select("repo_id", "path"), texts, vocab)
    claims, kept = staged(claims, "claims"), staged(kept, "consistency")
    tech = claims.where("claim_type = 'tech_stack'").select("repo_id", F.substring("claim_text", 6, 1 << 20).alias("tech"), "status").join(F.broadcast(vocab.select("tech", "ecosystem")), "tech")

    signatures = minhash.merged(minhash.minima(texts, ["repo_id"]), "repo_id")
    signatures = staged(given.repos.join(signatures, "repo_id").select(F.col("repo_id").alias("slug"), "owner", "signature"), "signatures")
    registry = given.registry if given.registry is not None else spark.createDataFrame([], "slug string, owner string, signature array<long>")
    seen = minhash.registry_match(signatures, registry).withColumnRenamed("slug", "repo_id")

    signals = given.repos.select("repo_id").join(ingest.coverage(files), "repo_id", "left").fillna(0, ["total_loc", "compared_loc"]).fillna(0.0, ["coverage_ratio"])
    signals = signals.join(copied.select("repo_id", "clone_similarity"), "repo_id", "left").join(seen, "repo_id", "left").join(kept, "repo_id", "left").join(history.select("repo_id", "commit_count", "commit_forensics"), "repo_id", "left")
    scores = staged(scoring.scored(signals.fillna(0, ["commit_count"]), rules), "scores")

    facts = evidence.union(
        evidence.of_clones(matches, evidence.matched_files(best, targets, candidates)),
        evidence.of_readmes(tech, vocab, texts),
        evidence.of_commits(history),
        evidence.of_registry(signatures, registry),
    )
    facts = staged(facts, "evidence")
    reports = sinks.report(scores, facts)
    advice = staged(advisory.advised(advisory.contexts(scores, facts), chat), "advice") if chat else None
    out = Results(files, scores, facts, claims, excluded, timeline(given.commits), reports, signatures, created, scores)
    return replace(out, payloads=payloads(given.repos, out, matcher, advice))


def same_or_own(about: DataFrame, candidates: DataFrame) -> DataFrame:
    """Pairs (repo_id, slug) that the guard can leave out: equal names, and equal owners."""
    others = candidates.select("slug", F.col("owner").alias("_o")).distinct()
    mine = about.select("repo_id", "owner")
    named = mine.join(others, F.col("repo_id") == F.col("slug")).select("repo_id", "slug")
    owned = mine.where("owner <> ''").join(others, F.col("owner") == F.col("_o")).select("repo_id", "slug")
    return named.unionByName(owned).distinct()


def timeline(commits: DataFrame) -> DataFrame:
    """repo_id, sha, ts (text), additions, deletions, subject; ordered by ts as text wherever it is listed."""
    subject = F.substring(F.element_at(F.split(F.trim("message"), r"\r?\n"), 1), 1, 100)
    return commits.select("repo_id", F.substring("sha", 1, 7).alias("sha"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ssXXX").alias("ts"), F.col("additions").cast("long").alias("additions"), F.col("deletions").cast("long").alias("deletions"), F.coalesce(subject, F.lit("")).alias("subject"))


def _listed(df: DataFrame, name: str, order: list[str], fields: list) -> DataFrame:
    """repo_id and an array of structs in order. Lists are short: commits, claims and evidence of one repository are limited."""
    item = F.struct(F.struct(*order).alias("o"), F.struct(*fields).alias("v"))
    return df.groupBy("repo_id").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["v"]).alias(name))


def payloads(about: DataFrame, found: Results, matcher: str, advice: DataFrame | None = None) -> DataFrame:
    """repo_id and payload: the JSON of each result, all fields always there; advice as from advisory.advised, if it was asked for."""
    sub = F.struct(*[F.col(s) for s in SIGNALS])
    rows = about.join(found.scores, "repo_id").select("repo_id", "repo_url", "owner", "repo_name", "verdict", F.col("composite").alias("composite_score"), sub.alias("sub_scores"), "coverage_ratio", F.col("commit_count").cast("long").alias("commit_count"), F.col("total_loc").cast("long").alias("total_loc"), F.col("compared_loc").cast("long").alias("compared_loc"), F.lit(matcher).alias("matcher"))
    parts = [
        _listed(found.evidence, "evidence", ["place", "ordinal"], ["id", "type", "feeds", "summary", "detail", "confidence"]),
        _listed(found.claims, "readme_claims", ["claim_type", "claim_text"], ["claim_text", "claim_type", "status", "evidence_ref"]),
        _listed(found.timeline, "commit_timeline", ["ts", "sha"], ["sha", "ts", "additions", "deletions", "subject"]),
        found.excluded.groupBy("repo_id").agg(F.sort_array(F.collect_list("slug")).alias("self_excluded_candidates")),
        found.reports,
        about.select("repo_id", F.expr("cast(null as struct<review_id:string,summary:string>)").alias("ai_opinion"), F.expr("cast(null as array<struct<question:string,target:string>>)").alias("interview_probes")) if advice is None else advice,
    ]
    out = reduce(lambda a, b: a.join(b, "repo_id", "left"), parts, rows)
    for c, kind in out.dtypes:
        if kind.startswith("array"):
            out = out.withColumn(c, F.coalesce(c, F.array().cast(kind)))
    return sinks.payload(out)


def of_folders(spark: SparkSession, roots: dict[str, str], candidates: dict[str, str] | None = None, registry: DataFrame | None = None, created: dict[str, dt.datetime | None] | None = None) -> Inputs:
    """Inputs from folders with their git histories: repo_id to folder, and slug to folder of the candidates, all compared with all; created has dates that are known."""
    known = created or {}
    about = spark.createDataFrame([(k, r, *repos.named(k), known.get(k)) for k, r in roots.items()], "repo_id string, repo_url string, owner string, repo_name string, created_at timestamp")
    contents = repos.trees(spark, roots)
    given = Inputs(about, contents, repos.commits(spark, roots), registry=registry)
    if not candidates:
        return given
    others = spark.createDataFrame([(k, k, repos.named(k)[0], known.get(k)) for k in candidates], "repo_id string, slug string, owner string, created_at timestamp")
    files = candidate_files(repos.trees(spark, candidates), others, repos.commits(spark, candidates))
    pairs = spark.createDataFrame([(a, b) for a in roots for b in candidates], "repo_id string, slug string")
    return replace(given, candidates=files, pairs=pairs)


def claims_of(claims: DataFrame, kind: str | None = None) -> DataFrame:
    """Claims of one type, or all; "feature", "setup_env" and "tech_stack" are the types there are."""
    return claims if kind is None else claims.where(F.col("claim_type") == kind)


def claim_counts(claims: DataFrame) -> DataFrame:
    """Claims by type and status."""
    return claims.groupBy("claim_type", "status").agg(F.count("*").alias("n"))


def band(suspicion: Column) -> Column:
    """The colour in which a suspicion is shown: hotter when higher."""
    return F.when(suspicion >= 0.65, "red").when(suspicion >= 0.45, "amber").when(suspicion >= 0.2, "yellow").otherwise("emerald")


def percent(x: Column) -> Column:
    """A share as whole percent."""
    return F.concat(F.floor(round4(x) * 100 + 0.5).cast("string"), F.lit("%"))
