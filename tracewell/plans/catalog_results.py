"""Queries of what an analysis gives out: reports, payloads, advice, job logs, evidence ids, and what it reads: candidates, given pairs."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import analysis
from ..functions.text import round4
from ..operators import advisory, clone, evidence, forensics, jobs, similarity
from ..sources import sinks, staging
from . import catalog
from .catalog import _EACH, _FORENSICS, _R4, _RUN, _SIGNALS, _query, table
from .catalog_files import _PART_SQL


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.of_commits(forensics.forensics(catalog._commits(spark, sf_dir, "hour")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog._scored(spark, sf_dir).withColumn("coverage_ratio", round4(F.col("coverage_ratio")))


_TWO = "printf('%.2f', round(({})::DECIMAL(18, 12), 2))"
_SAID = " ".join(f"WHEN '{name}' THEN '{said}'" for _, name, said in evidence.PARTS)
_FACTS = f"""pt AS ({_PART_SQL}), fc AS (SELECT repo_id, 'commit_' || part AS id, {_R4.format("least(1.0, commit_count / 10.0::DOUBLE)")} AS confidence, (CASE part {_SAID} END) || ' (signal ' || {_TWO.format("v")} || ')' AS summary FROM pt WHERE v >= 0.4)"""
_HEAD = " ".join(f"WHEN '{v}' THEN '{t.replace(chr(39), chr(39) * 2)}'" for v, t in sinks.HEADLINES.items())


@_query(f"""{_SIGNALS}, {_FACTS}, ln AS (SELECT repo_id, string_agg('  [' || id || '] ' || {_TWO.format("confidence")} || ' ' || summary, chr(10) ORDER BY confidence DESC, id) AS e FROM fc GROUP BY 1)
SELECT vd.repo_id, concat_ws(chr(10), 'Report on ' || vd.repo_id, CASE verdict {_HEAD} END, 'Composite suspicion: ' || {_TWO.format("composite")}, '  clone_similarity: ' || {_TWO.format("clone_similarity")}, '  registry_match: ' || {_TWO.format("registry_match")},
'  readme_consistency: ' || {_TWO.format("readme_consistency")}, '  commit_forensics: ' || {_TWO.format("commit_forensics")}, 'Compared ' || round(({_R4.format("coverage_ratio")}) * 100)::INT || '% of the code; ' || commit_count || ' commits.', coalesce(e, 'No evidence.')) AS report_text FROM vd LEFT JOIN ln USING (repo_id)""")
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.report(_judged(spark, sf_dir), _facts(spark, sf_dir))


@_query(f"""{_SIGNALS} SELECT repo_id, verdict, composite::VARCHAR AS composite_score, commit_count::VARCHAR AS commit_count, '["ai_opinion","claims"]' AS empty_fields, 18 AS n_fields FROM vd""")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader finds in each payload; fields that there is nothing for are there, and empty."""
    scores = catalog._scored(spark, sf_dir)
    sub = F.struct(*analysis.SIGNALS)
    rows = scores.select("repo_id", "verdict", F.col("composite").alias("composite_score"), sub.alias("sub_scores"), "commit_count", F.array().cast("array<string>").alias("readme_claims"))
    p = sinks.payload(rows)
    told = lambda f: F.get_json_object("payload", f"$.{f}")
    empty = F.when(told("ai_opinion").isNull() & (told("readme_claims") == "[]"), '["ai_opinion","claims"]')
    return p.select("repo_id", told("verdict").alias("verdict"), told("composite_score").alias("composite_score"), told("commit_count").alias("commit_count"), empty.alias("empty_fields"), F.size(F.json_object_keys("payload")).alias("n_fields"))


def _plain_chat(system: str, user: str) -> str:
    """Repeats the second line that it is told, and asks about each fact, and once in general."""
    facts = [x[3:].split("]")[0] for x in user.splitlines() if x.startswith("- [")]
    return json.dumps({"explanation": user.splitlines()[1], "interview_questions": [*({"question": f"What about {f}?", "targets": f} for f in facts), {"question": "Who wrote it?"}]})


@_query(f"""{_SIGNALS}, {_FACTS}, ad AS (SELECT repo_id, 'rev_' || substr(sha1(concat_ws('|', repo_id::VARCHAR, verdict, printf('%.4f', composite))), 1, 12) AS review_id, 'Composite: ' || printf('%.4f', composite) AS opinion FROM vd)
SELECT ad.repo_id, review_id, opinion, 'What about ' || id || '?' AS question, id AS target, 'commit_anomaly' AS type, summary FROM ad JOIN fc USING (repo_id)
UNION ALL SELECT repo_id, review_id, opinion, 'Who wrote it?', 'general', NULL, NULL FROM ad""")
def advice_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opinion and questions of a chat for every user, each question with the evidence it aims at."""
    facts = staging.staged(_facts(spark, sf_dir), "facts")
    told = advisory.advised(advisory.contexts(catalog._scored(spark, sf_dir), facts), _plain_chat)
    asked = told.select("repo_id", F.col("ai_opinion.review_id").alias("review_id"), F.col("ai_opinion.summary").alias("opinion"), F.inline("interview_probes"))
    return advisory.probe_evidence(asked, facts).select("repo_id", "review_id", "opinion", "question", "target", "type", "summary")


@_query("""SELECT user_id::VARCHAR AS id, max((ts, event_type))[2] AS status, max(ts) AS updated_at, count(*) AS states FROM events GROUP BY 1""")
def jobs_written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log written in two goes, set up again in between, and the last state of each job."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("status"), F.lit("u").alias("repo_url"), F.lit("{}").alias("result_json"), F.col("ts").cast("timestamp").alias("created_at"), F.col("ts").cast("timestamp").alias("updated_at"))
    path = f"{staging.scratch_root(spark)}/tracewell/jobs-{uuid.uuid4().hex}"
    staging.keep(spark, path)
    jobs.record(rows.where(e["event_id"] % 2 == 0), path)
    jobs.record(rows.where(e["event_id"] % 2 == 1), path)
    log = jobs.init(spark, path)
    states = log.groupBy("id").agg(F.count("*").alias("states"))
    return jobs.latest(log).join(states, "id").select("id", "status", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"), "states")


@_query("SELECT doc_id, CASE WHEN quality = 1 THEN 'verified' ELSE 'unverified' END AS status FROM labels WHERE doc_id % 3 = 1")
def claims_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("tech_stack", "feature", "setup_env"))), (F.col("doc_id") % 3 + 1).cast("int"))
    claims = table(spark, sf_dir, "labels").select("doc_id", kind.alias("claim_type"), F.when(F.col("quality") == 1, "verified").otherwise("unverified").alias("status"))
    return analysis.claims_of(claims, "feature").select("doc_id", "status")


_GIVEN = _EACH.split("\npp AS MATERIALIZED")[0].replace("(SELECT lp.id AS a, rp.id AS b, i, j FROM lp JOIN rp USING (w))", "(SELECT lp.id AS a, rp.id AS b, i, j FROM lp JOIN rp ON rp.w = lp.w AND rp.id = lp.id % 40)").rstrip(", \n")


@_query(f"{_GIVEN} SELECT doc_id, item_id, coalesce(logic, 0) AS logic FROM (SELECT doc_id, item_id FROM documents JOIN benchmark ON item_id = doc_id % 40) LEFT JOIN lo ON a = doc_id AND b = item_id")
def given_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logic of each document and the item of its number, whether they have anything in common or not."""
    l, r = catalog._tokens(spark, sf_dir, "documents", "doc_id"), catalog._tokens(spark, sf_dir, "benchmark", "item_id")  # noqa: E741
    pairs = l.select(F.col("id").alias("a"), (F.col("id") % 40).alias("b"))
    return similarity.compared(l, r, pairs=pairs).select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "logic")


@_query(f"""WITH m AS (SELECT user_id AS repo_id, event_type || '/v1.' || event_type AS slug, least(1.0, count(*) * 4.0 / sum(count(*)) OVER (PARTITION BY user_id)) AS s FROM events GROUP BY 1, event_type),
o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY {_R4.format("s")} DESC, slug) AS n FROM m)
SELECT repo_id, 'clone_' || replace(slug, '/', '_') AS id, {_R4.format("s")} AS confidence FROM o WHERE n = 1 AND {_R4.format("s")} >= 0.3""")
def evidence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of evidence about candidates whose names have slashes and dots."""
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("repo_id"), "event_type").agg(F.count("*").alias("n"))
    total = e.groupBy("repo_id").agg(F.sum("n").alias("all"))
    score = round4(F.least(F.lit(1.0), F.col("n") * 4.0 / F.col("all")))
    m = e.join(total, "repo_id").select("repo_id", F.concat("event_type", F.lit("/v1."), "event_type").alias("slug"), score.alias("logic_similarity"), score.alias("structural_similarity"), F.lit("unclear_direction").alias("direction_confidence"), score.alias("score"))
    none = m.limit(0).select("repo_id", "slug", F.lit("").alias("path"), F.lit("").alias("other"), F.lit(0.0).alias("logic"), F.array(F.lit(0), F.lit(0)).alias("span"))
    return evidence.of_clones(m, none).select("repo_id", "id", "confidence")


@_query("""WITH c AS (SELECT source AS slug, CASE WHEN length(source) % 2 = 0 THEN TIMESTAMP '2020-01-01' END AS known FROM documents GROUP BY 1),
f AS (SELECT 'src' || (user_id % 20) AS slug, min(ts) AS first FROM events GROUP BY 1)
SELECT slug, coalesce(known, first) AS created_at, count(*) AS files, count(DISTINCT CASE WHEN doc_id % 4 = 1 THEN 'python' WHEN doc_id % 4 = 2 THEN 'go' END) AS languages FROM documents JOIN c ON slug = source LEFT JOIN f USING (slug) WHERE doc_id % 4 IN (1, 2) AND octet_length(encode(text)) <= 1048576 GROUP BY 1, 2""")
def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates read from files of which half are excluded by path, with a date that is known or that of the first commit."""
    d = table(spark, sf_dir, "documents")
    path = F.concat(F.element_at(F.array(*map(F.lit, ("tests/t", "src/a", "b", "vendor/c"))), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id"), F.element_at(F.array(*map(F.lit, (".py", ".py", ".go", ".go"))), (F.col("doc_id") % 4 + 1).cast("int")))
    contents = d.select(F.col("source").alias("repo_id"), path.alias("path"), F.octet_length("text").cast("long").alias("length"), F.encode("text", "utf-8").alias("content"))
    about = d.select(F.col("source").alias("repo_id"), F.col("source").alias("slug"), F.lit("").alias("owner"), F.when(F.length("source") % 2 == 0, F.lit("2020-01-01").cast("timestamp")).alias("created_at")).distinct()
    commits = table(spark, sf_dir, "events").select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("repo_id"), F.col("ts").cast("timestamp").alias("ts"))
    files = analysis.candidate_files(contents, about, commits)
    return files.groupBy("slug", F.col("created_at").cast("timestamp_ntz").alias("created_at")).agg(F.count("*").alias("files"), F.countDistinct("language").alias("languages"))
