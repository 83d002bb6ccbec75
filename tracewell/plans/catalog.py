"""Every query of the engine by name, and the SQL that states it.

The driver's tables stand in for repositories: documents for files (source for the repository), benchmark for candidate files,
events for commits (user_id for the repository), pages for README and addresses, labels for known outcomes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import count_loc, round4, shingles, word_tokens
from ..operators import asof, clone, evaluation, evidence, forensics, ingest, jobs, minhash, readme, retrieval, scoring, setjoin, similarity
from ..sources.staging import staged
from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


# Pieces of SQL that several statements share.
_R4 = "floor(({})::DOUBLE * 10000 + 0.5::DOUBLE) / 10000.0::DOUBLE"
_LINES = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"
_LOC = f"CASE WHEN text = '' THEN 0 ELSE len([x FOR x IN {_LINES} IF regexp_matches(x, '[^ \\t\\r\\n\\f\\v]')]) END"
_FILES = f"files AS (SELECT source AS repo_id, doc_id, {_LOC} AS loc FROM documents)"
_RANKED = f"""WITH {_FILES}, s AS (SELECT *, {_R4.format("0.6::DOUBLE * loc / greatest(max(loc) OVER (PARTITION BY repo_id), 1)")} AS score FROM files),
ranked AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, doc_id) AS rn FROM s)"""
_COVER = "cover AS (SELECT repo_id, sum(loc)::BIGINT AS total_loc, sum(CASE WHEN rn <= 40 THEN loc ELSE 0 END)::BIGINT AS compared_loc FROM ranked GROUP BY 1)"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo_id"), F.col("doc_id").alias("path"), count_loc(F.col("text")).alias("loc"), F.lit(False).alias("excluded"), F.lit(0.0).alias("import_centrality"))


@_query(f"WITH {_FILES} SELECT repo_id, count(*) AS files, sum(loc)::BIGINT AS total_loc FROM files GROUP BY 1")
def loc_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir).groupBy("repo_id").agg(F.count("*").alias("files"), F.sum("loc").alias("total_loc"))


@_query(f"{_RANKED} SELECT repo_id, doc_id, loc, score, rn AS significance_rank FROM ranked WHERE rn <= 40")
def significance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ingest.ranked(_files(spark, sf_dir)).where("significance_rank > 0")
    return r.select("repo_id", F.col("path").alias("doc_id"), "loc", F.col("significance_score").alias("score"), F.col("significance_rank").cast("long").alias("significance_rank"))


@_query(f"{_RANKED}, {_COVER} SELECT *, {_R4.format('CASE WHEN total_loc = 0 THEN 0 ELSE compared_loc / total_loc END')} AS coverage_ratio FROM cover")
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.coverage(ingest.ranked(_files(spark, sf_dir)))


_TOK = "[lower(x) FOR x IN regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]*')]"
_GRAM = "CASE WHEN len({t}) = 0 THEN [] WHEN len({t}) < {n} THEN [array_to_string({t}, ' ')] ELSE list_distinct([array_to_string({t}[i:i + {m}], ' ') FOR i IN range(1, len({t}) - {m} + 1)]) END"


def _grams_sql(n: int, t: str = "t") -> str:
    return _GRAM.format(t=t, n=n, m=n - 1)


@_query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)")
def word_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", word_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@_query(f"SELECT doc_id, len({_grams_sql(5)}) AS n_shingles FROM (SELECT doc_id, {_TOK.format('text')} AS t FROM documents)")
def shingle_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(shingles(F.col("text"))).cast("long").alias("n_shingles"))


_SIG = f"""WITH h AS (SELECT doc_id, source, ('0x' || substr(md5(g), 1, 8))::BIGINT AS h FROM (SELECT doc_id, source,
unnest(CASE WHEN len(g) = 0 THEN [''] ELSE g END) AS g FROM (SELECT doc_id, source, {_grams_sql(5)} AS g FROM (SELECT doc_id, source, {_TOK.format("text")} AS t FROM documents)))),
perms AS (SELECT p, ((p * 40503 + 1) * 48271) % 2147483647 AS a, ((p * 69621 + 7) * 16807) % 2147483647 AS b FROM (SELECT unnest(range(128)) AS p))"""


@_query(f"{_SIG} SELECT doc_id, p AS perm, min((a * h + b) % 4294967291) AS value FROM h CROSS JOIN perms GROUP BY 1, 2")
def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = minhash.minima(table(spark, sf_dir, "documents"), ["doc_id"])
    return m.select("doc_id", F.posexplode("signature").alias("perm", "value")).withColumn("perm", F.col("perm").cast("long"))


_NEAR = f"""{_SIG}, sig AS (SELECT source, p, min((a * h + b) % 4294967291) AS m FROM h CROSS JOIN perms GROUP BY 1, 2),
j AS (SELECT x.source AS slug, y.source AS other, {_R4.format("sum(CASE WHEN x.m = y.m THEN 1 ELSE 0 END) / 128.0")} AS jaccard FROM sig x JOIN sig y ON x.p = y.p AND x.source <> y.source GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY jaccard DESC, other) AS rank FROM j)"""


def _submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = minhash.minima(table(spark, sf_dir, "documents"), ["source"])
    return staged(minhash.merged(m, "source").select(F.col("source").alias("slug"), F.lit("").alias("owner"), "signature"), "submissions")


@_query(f"{_NEAR} SELECT * FROM r WHERE rank <= 5")
def registry_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _submissions(spark, sf_dir)
    return minhash.nearest(s, s).withColumn("rank", F.col("rank").cast("long"))


@_query(f"{_NEAR} SELECT slug, jaccard AS registry_match FROM r WHERE rank = 1")
def registry_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _submissions(spark, sf_dir)
    return minhash.registry_match(s, s)


# documents as submissions in order of their ids, sources as owners
@_query(f"""{_SIG}, sig AS (SELECT doc_id, source, p, min((a * h + b) % 4294967291) AS m FROM h CROSS JOIN perms GROUP BY 1, 2, 3),
j AS (SELECT x.doc_id, y.doc_id AS prior_id, {_R4.format("count(*) / 128.0")} AS jaccard FROM sig x JOIN sig y ON x.p = y.p AND x.m = y.m AND y.doc_id < x.doc_id AND x.source <> y.source GROUP BY 1, 2)
SELECT doc_id, prior_id, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY jaccard DESC, prior_id) AS o FROM j WHERE jaccard >= 0.5) WHERE o = 1""")
def registry_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likest submission before each, of another owner, where they overlap by half."""
    docs = table(spark, sf_dir, "documents")
    s = minhash.minima(docs, ["doc_id", "source"]).select(F.col("doc_id").alias("slug"), F.col("source").alias("owner"), F.col("doc_id").alias("at"), "signature")
    return minhash.prior(s, least=evidence.REGISTRY).select(F.col("slug").alias("doc_id"), F.col("other").alias("prior_id"), "jaccard")


@_query("""SELECT e.event_id, max((v.ts, v.event_id))[2] AS prior_id FROM events e LEFT JOIN events v ON v.event_type = 'view' AND v.user_id = e.user_id AND (v.ts, v.event_id) < (e.ts, e.event_id) WHERE e.event_type = 'error' GROUP BY 1""")
def prior_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest view of its user before each error."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    found = asof.latest_before(e.where("event_type = 'error'"), e.where("event_type = 'view'"), ["user_id"], "ts", ties=["event_id"])
    return found.select("event_id", F.col("prior.event_id").alias("prior_id"))


def _tokens(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("id"), word_tokens(F.col("text")).alias("tokens"))


_SIDES = f"""l AS (SELECT doc_id AS id, {_TOK.format("text")} AS t FROM documents), r AS (SELECT item_id AS id, {_TOK.format("text")} AS t FROM benchmark)"""


def _jac_sql(n: int) -> str:
    return f"""l{n} AS (SELECT id, unnest({_grams_sql(n)}) AS g FROM l), r{n} AS (SELECT id, unnest({_grams_sql(n)}) AS g FROM r),
c{n} AS (SELECT l{n}.id AS a, r{n}.id AS b, count(*) AS both_n FROM l{n} JOIN r{n} USING (g) GROUP BY 1, 2),
j{n} AS (SELECT a, b, both_n, both_n / (x.n + y.n - both_n) AS jaccard FROM c{n} JOIN (SELECT id, count(*) AS n FROM l{n} GROUP BY 1) x ON x.id = a JOIN (SELECT id, count(*) AS n FROM r{n} GROUP BY 1) y ON y.id = b)"""


@_query(f"WITH {_SIDES}, {_jac_sql(3)} SELECT a AS doc_id, b AS item_id, both_n AS shared, {_R4.format('jaccard')} AS jaccard FROM j3")
def ngram_jaccard_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = similarity.pairs_by_gram(_tokens(spark, sf_dir, "documents", "doc_id"), _tokens(spark, sf_dir, "benchmark", "item_id"), 3)
    return j.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), F.col("both").alias("shared"), round4(F.col("jaccard")).alias("jaccard"))


_MULTI = """lt AS (SELECT id, t AS w, count(*) AS n FROM (SELECT id, unnest(t) AS t FROM l) GROUP BY 1, 2), rt AS (SELECT id, t AS w, count(*) AS n FROM (SELECT id, unnest(t) AS t FROM r) GROUP BY 1, 2),
low AS (SELECT a, b, sum(least(lt.n, rt.n)) AS low FROM j5 JOIN lt ON lt.id = a JOIN rt ON rt.id = b AND rt.w = lt.w GROUP BY 1, 2),
multi AS (SELECT j5.a, j5.b, coalesce(low, 0) / (len(l.t) + len(r.t) - coalesce(low, 0)) AS multiset FROM j5 LEFT JOIN low USING (a, b) JOIN l ON l.id = a JOIN r ON r.id = b)"""


@_query(f"WITH {_SIDES}, {_jac_sql(5)}, {_MULTI} SELECT a AS doc_id, b AS item_id, {_R4.format('multiset')} AS multiset FROM multi")
def multiset_overlap_bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, r = _tokens(spark, sf_dir, "documents", "doc_id"), _tokens(spark, sf_dir, "benchmark", "item_id")  # noqa: E741
    m = similarity.multiset_overlap(similarity.pairs_by_gram(l, r, 5).select("a", "b"), l, r)
    return m.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), round4(F.col("multiset")).alias("multiset"))


_RUN = """lp AS (SELECT id, unnest(t[1:4000]) AS w, generate_subscripts(t[1:4000], 1) - 1 AS i FROM l), rp AS (SELECT id, unnest(t[1:4000]) AS w, generate_subscripts(t[1:4000], 1) - 1 AS j FROM r),
m AS (SELECT a, b, i, j, i - j AS d FROM j5 JOIN lp ON lp.id = a JOIN rp ON rp.id = b AND rp.w = lp.w),
g AS (SELECT *, i - row_number() OVER (PARTITION BY a, b, d ORDER BY i) AS g FROM m),
k AS (SELECT a, b, count(*) AS run, min(i) AS a_start, min(j) AS b_start FROM g GROUP BY a, b, d, g),
runs AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY run DESC, a_start, b_start) AS o FROM k),
best AS (SELECT runs.a, runs.b, run, a_start, b_start, run / least(len(l.t[1:4000]), len(r.t[1:4000])) AS run_ratio FROM runs JOIN l ON l.id = a JOIN r ON r.id = b WHERE o = 1)"""


@_query(f"WITH {_SIDES}, {_jac_sql(5)}, {_RUN} SELECT a AS doc_id, b AS item_id, run, a_start, b_start, {_R4.format('run_ratio')} AS run_ratio FROM best")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, r = _tokens(spark, sf_dir, "documents", "doc_id"), _tokens(spark, sf_dir, "benchmark", "item_id")  # noqa: E741
    m = similarity.longest_runs(similarity.pairs_by_gram(l, r, 5).select("a", "b"), l, r)
    return m.select(F.col("a").alias("doc_id"), F.col("b").alias("item_id"), "run", F.col("a_start").cast("long").alias("a_start"), F.col("b_start").cast("long").alias("b_start"), round4(F.col("run_ratio")).alias("run_ratio"))


_SIMILAR = f"WITH {_SIDES}, {_jac_sql(5)}, {_jac_sql(3)}, {_MULTI}, {_RUN}, sim AS (SELECT j5.a, j5.b, {_R4.format('0.6 * j5.jaccard + 0.4 * run_ratio')} AS logic, {_R4.format('0.5 * multiset + 0.5 * coalesce(j3.jaccard, 0)')} AS structural FROM j5 JOIN best USING (a, b) JOIN multi USING (a, b) LEFT JOIN j3 USING (a, b))"


def _similar(spark: SparkSession, sf_dir: str, most: int | None = similarity.MAX_TOKENS) -> DataFrame:
    return similarity.compared(_tokens(spark, sf_dir, "documents", "doc_id"), _tokens(spark, sf_dir, "benchmark", "item_id"), most=most)


@_query(f"{_SIMILAR} SELECT a AS doc_id, b AS item_id, logic, structural FROM sim")
def logic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar(spark, sf_dir).withColumnsRenamed({"a": "doc_id", "b": "item_id"})


# each with each: runs of all documents and items that have a token in common, five-grams of those that have one
_EACH = f"""WITH {_SIDES}, {_jac_sql(5)}, {_jac_sql(3)}, {_RUN.replace("j5 JOIN lp ON lp.id = a JOIN rp ON rp.id = b AND rp.w = lp.w", "(SELECT lp.id AS a, rp.id AS b, i, j FROM lp JOIN rp USING (w))")},
lo AS (SELECT best.a, best.b, {_R4.format("0.6 * coalesce(j5.jaccard, 0) + 0.4 * run_ratio")} AS logic FROM best LEFT JOIN j5 USING (a, b)),
pp AS MATERIALIZED (SELECT * FROM lo WHERE logic >= 0.3), {_MULTI.replace("j5", "pp")}
SELECT pp.a AS doc_id, pp.b AS item_id, logic, {_R4.format("0.5 * multiset + 0.5 * coalesce(j3.jaccard, 0)")} AS structural FROM pp JOIN multi USING (a, b) LEFT JOIN j3 USING (a, b)"""


@_query(_EACH)
def logic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item of logic 0.3 or more."""
    found = setjoin.similar(_tokens(spark, sf_dir, "documents", "doc_id"), _tokens(spark, sf_dir, "benchmark", "item_id"), clone.EVIDENCE)
    return found.expanded().withColumnsRenamed({"a": "doc_id", "b": "item_id"})


# candidate repositories: benchmark items by the last digit of their id; dates: the first event of a user of that number
_BEST = f"""{_SIMILAR}, rows AS (SELECT source AS repo_id, 'bench' || (b % 5) AS slug, a AS path, b AS other, logic, structural, {_LOC} AS loc FROM sim JOIN documents ON doc_id = a),
bf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_id, slug, path ORDER BY logic DESC, other) AS o FROM rows) WHERE o = 1)"""


# runs of whole texts, where the others look at the first 4,000 tokens
_BEST_WHOLE = _BEST.replace("t[1:4000]", "t")


def _best(spark: SparkSession, sf_dir: str, most: int | None = similarity.MAX_TOKENS) -> DataFrame:
    similar = staged(_similar(spark, sf_dir, most), "similar")
    # lines are counted of the documents that are in a pair
    docs = table(spark, sf_dir, "documents").join(similar.select("a").distinct(), F.col("doc_id") == F.col("a"), "left_semi")
    rows = similar.join(docs.select(F.col("doc_id").alias("a"), F.col("source").alias("repo_id"), count_loc(F.col("text")).alias("loc")), "a")
    rows = rows.select("repo_id", F.concat(F.lit("bench"), F.col("b") % 5).alias("slug"), F.col("a").alias("path"), "loc", F.col("b").alias("other"), "logic", "structural")
    return staged(clone.best_files(rows), "best")  # whoever scores it reads it several times


@_query(f"{_BEST_WHOLE} SELECT repo_id, slug, path, loc, other, logic, structural FROM bf")
def best_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, most=None)


_MATCH = f"""{_BEST}, {_FILES}, tot AS (SELECT repo_id, sum(loc)::BIGINT AS total_loc FROM files GROUP BY 1),
w AS (SELECT repo_id, slug, sum(floor(logic * 10000 + 0.5)::BIGINT * loc)::BIGINT AS w, sum(CASE WHEN logic >= 0.7 THEN loc ELSE 0 END)::BIGINT AS s FROM bf GROUP BY 1, 2),
ms AS (SELECT repo_id, slug, CASE WHEN total_loc = 0 THEN 0 ELSE {_R4.format("least(1.0, (0.7 * (w / 10000.0::DOUBLE / total_loc) + 0.3 * (s / total_loc)) * 0.85::DOUBLE)")} END AS score FROM w JOIN tot USING (repo_id))"""


def _matches(spark: SparkSession, sf_dir: str, best: DataFrame | None = None) -> DataFrame:
    best = _best(spark, sf_dir) if best is None else best
    totals = _files(spark, sf_dir).groupBy("repo_id").agg(F.sum("loc").alias("total_loc"))
    none = F.lit(None).cast("timestamp")
    dates = best.select("repo_id", "slug").distinct().select("repo_id", "slug", none.alias("target_at"), none.alias("candidate_at"))
    return clone.match_scores(best, totals, dates)


@_query(f"{_MATCH.replace(_BEST, _BEST_WHOLE)} SELECT repo_id, slug, score FROM ms")
def clone_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir, _best(spark, sf_dir, most=None)).select("repo_id", "slug", "score")


@_query(f"{_MATCH}, o AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, slug) AS n FROM ms) SELECT repo_id, score AS clone_similarity, CASE WHEN score > 0 THEN slug END AS best_slug FROM o WHERE n = 1")
def clone_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clone.clone_scores(_matches(spark, sf_dir))


# dates: a source's longest text, and a tenth of that of a third of the candidates, and equal ones
_DATED = f"""{_BEST}, {_FILES}, tot AS (SELECT repo_id, sum(loc)::BIGINT AS total_loc FROM files GROUP BY 1),
w AS (SELECT repo_id, slug, sum(floor(logic * 10000 + 0.5)::BIGINT * loc)::BIGINT AS w, sum(CASE WHEN logic >= 0.7 THEN loc ELSE 0 END)::BIGINT AS s FROM bf GROUP BY 1, 2),
dt AS (SELECT source AS repo_id, max(n_chars) AS dated FROM documents GROUP BY 1),
dw AS (SELECT *, dated + (substr(slug, 6)::INT % 3 - 1) * 60 AS other FROM w JOIN tot USING (repo_id) JOIN dt USING (repo_id))"""


@_query(f"""{_DATED} SELECT repo_id, slug, CASE WHEN other < dated THEN 'target_likely_copied' WHEN other > dated THEN 'candidate_likely_copied' ELSE 'unclear_direction' END AS direction_confidence,
CASE WHEN total_loc = 0 THEN 0 ELSE {_R4.format("least(1.0, (0.7 * (w / 10000.0::DOUBLE / total_loc) + 0.3 * (s / total_loc)) * CASE WHEN other < dated THEN 1.0 WHEN other > dated THEN 0.35 ELSE 0.85 END::DOUBLE)")} END AS score FROM dw""")
def directed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with dates of which all three directions follow."""
    best = _best(spark, sf_dir)
    totals = _files(spark, sf_dir).groupBy("repo_id").agg(F.sum("loc").alias("total_loc"))
    at = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("repo_id")).agg(F.timestamp_seconds(F.max("n_chars")).alias("target_at"))
    dates = best.select("repo_id", "slug").distinct().join(at, "repo_id")
    dates = dates.withColumn("candidate_at", F.timestamp_seconds(F.unix_seconds("target_at") + (F.substring("slug", 6, 9).cast("int") % 3 - 1) * 60))
    return clone.match_scores(best, totals, dates).select("repo_id", "slug", "direction_confidence", "score")


_FIRST = "f AS (SELECT user_id, min(ts) AS t FROM events GROUP BY 1)"


@_query(f"WITH {_FIRST} SELECT x.user_id AS target, y.user_id AS candidate, CASE WHEN y.t < x.t THEN 'target_likely_copied' WHEN y.t > x.t THEN 'candidate_likely_copied' ELSE 'unclear_direction' END AS direction FROM f x JOIN f y ON x.user_id + 1 = y.user_id")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").alias("t"))
    x, y = f.select(F.col("user_id").alias("target"), F.col("t").alias("tx")), f.select(F.col("user_id").alias("candidate"), F.col("t").alias("ty"))
    return x.join(y, F.col("target") + 1 == F.col("candidate")).select("target", "candidate", clone.direction(F.col("tx"), F.col("ty")).alias("direction"))


def _commits(spark: SparkSession, sf_dir: str, grain: str | None = None) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.date_trunc(grain, F.col("ts").cast("timestamp")) if grain else F.col("ts").cast("timestamp")
    message = F.when(F.col("event_type") == "error", "fix").when(F.col("event_type") == "view", "Merge branch").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("repo_id"), ts.alias("ts"), ts.alias("local"), message.alias("message"))


_HOUR = "e AS (SELECT user_id AS repo_id, date_trunc('hour', ts) AS ts, CASE event_type WHEN 'error' THEN 'fix' WHEN 'view' THEN 'merge branch' ELSE event_type END AS m FROM events)"
_RESCALE = "CASE WHEN {x} <= {b} THEN 0.0::DOUBLE ELSE least(1.0, ({x} - {b}) / (1.0 - {b})) END"
_FIXED = f"fx AS (SELECT repo_id, CASE WHEN sum(n) < 3 THEN 0.0 ELSE {_RESCALE.format(x='(max(n) / sum(n))', b='0.25::DOUBLE')} END AS fixed_time FROM (SELECT repo_id, strftime(ts, '%H:%M:%S') AS h, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)"
_REG = """gaps AS (SELECT repo_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY repo_id ORDER BY ts)) / 1e6 AS gap FROM e),
rg AS (SELECT repo_id, CASE WHEN count(*) < 5 OR count(*) FILTER (gap > 0) < 4 THEN 0.0 ELSE greatest(0.0, least(1.0, (1.0 - stddev_pop(gap) FILTER (gap > 0) / avg(gap) FILTER (gap > 0)) / 0.8)) END AS regularity FROM gaps GROUP BY 1)"""
_MSG = "mq AS (SELECT repo_id, CASE WHEN count(k) < 3 THEN 0.0 ELSE 0.5 * count(*) FILTER (k = 'fix') / count(k) + 0.5 * (1.0 - count(DISTINCT k) / count(k)) END AS message FROM (SELECT repo_id, CASE WHEN m LIKE 'merge %' THEN NULL ELSE m END AS k FROM e) GROUP BY 1)"
_COL = f"cl AS (SELECT repo_id, CASE WHEN sum(n) < 3 THEN 0.0 ELSE {_RESCALE.format(x='(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n))', b='0.1::DOUBLE')} END AS collision FROM (SELECT repo_id, ts, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1)"


@_query(f"WITH {_HOUR}, {_FIXED} SELECT repo_id, {_R4.format('fixed_time')} AS fixed_time FROM fx")
def fixed_time_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.fixed_time(_commits(spark, sf_dir, "hour")).select("repo_id", round4(F.col("fixed_time")).alias("fixed_time"))


@_query(f"WITH {_HOUR}, {_REG} SELECT repo_id, {_R4.format('regularity')} AS regularity FROM rg")
def interval_regularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.regularity(_commits(spark, sf_dir, "hour")).select("repo_id", round4(F.col("regularity")).alias("regularity"))


@_query(f"WITH {_HOUR}, {_MSG} SELECT repo_id, {_R4.format('message')} AS message FROM mq")
def message_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.message_quality(_commits(spark, sf_dir, "hour")).select("repo_id", round4(F.col("message")).alias("message"))


@_query(f"WITH {_HOUR}, {_COL} SELECT repo_id, {_R4.format('collision')} AS collision FROM cl")
def timestamp_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.collisions(_commits(spark, sf_dir, "hour")).select("repo_id", round4(F.col("collision")).alias("collision"))


_FORENSICS = f"""{_HOUR}, {_FIXED}, {_REG}, {_MSG}, {_COL}, n AS (SELECT repo_id, count(*) AS commit_count FROM e GROUP BY 1),
fo AS (SELECT repo_id, commit_count, fixed_time, regularity, message, collision, {_R4.format("least(1.0, (0.0 + 0.30 * fixed_time + 0.30 * regularity + 0.25 * message + 0.15 * collision) * least(1.0, commit_count / 10.0::DOUBLE))")} AS commit_forensics FROM n JOIN fx USING (repo_id) JOIN rg USING (repo_id) JOIN mq USING (repo_id) JOIN cl USING (repo_id))"""


@_query(f"WITH {_FORENSICS} SELECT repo_id, commit_count, commit_forensics FROM fo")
def forensics_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forensics.forensics(_commits(spark, sf_dir, "hour")).select("repo_id", "commit_count", "commit_forensics")


@_query(f"""WITH {_FORENSICS} SELECT * FROM (SELECT repo_id, 'fixed_time' AS kind, {_R4.format("fixed_time")} AS confidence, fixed_time AS v FROM fo UNION ALL SELECT repo_id, 'regularity', {_R4.format("regularity")}, regularity FROM fo
UNION ALL SELECT repo_id, 'message', {_R4.format("message")}, message FROM fo UNION ALL SELECT repo_id, 'collision', {_R4.format("collision")}, collision FROM fo) WHERE v >= 0.4""".replace("SELECT * FROM (", "SELECT repo_id, kind, confidence FROM ("))
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = forensics.evidence(forensics.forensics(_commits(spark, sf_dir, "hour")))
    return e.select("repo_id", "kind", round4(F.col("confidence")).alias("confidence"))


# signals of a user: forensics as they are, the others from the shares of event types, so that every verdict occurs
_SIGNALS = f"""WITH {_FORENSICS}, sh AS (SELECT user_id AS repo_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 2.5::DOUBLE / count(*) AS cs, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) * 3.0::DOUBLE / count(*) AS rm, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) * 2.0::DOUBLE / count(*) AS rc, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) * 2.0::DOUBLE / count(*) AS cv FROM events GROUP BY 1),
sg AS (SELECT repo_id, least(1.0, cs) AS clone_similarity, least(1.0, rm) AS registry_match, least(1.0, rc) AS readme_consistency, commit_forensics, least(1.0, cv) AS coverage_ratio, commit_count FROM fo JOIN sh USING (repo_id)),
co AS (SELECT *, {_R4.format("(0.0 + 0.45 * clone_similarity + 0.2 * registry_match + 0.2 * readme_consistency + 0.15 * commit_forensics) / 1.0")} AS composite FROM sg),
vd AS (SELECT *, CASE WHEN clone_similarity >= 0.85 OR registry_match >= 0.9 THEN 'flagged' WHEN (coverage_ratio < 0.35 OR commit_count < 3) AND composite < 0.65 THEN 'insufficient_signal' WHEN composite >= 0.65 THEN 'flagged' WHEN composite >= 0.45 THEN 'needs_human_review' ELSE 'clean' END AS verdict FROM co)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = forensics.forensics(_commits(spark, sf_dir, "hour")).select("repo_id", "commit_count", "commit_forensics")
    share = lambda kind, by: F.least(F.lit(1.0), F.sum((F.col("event_type") == kind).cast("int")) * F.lit(by) / F.count("*"))
    s = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("repo_id")).agg(share("error", 2.5).alias("clone_similarity"), share("signup", 3.0).alias("registry_match"), share("view", 2.0).alias("readme_consistency"), share("click", 2.0).alias("coverage_ratio"))
    return scoring.scored(f.join(s, "repo_id"))


@_query(f"{_SIGNALS} SELECT repo_id, composite, verdict FROM vd")
def composite_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("repo_id", "composite", "verdict")


@_query(f"{_SIGNALS} SELECT verdict, count(*) AS n, count(*) FILTER (composite >= 0.45) AS above_review FROM vd GROUP BY 1")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("n"), F.count(F.when(F.col("composite") >= 0.45, 1)).alias("above_review"))


_STOPSQL = "('the','a','an','and','or','of','to','in','for','on','with','is','are','be','this','that','it','as','by','from','at','our','your','you','we','using','use','uses','used','via','self','def','class','return','import','if','else','true','false')"
_WINDOWS = """ln AS (SELECT source AS repo_id, doc_id::VARCHAR AS path, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents WHERE text <> ''),
win AS (SELECT repo_id, path, s + 1 AS start_line, least(s + 50, len(l)) AS end_line, array_to_string(l[s + 1:s + 50], chr(10)) AS body FROM (SELECT *, unnest(range(0, len(l), 40)) AS s FROM ln) WHERE (s = 0 OR s + 10 < len(l))),
ch AS (SELECT *, path || ':' || start_line || '-' || end_line AS citation FROM win WHERE regexp_matches(body, '[^ \\t\\r\\n\\f\\v]'))"""


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").cast("string").alias("path"), "text")
    w = retrieval.line_windows(d)
    return w.withColumn("citation", F.concat("path", F.lit(":"), "start_line", F.lit("-"), "end_line"))


@_query(f"WITH {_WINDOWS} SELECT path, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, length(body)::BIGINT AS chars FROM ch")
def line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunks(spark, sf_dir).select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.length("body").cast("long").alias("chars"))


# words and numbers, and the parts of camel and snake case where there are several: an upper-case letter before a lower-case one begins a part
_PARTS = "regexp_extract_all(regexp_replace(x, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')"
_TERMS = f"[y FOR y IN flatten([CASE WHEN len({_PARTS}) > 1 THEN list_prepend(lower(x), [lower(p) FOR p IN {_PARTS}]) ELSE [lower(x)] END FOR x IN regexp_extract_all({{}}, '[A-Za-z][A-Za-z0-9_]*|[0-9]+')]) IF length(y) >= 2 AND y NOT IN {_STOPSQL}]"


@_query(f"""WITH {_WINDOWS}, tf AS (SELECT repo_id, citation, term, count(*) AS tf FROM (SELECT repo_id, citation, unnest({_TERMS.format("body")}) AS term FROM ch) GROUP BY 1, 2, 3),
nn AS (SELECT repo_id, count(*) AS n FROM ch GROUP BY 1), idf AS (SELECT repo_id, term, ln((any_value(n) + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN nn USING (repo_id) GROUP BY 1, 2),
w AS (SELECT repo_id, citation, term, tf * idf AS w FROM tf JOIN idf USING (repo_id, term)), nm AS (SELECT repo_id, citation, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1, 2),
q AS (SELECT 'src' || (item_id % 20) AS repo_id, item_id AS query_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2, 3),
qw AS (SELECT q.repo_id, query_id, q.term, q.tf * coalesce(idf, ln(n + 1) + 1) AS w FROM q JOIN nn USING (repo_id) LEFT JOIN idf ON idf.repo_id = q.repo_id AND idf.term = q.term),
qn AS (SELECT repo_id, query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1, 2),
d AS (SELECT qw.repo_id, qw.query_id, w.citation, sum(qw.w * w.w) AS dot FROM qw JOIN w ON w.repo_id = qw.repo_id AND w.term = qw.term GROUP BY 1, 2, 3),
sc AS (SELECT d.repo_id, d.query_id, d.citation, {_R4.format("dot / (nm.norm * qn.norm)")} AS score FROM d JOIN nm USING (repo_id, citation) JOIN qn USING (repo_id, query_id))
SELECT * FROM (SELECT repo_id, query_id, citation, score, row_number() OVER (PARTITION BY repo_id, query_id ORDER BY score DESC, citation) AS rank FROM sc WHERE score > 0) WHERE rank <= 3""")
def tfidf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("src"), F.col("item_id") % 20).alias("repo_id"), F.col("item_id").alias("query_id"), "text")
    return retrieval.search(b, _chunks(spark, sf_dir), 3).withColumn("rank", F.col("rank").cast("long"))


# README: pages, a line at each closing tag; every seventh line that holds "the " opens or closes a fence
_READ = """rl AS (SELECT page_id AS repo_id, l, i FROM (SELECT page_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT page_id, string_split(regexp_replace(replace(replace(replace(html, '<li>', chr(10) || '- '), '</', chr(10) || '</'), '<div class="ad">', chr(10) || '```' || chr(10)), '\\n$', ''), chr(10)) AS ls FROM pages))),
fl AS (SELECT *, sum(CASE WHEN regexp_matches(l, '^[ \\t]*```') THEN 1 ELSE 0 END) OVER (PARTITION BY repo_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS f FROM rl),
un AS (SELECT repo_id, i, l FROM fl WHERE f % 2 = 0 AND NOT regexp_matches(l, '^[ \\t]*```'))"""


def _readmes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.replace(F.replace(F.replace("html", F.lit("<li>"), F.lit("\n- ")), F.lit("</"), F.lit("\n</")), F.lit('<div class="ad">'), F.lit("\n```\n"))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("repo_id"), h.alias("readme_text"))


@_query(f"WITH {_READ} SELECT repo_id, count(*) AS n_lines, sum(i)::BIGINT AS places FROM un GROUP BY 1")
def fence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readme.unfenced(_readmes(spark, sf_dir)).groupBy("repo_id").agg(F.count("*").alias("n_lines"), F.sum("line_no").alias("places"))


@_query("""SELECT page_id, regexp_extract(url, '^https?://([^/:]+)[/:]([^/]+)/(.+?)(\\.git)?/?$', 1) AS host, regexp_extract(url, '^https?://([^/:]+)[/:]([^/]+)/(.+?)(\\.git)?/?$', 2) AS owner, regexp_extract(url, '^https?://([^/:]+)[/:]([^/]+)/(.+?)(\\.git)?/?$', 3) AS name FROM pages
WHERE regexp_matches(url, '^https?://([^/:]+)[/:]([^/]+)/(.+?)(\\.git)?/?$')""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", paths.repo_parts(F.col("url")).alias("p")).select("page_id", "p.host", "p.owner", "p.name").where("host is not null")


# paths: a folder by page_id, a suffix by page_id
_PATHSQL = "(['src','tests','node_modules','lib','Vendor','docs'][page_id % 6 + 1] || '/f' || page_id || ['.py','.min.js','_test.go','.md','.TS','.generated.c','Test.java'][page_id % 7 + 1])"


@_query(f"""WITH p AS (SELECT page_id, {_PATHSQL} AS path FROM pages) SELECT page_id, CASE lower(regexp_extract(path, '(\\.[^./]+)$', 1)) WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.go' THEN 'go' WHEN '.ts' THEN 'typescript' WHEN '.c' THEN 'c' WHEN '.java' THEN 'java' ELSE 'unknown' END AS language,
CASE WHEN path LIKE 'node_modules/%' OR path LIKE 'Vendor/%' THEN 'vendor' WHEN path LIKE '%.min.js' OR path LIKE '%.generated.c' THEN 'generated' WHEN path LIKE 'tests/%' OR path LIKE '%\\_test.go' ESCAPE '\\' OR path LIKE '%Test.java' THEN 'test' WHEN path LIKE '%.md' THEN 'non_code' ELSE '' END AS reason FROM p""")
def path_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("page_id") % len(xs) + 1).cast("int"))
    path = F.concat(pick(["src", "tests", "node_modules", "lib", "Vendor", "docs"]), F.lit("/f"), "page_id", pick([".py", ".min.js", "_test.go", ".md", ".TS", ".generated.c", "Test.java"]))
    return p.select("page_id", paths.language(path).alias("language"), paths.exclusion(path).alias("reason"))


_WORDS = [("ing", "python", ["therehaing"]), ("able", "python", ["the"]), ("with", "node", ["zzz"]), ("eau", "python", ["qqq"]), ("that", "python", ["anthat", "hathat"])]
_VOCABSQL = "vo AS (SELECT * FROM (VALUES ('ing','python',['therehaing']),('able','python',['the']),('with','node',['zzz']),('eau','python',['qqq']),('that','python',['anthat','hathat'])) v(tech, ecosystem, tokens))"
_CLAIMS = f"""WITH {_VOCABSQL}, hay AS (SELECT d.source, lower(string_agg(d.text, ' ' ORDER BY doc_id)) AS hay FROM documents d GROUP BY 1),
cl AS (SELECT page_id AS repo_id, tech, ecosystem, tokens FROM pages JOIN vo ON regexp_matches(lower(html), '(^|[^a-z0-9_à-ÿ])' || tech || '($|[^a-z0-9_à-ÿ])')),
st AS (SELECT repo_id, tech, ecosystem, CASE WHEN len([t FOR t IN tokens IF contains(hay, t)]) > 0 THEN 'verified' WHEN ecosystem = 'python' AND repo_id % 2 = 0 THEN 'contradicted' ELSE 'unverified' END AS status FROM cl LEFT JOIN hay ON source = 'src' || (repo_id % 20))"""


def _tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("repo_id"), F.col("html").alias("readme_text"))
    vocab = readme.vocabulary(spark, _WORDS)
    hay = readme.token_haystacks(table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), "text"), vocab).withColumnRenamed("repo_id", "source")
    hays = pages.select("repo_id", F.concat(F.lit("src"), F.col("repo_id") % 20).alias("source")).join(hay, "source").select("repo_id", "haystack")
    present = pages.where("repo_id % 2 = 0").select("repo_id", F.lit("python").alias("ecosystem"))
    return readme.tech_claims(pages, hays, present, vocab)


@_query(f"{_CLAIMS} SELECT repo_id, tech, status FROM st")
def tech_vocab_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tech(spark, sf_dir).select("repo_id", "tech", "status")


@_query(f"{_CLAIMS} SELECT repo_id, count(*) FILTER (status <> 'unverified') AS verifiable, count(*) FILTER (status = 'contradicted') AS contradicted, {_R4.format('''CASE WHEN count(*) FILTER (status <> 'unverified') = 0 THEN 0 ELSE count(*) FILTER (status = 'contradicted') / count(*) FILTER (status <> 'unverified') END''')} AS readme_consistency FROM st GROUP BY 1")
def readme_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readme.consistency(_tech(spark, sf_dir))


@_query("SELECT event_id, (props->>'$.k')::INT AS k FROM events WHERE (props->>'$.k')::INT >= 50")
def json_prop_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k")).where("k >= 50")


_JOBS = "j AS (SELECT * FROM (SELECT user_id AS id, ts AS updated_at, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS n FROM events) WHERE n = 1)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("ts").alias("updated_at"), F.col("event_type").alias("status"), F.lit("{}").alias("result_json"))
    return jobs.latest(e).withColumn("created_at", F.col("updated_at"))


@_query(f"WITH {_JOBS} SELECT id, status FROM (SELECT * FROM j ORDER BY updated_at DESC, id DESC LIMIT 50) WHERE status = 'error'")
def jobs_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.listing(_jobs(spark, sf_dir), 50, "error").select("id", "status")


@_query("""SELECT user_id AS slug, coalesce(arg_min(event_type, ts) FILTER (event_id % 2 = 0), arg_min(event_type, ts)) AS owner, arg_max(event_type, ts) AS repo_url, max(ts) AS ingested_at FROM events GROUP BY 1""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("slug"), F.col("event_type").alias("owner"), F.col("event_type").alias("repo_name"), F.col("ts").alias("repo_created_at"), F.col("event_type").alias("repo_url"), F.lit(0).alias("signature"), F.col("ts").alias("ingested_at"), "event_id")
    old, new = e.where("event_id % 2 = 0").drop("event_id"), e.where("event_id % 2 = 1").drop("event_id")
    return minhash.upsert(old, new).select("slug", "owner", "repo_url", "ingested_at")


_OUT = "o AS (SELECT quality = 1 AS authentic, CASE WHEN toxic = 1 THEN 'flagged' WHEN doc_id % 7 = 0 THEN 'needs_human_review' WHEN doc_id % 11 = 0 THEN 'insufficient_signal' ELSE 'clean' END AS verdict, CASE WHEN doc_id % 3 = 0 THEN 'tuning' ELSE 'heldout' END AS split FROM labels)"


def _outcomes(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    i = F.col("doc_id")
    verdict = F.when(F.col("toxic") == 1, "flagged").when(i % 7 == 0, "needs_human_review").when(i % 11 == 0, "insufficient_signal").otherwise("clean")
    return table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("authentic"), verdict.alias("verdict"), F.when(i % 3 == 0, "tuning").otherwise("heldout").alias("split"), *more)


_DIV = "CASE WHEN {b} = 0 THEN 0 ELSE {a} / {b} END"
_PREC, _REC = _DIV.format(a="tp", b="(tp + fp)"), _DIV.format(a="tp", b="(tp + fn)")


@_query(f"""WITH {_OUT}, c AS (SELECT split, count(*) FILTER (verdict = 'flagged' AND NOT authentic) AS tp, count(*) FILTER (verdict = 'flagged' AND authentic) AS fp, count(*) FILTER (verdict <> 'flagged' AND authentic) AS tn, count(*) FILTER (verdict <> 'flagged' AND NOT authentic) AS fn FROM o GROUP BY 1),
r AS (SELECT *, {_PREC} AS p, {_REC} AS r FROM c)
SELECT split, tp, fp, tn, fn, {_R4.format("p")} AS precision, {_R4.format("r")} AS recall, {_R4.format("CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END")} AS f1, {_R4.format(_DIV.format(a="fp", b="(fp + tn)"))} AS false_positive_rate, {_R4.format(_DIV.format(a="(tp + tn)", b="(tp + fp + tn + fn)"))} AS accuracy FROM r""")
def confusion_by_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(_outcomes(spark, sf_dir), "split")


@_query(f"""WITH {_OUT.replace("FROM labels", ", 'k' || doc_id % 4 AS category FROM labels")}, c AS (SELECT split, category, grouping(split, category) AS level, count(*) FILTER (verdict = 'flagged' AND NOT authentic) AS tp, count(*) FILTER (verdict = 'flagged' AND authentic) AS fp, count(*) FILTER (verdict <> 'flagged' AND authentic) AS tn, count(*) FILTER (verdict <> 'flagged' AND NOT authentic) AS fn,
count(*) FILTER (verdict = 'needs_human_review') AS review_queue, count(*) FILTER (verdict = 'insufficient_signal') AS insufficient FROM o GROUP BY GROUPING SETS ((split, category), (split), (category), ())),
r AS (SELECT *, {_PREC} AS p, {_REC} AS r FROM c)
SELECT split, category, level, tp, fp, tn, fn, review_queue, insufficient, {_R4.format("p")} AS precision, {_R4.format("r")} AS recall, {_R4.format("CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END")} AS f1, {_R4.format(_DIV.format(a="fp", b="(fp + tn)"))} AS false_positive_rate, {_R4.format(_DIV.format(a="(tp + tn)", b="(tp + fp + tn + fn)"))} AS accuracy FROM r""")
def outcome_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.breakdown(_outcomes(spark, sf_dir, F.concat(F.lit("k"), F.col("doc_id") % 4).alias("category")), "split", "category")


@_query(f"""WITH {_OUT}, t AS (SELECT count(*) AS total, count(*) FILTER (verdict IN ('flagged','clean')) AS auto_resolved, count(*) FILTER (verdict = 'needs_human_review') AS review_queue, count(*) FILTER (verdict = 'insufficient_signal') AS insufficient, count(*) FILTER (NOT authentic) AS fakes, count(*) FILTER (NOT authentic AND verdict IN ('flagged','needs_human_review')) AS detected FROM o)
SELECT *, {_R4.format(_DIV.format(a="auto_resolved", b="total"))} AS auto_resolved_pct, {_R4.format(_DIV.format(a="review_queue", b="total"))} AS review_queue_pct, {_R4.format(_DIV.format(a="insufficient", b="total"))} AS insufficient_pct, {_R4.format(_DIV.format(a="detected", b="fakes"))} AS detection_rate,
total * 12 AS baseline_minutes, (total - review_queue) + review_queue * 4 AS tool_minutes, total * 12 - ((total - review_queue) + review_queue * 4) AS saved_minutes, {_R4.format(_DIV.format(a="(total * 12 - ((total - review_queue) + review_queue * 4))", b="(total * 12)"))} AS saved_pct FROM t""")
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.triage(_outcomes(spark, sf_dir))


@_query(f"WITH {_OUT} SELECT verdict, authentic, count(*) AS n, count(*) FILTER (CASE WHEN authentic THEN verdict <> 'flagged' ELSE verdict IN ('flagged','needs_human_review') END) AS correct FROM o GROUP BY 1, 2")
def correct_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _outcomes(spark, sf_dir)
    right = evaluation.correct(F.col("authentic"), F.col("verdict"))
    return o.groupBy("verdict", "authentic").agg(F.count("*").alias("n"), F.count(F.when(right, 1)).alias("correct"))


@_query("SELECT n_chars % 97 AS repo_id, count(*) AS rows, count(DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END) AS splits FROM documents GROUP BY 1 HAVING count(*) > 1")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select((F.col("n_chars") % 97).alias("repo_id"), F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("split"))
    return evaluation.leaks(d)


@_query("SELECT user_id AS repo_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS at, event_type AS message, (event_id % 10 + length(event_type))::BIGINT AS churn, substr(md5(event_id::VARCHAR), 1, 7) AS sha FROM events")
def timeline_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("repo_id"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"), "ts", F.col("event_type").alias("message"), (F.col("event_id") % 10).alias("additions"), F.length("event_type").alias("deletions"))
    return forensics.timeline(c)


@_query("SELECT user_id AS repo_id, greatest(1, round((epoch(max(ts)) - epoch(min(ts))) / 86400.0))::BIGINT AS span_days, count(*) AS commits FROM events GROUP BY 1")
def timeline_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("repo_id")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("commits"))
    days = F.round((F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / 86400e6)
    return e.select("repo_id", F.greatest(F.lit(1), days).cast("long").alias("span_days"), "commits")


@_query(f"{_SIGNALS} SELECT repo_id, signal, value, contribution FROM (SELECT repo_id, 'clone_similarity' AS signal, {_R4.format('clone_similarity')} AS value, {_R4.format('clone_similarity * 0.45')} AS contribution FROM vd UNION ALL SELECT repo_id, 'registry_match', {_R4.format('registry_match')}, {_R4.format('registry_match * 0.2')} FROM vd UNION ALL SELECT repo_id, 'readme_consistency', {_R4.format('readme_consistency')}, {_R4.format('readme_consistency * 0.2')} FROM vd UNION ALL SELECT repo_id, 'commit_forensics', {_R4.format('commit_forensics')}, {_R4.format('commit_forensics * 0.15')} FROM vd)")
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.contributions(_scored(spark, sf_dir)).select("repo_id", "signal", round4(F.col("value")).alias("value"), round4(F.col("contribution")).alias("contribution"))


from . import catalog_files, catalog_results  # noqa: E402,F401  their queries register themselves
