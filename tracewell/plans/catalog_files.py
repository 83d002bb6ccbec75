"""Queries of files, READMEs and advice: the driver's rows dressed as files, with SQL that knows how they were dressed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import analysis
from ..functions import paths, pycode
from ..operators import advisory, clone, evidence, forensics, ingest, minhash, readme, retrieval
from . import catalog
from .catalog import _R4, _READ, _STOPSQL, _query, _readmes, table


def _pick(values: list[str], by: str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(by) % len(values) + 1).cast("int"))


def _pick_sql(values: list[str], by: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}][{by} % {len(values)} + 1])"


# Claims of READMEs: pages with a line at each closing tag, see catalog.
_PARTS = catalog._PARTS
_TERM_COUNT = f"len(list_distinct([y FOR y IN flatten([CASE WHEN len({_PARTS}) > 1 THEN list_prepend(lower(x), [lower(p) FOR p IN {_PARTS}]) ELSE [lower(x)] END FOR x IN regexp_extract_all(claim, '[A-Za-z][A-Za-z0-9_]*|[0-9]+')]) IF length(y) >= 2 AND y NOT IN {_STOPSQL}]))"
_CLEAN = "trim(regexp_replace(regexp_replace(regexp_replace({}, '`([^`]*)`', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"
_VERB = "(the|that|der)"
_VERB_SQL = "(^|[^A-Za-z0-9_])(?i:the|that|der)($|[^A-Za-z0-9_])"


@_query(f"""WITH {_READ}, c AS (SELECT repo_id, i, CASE WHEN regexp_extract(l, '^[ \\t]*[-*+][ \\t]+(.+?)[ \\t]*$', 1) <> '' THEN {_CLEAN.format("regexp_extract(l, '^[ \\t]*[-*+][ \\t]+(.+?)[ \\t]*$', 1)")} WHEN regexp_matches(l, '{_VERB_SQL}') THEN {_CLEAN.format("l")} END AS claim FROM un WHERE NOT regexp_matches(l, '^[ \\t]*#{{1,6}}[ \\t]')),
k AS (SELECT repo_id, min(i) AS i, arg_min(claim, i) AS claim FROM c WHERE length(claim) >= 4 AND {_TERM_COUNT} >= 2 GROUP BY repo_id, lower(claim)),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY i) AS ordinal FROM k)
SELECT repo_id, i::BIGINT AS line_no, claim, ordinal FROM n WHERE ordinal <= 12""")
def feature_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readme.feature_claims(_readmes(spark, sf_dir), rf"(?i)(?<![A-Za-z0-9_]){_VERB}(?![A-Za-z0-9_])")
    return out.select("repo_id", F.col("line_no").cast("long").alias("line_no"), "claim", F.col("ordinal").cast("long").alias("ordinal"))


@_query(f"""WITH {_READ}, c AS (SELECT repo_id, i, {_CLEAN.format("trim(regexp_replace(regexp_replace(l, '^[$ ]+', ''), '^`+|`+$', '', 'g'))")} AS claim FROM rl WHERE regexp_matches(l, '^</(h1|p)>')),
k AS (SELECT repo_id, min(i) AS i, arg_min(claim, i) AS claim FROM c WHERE claim <> '' GROUP BY repo_id, lower(claim)),
n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY i) AS ordinal FROM k)
SELECT repo_id, i::BIGINT AS line_no, claim, ordinal FROM n WHERE ordinal <= 8""")
def setup_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readme.setup_claims(_readmes(spark, sf_dir), "^</(h1|p)>")
    return out.select("repo_id", F.col("line_no").cast("long").alias("line_no"), "claim", F.col("ordinal").cast("long").alias("ordinal"))


# Files of repositories: customers as Python modules that import two others by number, one of them through a package.
_N = "n AS (SELECT count(*) AS n FROM customer)"
_EDGES = f"""{_N}, f AS (SELECT c_custkey AS k, c_custkey % 7 AS repo_id, 'pkg/m' || c_custkey || '.py' AS path FROM customer),
e AS (SELECT DISTINCT a.repo_id, a.path AS importer, b.path FROM f a CROSS JOIN n JOIN f b ON b.repo_id = a.repo_id AND b.k IN ((a.k * 3) % n.n + 1, (a.k + 7) % n.n + 1) WHERE a.path <> b.path)"""


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    n = c.agg(F.count("*").alias("n"))
    text = F.format_string("import os\nimport pkg.m%d\nfrom pkg.m%d import run\n", F.col("k") * 3 % F.col("n") + 1, (F.col("k") + 7) % F.col("n") + 1)
    return c.join(F.broadcast(n)).select((F.col("k") % 7).alias("repo_id"), F.concat(F.lit("pkg/m"), "k", F.lit(".py")).alias("path"), text.alias("text"))


@_query(f"WITH {_EDGES} SELECT repo_id, importer, path FROM e")
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.import_edges(_modules(spark, sf_dir))


@_query(f"WITH {_EDGES}, t AS (SELECT repo_id, count(*) AS n FROM f GROUP BY 1), by_file AS (SELECT repo_id, path, count(DISTINCT importer) AS importers FROM e GROUP BY 1, 2) SELECT repo_id, path, {_R4.format('coalesce(importers, 0) / greatest(t.n - 1, 1)')} AS import_centrality FROM f JOIN t USING (repo_id) LEFT JOIN by_file USING (repo_id, path)")
def import_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.centrality(_modules(spark, sf_dir))


@_query(f"WITH {_N} SELECT c_custkey % 7 AS repo_id, 'pkg/m' || c_custkey || '.py' AS path, unnest(['os', 'pkg']) AS root FROM customer")
def import_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readme.import_roots(_modules(spark, sf_dir))


@_query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'a.b' || p_partkey WHEN 1 THEN 'pkg' || p_partkey END AS module FROM part")
def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = F.when(k % 4 == 0, F.concat(F.lit("a/b"), k, F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("pkg"), k, F.lit("/__init__.py"))).when(k % 4 == 2, "__init__.py").otherwise(F.concat(F.lit("x"), k, F.lit(".js")))
    return table(spark, sf_dir, "part").select("p_partkey", paths.module_name(path).alias("module"))


# Python programs of suppliers: an import, a function and a class each, whose chunks, tokens and shape are known.
def _programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string("import os\n\n\ndef f%d(x):\n    return x + %d\n\n\nclass C%d:\n    a = 1\n", F.col("s_suppkey"), F.col("s_suppkey"), F.col("s_suppkey"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), text.alias("text"))


@_query("SELECT s_suppkey AS k, unnest([{'symbol': '<module>', 'a': 1, 'z': 1}, {'symbol': 'f' || s_suppkey, 'a': 4, 'z': 5}, {'symbol': 'C' || s_suppkey, 'a': 8, 'z': 9}], recursive := true) FROM supplier".replace("'a':", "'start_line':").replace("'z':", "'end_line':"))
def python_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _programs(spark, sf_dir).select("k", F.explode(pycode.python_chunks("text")).alias("c"))
    return c.select("k", F.coalesce("c.symbol", F.lit("")).alias("symbol"), F.col("c.start_line").cast("int").alias("start_line"), F.col("c.end_line").cast("int").alias("end_line"))


# Contents: documents as bytes, some invalid, under paths that exclude some.
_FOLDERS, _ENDS = ["src", "vendor", "lib", "tests"], [".py", ".md", ".js", ".min.js", ".go"]
_PATH = f"{_pick_sql(_FOLDERS, 'doc_id')} || '/d' || doc_id || {_pick_sql(_ENDS, 'doc_id')}"
_WHY = "CASE WHEN doc_id % 4 = 1 THEN 'vendor' WHEN doc_id % 5 = 3 THEN 'generated' WHEN doc_id % 4 = 3 THEN 'test' WHEN doc_id % 5 = 1 THEN 'non_code' WHEN doc_id % 11 = 5 THEN 'binary' ELSE '' END"


@_query(f"WITH c AS (SELECT *, {_PATH} AS path, {_WHY} AS exclude_reason FROM documents) SELECT source AS repo_id, path, exclude_reason, exclude_reason <> '' AS excluded, CASE WHEN exclude_reason <> '' THEN 0 ELSE {catalog._LOC} END::BIGINT AS loc FROM c")
def classified_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    path = F.concat(_pick(_FOLDERS, "doc_id"), F.lit("/d"), "doc_id", _pick(_ENDS, "doc_id"))
    bytes_ = F.concat(F.col("text").cast("binary"), F.when(F.col("doc_id") % 11 == 5, F.unhex(F.lit("FF"))).otherwise(F.unhex(F.lit(""))))
    contents = d.select(F.col("source").alias("repo_id"), path.alias("path"), F.length(bytes_).cast("long").alias("length"), bytes_.alias("content"))
    return ingest.classified(contents, None).select("repo_id", "path", "exclude_reason", "excluded", "loc")


_NAMES = list(ingest.READMES)


@_query(f"SELECT page_id % 50 AS repo_id, arg_min(html, page_id % 5) AS readme_text FROM (SELECT *, page_id % 5 AS p FROM pages QUALIFY row_number() OVER (PARTITION BY page_id % 50, page_id % 5 ORDER BY page_id) = 1) GROUP BY 1")
def readme_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").groupBy((F.col("page_id") % 50).alias("repo_id"), (F.col("page_id") % 5).alias("o")).agg(F.min_by("html", "page_id").alias("html"))
    return ingest.readme(p.select("repo_id", _pick(_NAMES, "o").alias("path"), F.col("html").cast("binary").alias("content")))


@_query("SELECT page_id % 50 AS repo_id, e AS ecosystem FROM pages, (SELECT unnest(['python', 'node']) AS e) WHERE (e = 'python' AND page_id % 6 IN (0, 2)) OR (e = 'node' AND page_id % 6 = 4) GROUP BY 1, 2")
def ecosystems(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _pick(["a/x.py", "notes.md", "deep/Requirements.txt", "x.rs", "web/package.json", "y.go"], "page_id")
    return readme.ecosystems(table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("repo_id"), path.alias("path")))


@_query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'n' || c_custkey ELSE 'o' || (c_custkey % 5) || '/n' || c_custkey END AS slug FROM customer")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", paths.slug(F.when(k % 3 != 0, F.concat(F.lit("o"), k % 5)), F.concat(F.lit("n"), k)).alias("slug"))


_OWNERS = "CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'o' || (s_suppkey % 4) END"


@_query(f"WITH s AS (SELECT s_suppkey AS k, {_OWNERS} AS o FROM supplier) SELECT a.k AS repo_id, b.k AS slug, CASE WHEN a.k = b.k THEN 'same_repository' ELSE 'same_owner' END AS reason FROM s a JOIN s b ON b.k - a.k BETWEEN 0 AND 8 WHERE a.k = b.k OR (a.o <> '' AND a.o = b.o)")
def excluded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("repo_id"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("o"), k % 4)).alias("owner"))
    pairs = s.select("repo_id", F.explode(F.sequence(F.lit(0), F.lit(8))).alias("d")).select("repo_id", (F.col("repo_id") + F.col("d")).alias("slug"))
    return clone.excluded(s, s.withColumnRenamed("repo_id", "slug"), pairs)


@_query(f"{catalog._SIGNALS} SELECT repo_id, 'rev_' || substr(sha1(repo_id || '|' || verdict || '|' || printf('%.4f', composite)), 1, 12) AS review_id FROM vd")
def review_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = catalog._scored(spark, sf_dir)
    return s.select("repo_id", advisory.review_id(F.col("repo_id").cast("string"), F.col("verdict"), F.col("composite")).alias("review_id"))


@_query("SELECT event_id AS repo_id, x.question, x.target FROM events, (SELECT unnest([{'n': 0, 'target': 'clone_a'}, {'n': 1, 'target': 'general'}]) AS y), LATERAL (SELECT event_type || '?' || y.n AS question, y.target AS target) x WHERE event_type <> 'error'")
def probe_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    asked = F.when(F.col("event_type") == "error", F.lit('{"probes": [{"question": "  "}, {"other": 1}]}')).otherwise(F.format_string('{"probes": [{"question": "%s?0", "targets": "clone_a"}, {"question": "%s?1"}, {"question": ""}]}', "event_type", "event_type"))
    return advisory.probes(e.select(F.col("event_id").alias("repo_id"), asked.alias("answer")))


@_query("SELECT CASE WHEN doc_id % 2 = 0 THEN 'feature' ELSE 'tech_stack' END AS claim_type, CASE WHEN quality = 1 THEN 'verified' ELSE 'unverified' END AS status, count(*) AS n FROM labels GROUP BY 1, 2")
def claim_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = table(spark, sf_dir, "labels").select(F.when(F.col("doc_id") % 2 == 0, "feature").otherwise("tech_stack").alias("claim_type"), F.when(F.col("quality") == 1, "verified").otherwise("unverified").alias("status"))
    return analysis.claim_counts(claims)


@_query(f"{catalog._SIGNALS} SELECT repo_id, CASE WHEN composite >= 0.65 THEN 'red' WHEN composite >= 0.45 THEN 'amber' WHEN composite >= 0.2 THEN 'yellow' ELSE 'emerald' END AS band FROM vd")
def suspicion_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog._scored(spark, sf_dir).select("repo_id", analysis.band(F.col("composite")).alias("band"))


@_query("SELECT user_id AS repo_id, CASE WHEN user_id % 2 = 0 THEN min(ts) ELSE TIMESTAMP '2020-01-01' END AS created_at FROM events GROUP BY user_id")
def creation_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("repo_id"), "ts")
    known = F.when(F.col("repo_id") % 2 == 1, F.lit("2020-01-01").cast("timestamp_ntz")).cast(e.schema["ts"].dataType)
    return ingest.created_at(e.select("repo_id").distinct().withColumn("created_at", known), e)


@_query("SELECT count(DISTINCT source) AS submissions FROM documents")
def registry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.registered(table(spark, sf_dir, "documents").select(F.col("source").alias("slug")).distinct())


@_query("SELECT user_id AS repo_id, string_agg(substr(md5(event_id::VARCHAR), 1, 7), ',' ORDER BY strftime(ts, '%Y-%m-%dT%H:%M:%SZ'), substr(md5(event_id::VARCHAR), 1, 7)) AS shas FROM events GROUP BY 1")
def timeline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("repo_id"), F.md5(F.col("event_id").cast("string").cast("binary")).alias("sha"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("message"), F.lit(1).alias("additions"), F.lit(0).alias("deletions"))
    listed = analysis._listed(analysis.timeline(c), "t", ["ts", "sha"], ["sha", "ts"])
    return listed.select("repo_id", F.array_join(F.transform("t", lambda x: x["sha"]), ",").alias("shas"))


_SHOWN = "SELECT repo_id::VARCHAR AS repo_id, {place}::INT AS place, {id} AS id, '{type}' AS type, '{feeds}' AS feeds, {confidence} AS confidence FROM"
_PART_SQL = " UNION ALL ".join(f"SELECT repo_id, commit_count, '{name}' AS part, {c} AS v FROM fo" for c, name, _ in evidence.PARTS)


@_query(f"""{_SHOWN.format(place=0, id="'clone_' || slug", type="clone_match", feeds="clone_similarity", confidence="score")} ({catalog._MATCH} SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, slug) AS n FROM ms) WHERE n = 1 AND score >= 0.3
UNION ALL {_SHOWN.format(place=1, id="'readme_' || tech", type="readme_contradiction", feeds="readme_consistency", confidence="0.7::DOUBLE")} ({catalog._CLAIMS} SELECT * FROM st) WHERE status = 'contradicted'
UNION ALL {_SHOWN.format(place=2, id="'commit_' || part", type="commit_anomaly", feeds="commit_forensics", confidence=_R4.format("least(1.0, commit_count / 10.0::DOUBLE)"))} (WITH {catalog._FORENSICS} SELECT * FROM ({_PART_SQL})) WHERE v >= 0.4
UNION ALL {_SHOWN.format(place=3, id="'registry_' || other", type="registry_match", feeds="registry_match", confidence="jaccard")} ({catalog._NEAR} SELECT slug AS repo_id, other, jaccard FROM j) WHERE jaccard >= 0.5""")
def evidence_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of all four signals in one table."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo_id"), F.col("doc_id").alias("path"), "text")
    bench = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("bench"), F.col("item_id") % 5).alias("slug"), F.col("item_id").alias("path"), "text")
    best = catalog._best(spark, sf_dir)
    matched = evidence.matched_files(best, docs, bench)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("repo_id"), F.lit("page.html").alias("path"), F.col("html").alias("text"))
    s = catalog._submissions(spark, sf_dir)
    parts = [
        evidence.of_clones(catalog._matches(spark, sf_dir, best), matched),
        evidence.of_readmes(catalog._tech(spark, sf_dir), readme.vocabulary(spark, catalog._WORDS), pages),
        evidence.of_commits(forensics.forensics(catalog._commits(spark, sf_dir, "hour"))),
        evidence.of_registry(s, s),
    ]
    all_ = evidence.union(*[p.withColumn("repo_id", F.col("repo_id").cast("string")) for p in parts])
    return all_.select("repo_id", "place", "id", "type", "feeds", "confidence")


_LINES_SQL = "string_split(regexp_replace(text, '\\n$', ''), chr(10))"


@_query(f"""WITH l AS (SELECT source AS repo_id, doc_id, ({_LINES_SQL})[1:2000] AS ls FROM documents WHERE doc_id % 2 = 0), r AS (SELECT doc_id, ({_LINES_SQL})[1:2000] AS ls FROM documents WHERE doc_id % 2 = 1),
lp AS (SELECT doc_id AS a, unnest(ls) AS w, generate_subscripts(ls, 1) AS i FROM l), rp AS (SELECT doc_id AS b, unnest(ls) AS w, generate_subscripts(ls, 1) AS j FROM r),
m AS (SELECT a, b, i, j, i - row_number() OVER (PARTITION BY a, b, i - j ORDER BY i) AS g FROM lp JOIN rp ON rp.w = lp.w AND b = a + 1),
k AS (SELECT a, b, count(*) AS n, min(i) AS i, min(j) AS j FROM m GROUP BY a, b, i - j, g)
SELECT a AS doc_id, arg_min(i, (-n, i, j))::BIGINT AS first_line, (arg_min(i, (-n, i, j)) + max(n) - 1)::BIGINT AS last_line FROM k GROUP BY a""")
def matched_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest block of lines that each even document shares with the next one."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    mine, theirs = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    files = lambda x, name: x.select(F.lit("r").alias(name), F.col("doc_id").alias("path"), "text")
    best = mine.select(F.lit("r").alias("repo_id"), F.lit("r").alias("slug"), F.col("doc_id").alias("path"), (F.col("doc_id") + 1).alias("other"), F.lit(1.0).alias("logic"))
    spans = evidence.matched_files(best, files(mine, "repo_id"), files(theirs, "slug"))
    return spans.where("span[0] > 0").select(F.col("path").alias("doc_id"), F.col("span")[0].cast("long").alias("first_line"), F.col("span")[1].cast("long").alias("last_line"))


@_query(f"WITH {catalog._WINDOWS} SELECT repo_id, citation, row_number() OVER (PARTITION BY repo_id ORDER BY path, start_line) AS place FROM ch")
def chunk_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.numbered(catalog._chunks(spark, sf_dir)).select("repo_id", "citation", F.col("place").cast("long").alias("place"))


# a program of each document: an import, a literal of its length, up to four functions (every second one decorated, each third document's
# with one inside), a class, and for every thirteenth document a line that can't be read
_PROGRAM = """p AS (SELECT doc_id, doc_id % 5 AS n, n_chars % 2 AS c, doc_id % 13 = 0 AS bad, doc_id % 3 = 0 AS deep FROM documents)"""


@_query(f"""WITH {_PROGRAM} SELECT doc_id, 'import' AS kind, 3::BIGINT AS n, 'os' AS first FROM p WHERE NOT bad
UNION ALL SELECT doc_id, 'chunk', 1 + n + c, '<module>' FROM p WHERE NOT bad
UNION ALL SELECT doc_id, 'shape', 9 + n * 6 + (n // 2) * 2 + CASE WHEN deep THEN n * 3 ELSE 0 END + c * 2, 'Module' FROM p WHERE NOT bad
UNION ALL SELECT doc_id, 'token', CASE WHEN bad THEN 2 ELSE 9 + n * 8 + (n // 2) * 2 + CASE WHEN deep THEN n * 6 ELSE 0 END + c * 4 END, CASE WHEN bad THEN 'def' ELSE 'import' END FROM p""")
def python_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many chunks, imports, tokens and nodes each program has, and the first of each: one parse a program, by a lateral table function."""
    pycode.register(spark)
    programs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        """if(doc_id % 13 = 0, 'def (', concat('import os\nfrom m import x\nX = ', n_chars, '\n', array_join(transform(sequence(0, 4), i -> if(i < doc_id % 5,
        concat(if(i % 2 = 1, '@d\n', ''), 'def f', i, '(a):\n', if(doc_id % 3 = 0, '    def g():\n        return\n', ''), '    return a\n'), '')), ''),
        if(n_chars % 2 = 1, 'class C: pass\n', ''))) as text""",
    )
    programs.createOrReplaceTempView("tracewell_programs")
    rows = spark.sql("select doc_id, t.* from tracewell_programs, lateral python_facts(text, 'chunk,import,token,shape') t")
    return rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.min_by("value", "place").alias("first"))
