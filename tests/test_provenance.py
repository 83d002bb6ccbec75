"""Repositories by example: code relationships, histories, registry, READMEs, ingestion, scoring, evaluation."""

import datetime as dt
import difflib
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from tracewell.functions import paths, pycode, text
from tracewell.operators import clone, evaluation, forensics, ingest, jobs, minhash, readme, retrieval, scoring, similarity
from tracewell.sources import repos, sinks
from tracewell.streaming import registry as stream

ORIGINAL = '''
import heapq


def shortest_paths(graph, source):
    best = {source: 0}
    queue = [(0, source)]
    while queue:
        cost, node = heapq.heappop(queue)
        if cost > best.get(node, float("inf")):
            continue
        for other, weight in graph[node].items():
            total = cost + weight
            if total < best.get(other, float("inf")):
                best[other] = total
                heapq.heappush(queue, (total, other))
    return best


class Ledger:
    def __init__(self, name):
        self.name = name
        self.rows = []

    def post(self, amount, note=""):
        if amount == 0:
            raise ValueError("nothing to post")
        self.rows.append((amount, note))
        return sum(a for a, _ in self.rows)
'''
RENAMED = ORIGINAL.replace("shortest_paths", "route").replace("graph", "net").replace("best", "seen").replace("queue", "todo").replace("Ledger", "Book").replace("rows", "items")
REWRITTEN = '''
def relax(edges, n, start):
    dist = [None] * n
    dist[start] = 0
    for _ in range(n - 1):
        changed = False
        for a, b, w in edges:
            if dist[a] is not None and (dist[b] is None or dist[a] + w < dist[b]):
                dist[b] = dist[a] + w
                changed = True
        if not changed:
            break
    return dist


def balance(entries):
    total = 0
    for entry in entries:
        total += entry["in"] - entry["out"]
    return total
'''


def files(spark, rows):
    """(repo_id, owner, created_at, path, text) as target files."""
    df = spark.createDataFrame(rows, "repo_id string, owner string, created_at timestamp, path string, text string")
    return df.withColumn("language", paths.language(F.col("path"))).withColumn("loc", text.count_loc(F.col("text")))


def cands(df):
    return df.withColumnRenamed("repo_id", "slug")


def pair(spark, a, b):
    l, r = (spark.createDataFrame([(1, s)], "id long, s string").withColumn("tokens", pycode.logic_tokens("s")).withColumn("shape", pycode.ast_skeleton("s")) for s in (a, b))  # noqa: E741
    shape = lambda d: d.select("id", F.col("shape").alias("tokens"))
    pairs = spark.createDataFrame([(1, 1)], "a long, b long")
    return similarity.compared(l, r, shape(l), shape(r), pairs).first()


def test_copies_rank_by_how_much_was_kept(spark):
    same, renamed, rewritten = (pair(spark, ORIGINAL, x) for x in (ORIGINAL, RENAMED, REWRITTEN))
    assert same.logic == 1.0
    assert renamed.logic > 0.6 and renamed.logic > rewritten.logic + 0.15
    assert rewritten.logic < 0.5


def test_clone_scores_follow_direction_and_owner(spark):
    at = lambda d: dt.datetime(2024, 1, d)
    target = files(spark, [("t", "me", at(10), "a.py", ORIGINAL), ("t", "me", at(10), "b.js", "let a = 1")])
    def score(owner, day, code=ORIGINAL, slug="c"):
        c = cands(files(spark, [(slug, owner, day and at(day), "x.py", code)]))
        return clone.detect_clones(target, c)[1].first().clone_similarity
    earlier, unclear, later = score("you", 1), score("you", None), score("you", 20)
    assert earlier > unclear > later > 0
    assert later == pytest.approx(earlier * 0.35, abs=2e-4)
    assert score("me", 1) == 0 and score("you", 1, slug="t") == 0
    assert score("you", 1, REWRITTEN) < 0.4


def test_longest_run_equals_difflib(spark):
    r = random.Random(3)
    rows = [(i, [r.choice("abcd") for _ in range(r.randint(1, 40))], [r.choice("abcd") for _ in range(r.randint(1, 40))]) for i in range(25)]
    l = spark.createDataFrame([(i, a) for i, a, _ in rows], "id long, tokens array<string>")  # noqa: E741
    s = spark.createDataFrame([(i, b) for i, _, b in rows], "id long, tokens array<string>")
    pairs = spark.createDataFrame([(i, i) for i, _, _ in rows], "a long, b long")
    got = {x.a: x for x in similarity.longest_runs(pairs, l, s).collect()}
    for i, a, b in rows:
        m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
        assert got[i].run == m.size and (not m.size or (got[i].a_start, got[i].b_start) == (m.a, m.b))


def commits(spark, repo, n, gap, message, start=dt.datetime(2024, 1, 1)):
    rows = [(repo, start + sum((gap(i) for i in range(k)), dt.timedelta()), message(k)) for k in range(n)]
    df = spark.createDataFrame(rows, "repo_id string, ts timestamp, message string")
    return df.withColumn("local", F.col("ts"))


def test_histories(spark):
    day, r = dt.timedelta(days=1), random.Random(1)
    faked = commits(spark, "faked", 30, lambda i: day, lambda i: "update")
    few = commits(spark, "few", 3, lambda i: day, lambda i: "update")
    one = commits(spark, "one", 1, lambda i: day, lambda i: "update")
    healthy = commits(spark, "healthy", 20, lambda i: dt.timedelta(minutes=7 + 13 * (i * i % 17) ** 3), lambda i: f"explain part {i}\n\nbody")
    got = {x.repo_id: x for x in forensics.forensics(faked.unionByName(few).unionByName(one).unionByName(healthy)).collect()}
    assert got["faked"].commit_forensics > 0.6 and got["faked"].confidence == 1.0
    assert got["few"].commit_forensics < 0.25 and got["one"].commit_forensics < 0.15
    assert got["healthy"].commit_forensics < 0.35
    assert {x.kind for x in forensics.evidence(forensics.forensics(faked)).collect()} >= {"fixed_time", "regularity", "message"}
    assert r


def test_registry_and_upsert(spark, tmp_path):
    docs = spark.createDataFrame([("a/x", ORIGINAL), ("b/x", ORIGINAL), ("c/y", REWRITTEN)], "slug string, text string")
    sig = minhash.minima(docs, ["slug"]).withColumn("owner", F.split("slug", "/")[0])
    got = {x.slug: x.registry_match for x in minhash.registry_match(sig, sig).collect()}
    assert got["a/x"] == got["b/x"] == 1.0 and got["c/y"] < 0.5
    banded = {(x.slug, x.other) for x in minhash.nearest(sig, sig, exact=False).collect()}
    assert {("a/x", "b/x"), ("b/x", "a/x")} <= banded
    row = lambda day, owner: ("a/x", owner, "x", dt.datetime(2024, 1, day), f"url{day}", [day], dt.datetime(2024, 1, day))
    reg = spark.createDataFrame([row(1, "a")], "slug string, owner string, repo_name string, repo_created_at timestamp, repo_url string, signature array<long>, ingested_at timestamp")
    new = spark.createDataFrame([row(5, "z")], reg.schema)
    once = minhash.upsert(reg, new)
    assert [(x.owner, x.repo_url, x.signature) for x in minhash.upsert(once, new.select(*once.columns)).collect()] == [("a", "url5", [5])]


def test_streamed_registry(spark, tmp_path):
    docs = spark.createDataFrame([("a/x", ORIGINAL), ("b/x", ORIGINAL)], "slug string, text string")
    sig = minhash.minima(docs, ["slug"]).withColumns({"owner": F.split("slug", "/")[0], "repo_name": F.lit("x"), "repo_url": F.lit("u"), "repo_created_at": F.lit(None).cast("timestamp"), "ingested_at": F.lit("2024-01-01").cast("timestamp")})
    for n, slug in enumerate(("a/x", "b/x")):
        sig.where(F.col("slug") == slug).coalesce(1).write.parquet(f"{tmp_path}/in{n}")
    for n in range(2):
        spark.read.parquet(f"{tmp_path}/in{n}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/queue")
        s = spark.readStream.schema(sig.schema).parquet(f"{tmp_path}/queue")
        stream.run(s, f"{tmp_path}/reg", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert [x.registry_match for x in spark.read.parquet(f"{tmp_path}/out/batch=0").collect()] == [0.0]
    assert [x.registry_match for x in spark.read.parquet(f"{tmp_path}/out/batch=1").collect()] == [1.0]
    assert spark.read.parquet(f"{tmp_path}/reg/v=1").count() == 2


def test_paths(spark):
    rows = ["node_modules/a.js", "tests/test_app.py", "package-lock.json", "static/app.min.js", "logo.png", "api/pb/service.pb.go", "src/app.py", "src/FooTest.java", "src/footest.java", ".py", "a/Makefile"]
    df = spark.createDataFrame([(p,) for p in rows], "p string").select("p", paths.exclusion(F.col("p")).alias("e"), paths.language(F.col("p")).alias("l"), paths.module_name(F.col("p")).alias("m"))
    got = {x.p: x for x in df.collect()}
    assert [got[p].e for p in rows] == ["vendor", "test", "lockfile", "generated", "non_code", "generated", "", "test", "", "non_code", "non_code"]
    assert got["src/app.py"].l == "python" and got["src/app.py"].m == "src.app"
    url = spark.createDataFrame([("https://host.org/o/n.git",), ("git@host.org:o/n",), ("nonsense",)], "url string")
    assert [(x.owner, x.repo_name, x.slug) for x in repos.resolve(url).collect()] == [("o", "n", "o/n"), ("o", "n", "o/n"), (None, None, None)]


def test_repository_from_disk(spark, tmp_path):
    root = tmp_path / "proj"
    (root / "pkg").mkdir(parents=True)
    (root / "pkg/core.py").write_text("def f():\n    return 1\n\n\n")
    (root / "pkg/app.py").write_text("from pkg.core import f\nimport pkg.core\nprint(f())\n")
    (root / "pkg/raw.py").write_bytes(b"\xff\xfe\x00x")
    (root / "README.md").write_text("# Hi")
    git = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-q", "-m", "first line\n\nbody", "--date", "2024-02-03T04:05:06+02:00")
    tree = repos.tree(spark, "proj", str(root)).where(~F.col("path").startswith(".git/"))
    f = ingest.classified(tree)
    got = {x.path: x for x in f.collect()}
    assert got["pkg/core.py"].loc == 2 and got["pkg/raw.py"].exclude_reason == "binary" and got["README.md"].exclude_reason == "non_code"
    assert [(x.importer, x.path) for x in ingest.import_edges(f).collect()] == [("pkg/app.py", "pkg/core.py")]
    ranked = ingest.ranked(f.join(ingest.centrality(f), ["repo_id", "path"], "left"))
    first = ranked.where("significance_rank = 1").first()
    assert first.path == "pkg/core.py"
    assert ingest.coverage(ranked).first().coverage_ratio == 1.0
    assert ingest.readme(tree).first().readme_text == "# Hi"
    c = repos.commits(spark, {"proj": str(root)}).first()
    assert c.ts == dt.datetime(2024, 2, 3, 2, 5, 6) and c.local == dt.datetime(2024, 2, 3, 4, 5, 6)
    assert c.message == "first line\n\nbody" and c.files_changed == 4


README = """# Tool
Uses flask and react and pandas.
- Supports `fast` route planning with [queues](http://x)
- ok
```
pip install tool
- not a claim inside a fence
```
It can export ledger rows.
it can export ledger rows.
"""


def test_readme_claims_and_score(spark):
    r = spark.createDataFrame([("p", README), ("blank", " \n")], "repo_id string, readme_text string")
    f = spark.createDataFrame([("p", "a.py", "import flask\n" + ORIGINAL)], "repo_id string, path string, text string")
    claims, scores = readme.analyze_readmes(r, f.select("repo_id", "path"), f, readme.vocabulary(spark))
    got = {x.claim_text: x for x in claims.collect()}
    assert got["Uses flask"].status == "verified" and got["Uses flask"].evidence_ref == "a.py"
    assert got["Uses pandas"].status == "contradicted" and got["Uses react"].status == "unverified"
    assert "Supports fast route planning with queues" in got and "not a claim inside a fence" not in got
    assert sum(k.lower() == "it can export ledger rows." for k in got) == 1
    assert got["pip install tool"].claim_type == "setup_env"
    assert {x.repo_id: x.readme_consistency for x in scores.collect()} == {"p": 0.5, "blank": 0.0}


def test_chunks_and_search(spark):
    code = "import os\nX = 1\n\n\n@cache\ndef ledgerTotal(rows):\n    return sum(rows)\n\n\nclass Book:\n    pass\n"
    f = spark.createDataFrame([("p", "a.py", code), ("p", "b.txt", "\n".join(f"line {i}" for i in range(120))), ("p", "c.py", "def (")], "repo_id string, path string, text string")
    c = retrieval.chunks(f)
    assert {(x.path, x.start_line, x.end_line, x.symbol) for x in c.collect()} == {("a.py", 1, 2, "<module>"), ("a.py", 5, 7, "ledgerTotal"), ("a.py", 10, 11, "Book"), ("b.txt", 1, 50, ""), ("b.txt", 41, 90, ""), ("b.txt", 81, 120, ""), ("c.py", 1, 1, "")}
    q = spark.createDataFrame([("p", 1, "total of a ledger, zebra")], "repo_id string, query_id int, text string")
    best = retrieval.search(q, c, 1).first()
    assert best.citation == "a.py:5-7" and 0 < best.score < 1


@pytest.mark.parametrize(
    ("row", "verdict"),
    [
        ((0.05, 0.0, 0.1, 0.0, 0.9, 25), "clean"),
        ((0.95, 0.2, 0.1, 0.3, 0.9, 25), "flagged"),
        ((0.8, 0.8, 0.8, 0.8, 0.9, 25), "flagged"),
        ((0.55, 0.5, 0.5, 0.5, 0.9, 25), "needs_human_review"),
        ((0.1, 0.0, 0.1, 0.0, 0.2, 25), "insufficient_signal"),
        ((0.1, 0.0, 0.05, 0.0, 0.9, 1), "insufficient_signal"),
        ((0.98, 0.3, 0.2, 0.5, 0.1, 1), "flagged"),
        ((0.5, 0.0, 0.0, 0.0, 0.9, 25), "clean"),
    ],
)
def test_verdicts(spark, row, verdict):
    names = "clone_similarity double, readme_consistency double, commit_forensics double, registry_match double, coverage_ratio double, commit_count int"
    df = spark.createDataFrame([row], names)
    assert scoring.scored(df).first().verdict == verdict
    if row[0] == 0.5:
        heavy = scoring.Rulebook(weights={"clone_similarity": 0.95, "registry_match": 0.02, "readme_consistency": 0.02, "commit_forensics": 0.01})
        assert scoring.scored(df, heavy).first().verdict == "needs_human_review"


def test_rulebook_from_yaml(tmp_path):
    yaml = pytest.importorskip("yaml")
    p = tmp_path / "rules.yaml"
    p.write_text(yaml.safe_dump({"weights": {"clone_similarity": 1.0}, "thresholds": {"flagged": 0.5, "review_low": 0.2}, "critical_signals": {"clone_similarity": 0.7}, "insufficient_signal": {"min_commits": 1, "min_coverage": 0.1}}))
    r = scoring.Rulebook.load(p)
    assert r.flagged == 0.5 and r.critical == {"clone_similarity": 0.7} and r.min_commits == 1


def test_metrics_jobs_and_reports(spark):
    pairs = [(False, "flagged"), (False, "flagged"), (True, "flagged"), (True, "clean"), (False, "clean")]
    c = evaluation.confusion(spark.createDataFrame(pairs, "authentic boolean, verdict string")).first()
    assert (c.tp, c.fp, c.tn, c.fn) == (2, 1, 1, 1)
    v = ["flagged", "clean", "needs_human_review", "insufficient_signal"]
    t = evaluation.triage(spark.createDataFrame(list(zip([False, True, False, False], v, strict=True)), "authentic boolean, verdict string")).first()
    assert (t.total, t.auto_resolved, t.review_queue, t.insufficient, t.detected, t.fakes) == (4, 2, 1, 1, 2, 3)
    log = spark.createDataFrame([("j1", 1, 1, "running", "{}"), ("j1", 1, 2, "done", '{"verdict":"clean"}'), ("j2", 3, 3, "error", "{}")], "id string, created_at int, updated_at int, status string, result_json string")
    j = jobs.latest(log)
    assert [x.id for x in jobs.listing(j).collect()] == ["j2", "j1"]
    assert [x.id for x in jobs.listing(j, 50, "clean").collect()] == ["j1"] and not jobs.listing(j, 1, "clean").collect()
    s = spark.createDataFrame([("r", "flagged", 0.7, 0.9, 0.1, 0.0, 0.2, 0.5, 12)], "repo_id string, verdict string, composite double, clone_similarity double, registry_match double, readme_consistency double, commit_forensics double, coverage_ratio double, commit_count int")
    e = spark.createDataFrame([("r", "b", 0.4, "weak"), ("r", "a", 0.9, "strong")], "repo_id string, id string, confidence double, summary string")
    body = sinks.report(s, e).first().report_text
    assert body.index("strong") < body.index("weak") and "Composite suspicion: 0.70" in body
    assert '"ai_opinion":null' in sinks.payload(s).first().payload
