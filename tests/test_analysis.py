"""The whole analysis: the labelled corpus, folders with histories, the command line, the job log."""

import datetime as dt
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tracewell import __main__ as command
from tracewell import analysis, corpus
from tracewell.operators import advisory, evaluation, jobs
from tracewell.settings import Settings
from tracewell.sources import repos, sinks


def test_published_figures_of_the_held_out_split(spark):
    metrics, text = corpus.report(spark, "heldout")
    m, t = metrics["confusion"], metrics["triage"]
    assert (m["tp"], m["fp"], m["tn"], m["fn"]) == (9, 0, 7, 0)
    assert (m["precision"], m["recall"], m["f1"], m["false_positive_rate"], m["accuracy"]) == (1.0, 1.0, 1.0, 0.0, 1.0)
    assert (t["total"], t["auto_resolved"], t["review_queue"], t["insufficient"], t["detected"], t["fakes"]) == (16, 15, 0, 1, 9, 9)
    assert (t["baseline_minutes"], t["tool_minutes"]) == (192, 16)
    assert "| tp / fp / tn / fn | 9 / 0 / 7 / 0 |" in text and "| thin | original | insufficient_signal |" in text


def test_corpus_and_splits(spark):
    every = corpus.for_split("all")
    assert len(every) == 24 and [sum(x.category == c for x in every) for c in corpus.CATEGORIES] == [10, 8, 6]
    assert {x.repo_id for x in corpus.for_split("tuning")}.isdisjoint(x.repo_id for x in corpus.for_split("heldout"))
    assert all({x.category for x in corpus.for_split(s)} == set(corpus.CATEGORIES) for s in corpus.SPLITS)
    with pytest.raises(ValueError, match="no such split"):
        corpus.for_split("other")


def _repository(folder, text, days):
    folder.mkdir(parents=True)
    git = lambda *a, **env: subprocess.run(["git", "-C", str(folder), "-c", "user.name=x", "-c", "user.email=a@b.c", *a], check=True, capture_output=True, env={"PATH": "/usr/bin:/bin", "HOME": str(folder), **env})
    git("init", "-q")
    for i, d in enumerate(days):
        (folder / "main.py").write_text(text + (f"\n# {i}\n" if i + 1 < len(days) else ""))
        (folder / "README.md").write_text("# Tool\n\n- Computes sums with pandas\n")
        git("add", "-A")
        at = (dt.datetime(2024, 1, 1, 10, 7) + dt.timedelta(days=d, minutes=37 * i)).isoformat() + "+00:00"
        git("commit", "-q", "-m", f"step {i} of the work", GIT_AUTHOR_DATE=at, GIT_COMMITTER_DATE=at)


def test_folders_payload_and_command(spark, tmp_path, capsys):
    text = corpus.program(1)
    _repository(tmp_path / "mine", text, (300, 303, 309, 320))
    _repository(tmp_path / "theirs", text, (0, 4, 9))
    settings = Settings(tmp_path / "cache", str(tmp_path / "registry"), "")
    assert command.main(["analyze", str(tmp_path / "mine"), "--candidate", str(tmp_path / "theirs"), "--json"], spark, settings) == 0
    got = json.loads(capsys.readouterr().out)
    assert list(got) == list(sinks.PAYLOAD)
    assert got["verdict"] == "flagged" and got["sub_scores"]["clone_similarity"] >= 0.85 and got["commit_count"] == 4
    assert [e["type"] for e in got["evidence"]][:2] == ["clone_match", "readme_contradiction"]
    assert got["readme_claims"] and len(got["commit_timeline"]) == 4 and got["ai_opinion"] is None and got["interview_probes"] == []
    assert got["self_excluded_candidates"] == []
    # a second look finds no entry but its own, which doesn't count; another folder with the same code does
    _repository(tmp_path / "third", text, (400, 402, 409))
    assert command.main(["analyze", str(tmp_path / "third"), "--json", "--no-register"], spark, settings) == 0
    third = json.loads(capsys.readouterr().out)
    assert third["sub_scores"]["registry_match"] == 1.0 and third["verdict"] == "flagged"
    assert command.main(["analyze", str(tmp_path / "mine"), "--json", "--no-register"], spark, settings) == 0
    assert json.loads(capsys.readouterr().out)["sub_scores"]["registry_match"] == 0.0
    assert command.main(["analyze", "no such thing"], spark, settings) == 2


def test_targets_and_metadata(tmp_path):
    asked = []
    at = repos.target("https://host.example/owner/name.git", tmp_path, lambda c: asked.append(c))
    assert (at.owner, at.name, at.slug) == ("owner", "name", "owner/name") and asked == [["git", "clone", "--quiet", "https://host.example/owner/name.git", str(tmp_path / "host.example/owner/name")]]
    (at.folder / ".git").mkdir(parents=True)
    repos.target("https://host.example/owner/name.git", tmp_path, lambda c: asked.append(c))
    assert len(asked) == 1
    assert repos.metadata(at, lambda url, s: {"default_branch": "main", "created_at": "2020-01-01T00:00:00Z", "fork": False}) == {"default_branch": "main", "repo_created_at": "2020-01-01T00:00:00Z", "is_fork": False}
    assert repos.metadata(at, lambda url, s: 1 / 0) == {}


def test_job_log(spark, tmp_path):
    path = str(tmp_path / "jobs")
    jobs.init(spark, path)
    assert jobs.init(spark, path).count() == 0
    assert jobs.run(spark, path, "a", "u", lambda: {"verdict": "clean"}) == "done"
    assert jobs.run(spark, path, "b", "u", lambda: 1 / 0) == "error"
    now = jobs.latest(spark.read.parquet(path))
    assert {(r.id, r.status) for r in now.collect()} == {("a", "done"), ("b", "error")}
    assert [r.id for r in jobs.listing(now, 50, "clean").collect()] == ["a"]
    assert "ZeroDivisionError" in jobs.by_id(now, "b").first().result_json


def test_small_views(spark):
    claims = spark.createDataFrame([("t", "feature", "verified"), ("t", "feature", "unverified"), ("u", "feature", "verified")], "repo_id string, claim_type string, status string")
    assert {(r.claim_type, r.status, r.n) for r in analysis.claim_counts(claims).collect()} == {("feature", "verified", 2), ("feature", "unverified", 1)}
    x = spark.createDataFrame([(0.7,), (0.5,), (0.3,), (0.1,)], "x double").select(analysis.band(F.col("x")).alias("b"), analysis.percent(F.col("x")).alias("p")).collect()
    assert [(r.b, r.p) for r in x] == [("red", "70%"), ("amber", "50%"), ("yellow", "30%"), ("emerald", "10%")]
    probes = spark.createDataFrame([("t", "why?", "clone_a"), ("t", "how?", "general")], "repo_id string, question string, target string")
    facts = spark.createDataFrame([("t", "clone_a", "clone_match", "s")], "repo_id string, id string, type string, summary string")
    assert {(r.question, r.type) for r in advisory.probe_evidence(probes, facts).collect()} == {("why?", "clone_match"), ("how?", None)}
    answer = '{"summary": " fine ", "interview_questions": [{"question": "q", "targets": "e"}, {"question": " "}, 3, {"question": "r"}]}'
    assert advisory.reviewed("c", lambda s, u: answer) == ("fine", [{"question": "q", "target": "e"}, {"question": "r", "target": "general"}])
    assert advisory.reviewed("c", lambda s, u: "no json") == (None, []) and advisory.reviewed("c", None) == (None, [])
    assert evaluation.markdown("x", {k: 0 for k in ("tp", "fp", "tn", "fn", "precision", "recall", "f1", "false_positive_rate", "accuracy")}, {k: 0 for k in ("total", "auto_resolved", "review_queue", "insufficient", "detected", "fakes", "detection_rate", "baseline_minutes", "tool_minutes", "saved_pct")}, []).startswith("# Evaluation")
