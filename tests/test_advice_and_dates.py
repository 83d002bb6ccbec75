"""Advice fills the payload and changes no verdict; known dates tell who copied; the registry survives runs on any file system."""

import datetime as dt
import json
from dataclasses import replace

from tests import advice_chat
from tests.test_analysis import _repository
from tracewell import __main__ as command
from tracewell import analysis, corpus
from tracewell.operators import jobs
from tracewell.settings import Settings
from tracewell.sources import repos, versions


def test_a_known_date_flips_the_direction(spark, tmp_path):
    text = corpus.program(1)
    _repository(tmp_path / "mine", text, (300, 303, 309, 320))
    _repository(tmp_path / "theirs", text, (0, 4, 9))
    roots, others = {"mine": str(tmp_path / "mine")}, {"theirs": str(tmp_path / "theirs")}

    def told(created, chat=None):
        out = analysis.analyze(spark, analysis.of_folders(spark, roots, others, None, created), chat=chat)
        return json.loads(out.payloads.first().payload), out

    first, _ = told(None)  # by first commits: mine is the later one
    flipped, out = told({"mine": dt.datetime(2020, 1, 1)}, advice_chat.chat)
    direction = lambda p: json.loads(p["evidence"][0]["detail"])["direction_confidence"]
    assert direction(first) == "target_likely_copied" and direction(flipped) == "candidate_likely_copied"
    assert flipped["sub_scores"]["clone_similarity"] < first["sub_scores"]["clone_similarity"]
    assert out.created.first().created_at == dt.datetime(2020, 1, 1)
    assert flipped["ai_opinion"]["summary"] == f"Verdict: {flipped['verdict']}" and flipped["ai_opinion"]["review_id"].startswith("rev_")
    assert flipped["interview_probes"] == [{"question": "Who wrote it?", "target": "general"}]
    broken, _ = told({"mine": dt.datetime(2020, 1, 1)}, advice_chat.broken)
    silent = {"ai_opinion": None, "interview_probes": []}
    assert broken == flipped | silent
    assert analysis.claims_of(out.claims, "tech_stack").count() == 1 and analysis.claims_of(out.claims).count() >= 1


def test_candidates_without_pairs(spark, tmp_path):
    text = corpus.program(2)
    _repository(tmp_path / "own", text, (30, 31, 40))
    _repository(tmp_path / "old", text, (0, 4, 9))
    _repository(tmp_path / "far", "print('nothing in common')\n", (0, 4, 9))
    given = analysis.of_folders(spark, {"own": str(tmp_path / "own")}, {k: str(tmp_path / k) for k in ("old", "far", "own")})
    out = analysis.analyze(spark, replace(given, pairs=None))
    p = json.loads(out.payloads.first().payload)
    assert json.loads(p["evidence"][0]["detail"])["candidate_repo"] == "old" and p["self_excluded_candidates"] == ["own"]


def test_registry_and_job_log_at_an_address(spark, tmp_path, capsys):
    text = corpus.program(3)
    settings = Settings(tmp_path / "cache", "", "", "tests.advice_chat:chat")
    registry, log = f"file://{tmp_path}/registry", f"file://{tmp_path}/log"
    got = []
    for n, name in enumerate(("one", "two")):
        _repository(tmp_path / name, text, (n * 50, n * 50 + 3, n * 50 + 9))
        assert command.main(["analyze", str(tmp_path / name), "--registry", registry, "--jobs", log, "--explain", "--json"], spark, settings) == 0
        got.append(json.loads(capsys.readouterr().out))
    assert [p["sub_scores"]["registry_match"] for p in got] == [0.0, 1.0] and got[0]["ai_opinion"]["summary"].startswith("Verdict")
    assert versions.versions(spark, registry) == [1, 2]
    rows = versions.read(spark, registry).collect()
    assert {r.slug for r in rows} == {"one", "two"} and all(r.repo_created_at for r in rows)
    assert [r.status for r in jobs.latest(spark.read.schema(jobs.LOG).parquet(log)).collect()] == ["done", "done"]


def test_dates_of_hosts(tmp_path):
    at = repos.Target("https://host.example/o/n", "o", "n", tmp_path)
    assert repos.created(at, lambda url, s: {"created_at": "2020-01-02T03:04:05Z"}) == dt.datetime(2020, 1, 2, 3, 4, 5, tzinfo=dt.UTC)
    assert repos.created(at, lambda url, s: {}) is None and repos.created(at, lambda url, s: {"created_at": 7}) is None
    assert repos.created(repos.Target("/a/folder", "", "f", tmp_path), lambda url, s: 1 / 0) is None
