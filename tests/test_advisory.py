"""Advice is made beside a score and changes nothing."""

from tracewell.operators import advisory


def test_contexts_probes_and_failing_chats(spark):
    scores = spark.createDataFrame([("r", "flagged", 0.7)], "repo_id string, verdict string, composite double")
    evidence = spark.createDataFrame([("r", "b", 0.4, "weak"), ("r", "a", 0.9, "strong")], "repo_id string, id string, confidence double, summary string")
    c = advisory.contexts(scores, evidence).first()
    assert c.review_id.startswith("rev_") and len(c.review_id) == 16
    assert c.context.splitlines() == ["Verdict: flagged", "Composite: 0.7000", "- [a] strong", "- [b] weak"]
    assert advisory.review(c.context, None) is None and advisory.review(c.context, lambda s, u: u[:7]) == "Verdict"
    assert advisory.review(c.context, lambda s, u: 1 / 0) is None
    answers = spark.createDataFrame([("r", '{"probes":[{"question":"Why?","targets":"a"},{"question":" "},{"question":"How?"}]}'), ("s", "no json")], "repo_id string, answer string")
    assert {(r.question, r.target) for r in advisory.probes(answers).collect()} == {("Why?", "a"), ("How?", "general")}
