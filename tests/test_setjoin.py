"""Pairs by threshold: the same as each with each, at any threshold and length; common grams make no pairs."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import clone, setjoin
from tracewell.operators.similarity import gram_set


def logic(a, b, most=4000):
    g, h = gram_set(a, 5), gram_set(b, 5)
    j = len(g & h) / len(g | h) if g | h else 0.0
    x, y = a[:most], b[:most]
    run = difflib.SequenceMatcher(None, x, y, autojunk=False).find_longest_match().size
    return int((0.6 * j + 0.4 * (run / min(len(x), len(y)) if run else 0.0)) * 10000 + 0.5) / 10000


def lists(seed, n):
    """Token lists with passages in common, short ones, one-token loops, and a head that all long ones have."""
    r, out = random.Random(seed), []
    pool = [[r.choice("abcdefghij") + str(r.randint(0, 9)) for _ in range(r.randint(2, 40))] for _ in range(6)]
    for i in range(n):
        kind = i % 6
        if kind == 0:
            x = [r.choice("abc") for _ in range(r.randint(1, 6))]
        elif kind == 1:
            x = ["z"] * r.randint(1, 30) + [r.choice("pq") for _ in range(r.randint(0, 5))]
        else:
            x = "the same head of all files here".split() + [t for _ in range(r.randint(1, 3)) for t in r.choice(pool)] + [f"n{r.randint(0, 400)}" for _ in range(r.randint(0, 30))]
        out.append(x)
    return out


@pytest.mark.parametrize("least,most", [(0.3, 4000), (0.15, 25), (0.6, 4000)])
def test_equals_each_with_each(spark, least, most):
    a, b = lists(1, 60), lists(2, 66)
    a, b = [*a, a[8], a[8], [], None, b[9]], [*b, b[9], b[9], a[8]]
    frame = lambda rows: spark.createDataFrame(list(enumerate(rows)), "id long, tokens array<string>").repartition(3)
    found = setjoin.similar(frame(a), frame(b), least, most)
    got = {(r.a, r.b): r.logic for r in found.expanded().collect()}
    want = {(i, j): v for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (v := logic(x, y, most)) >= least}
    assert got == want and len(want) > 30
    assert found.pairs.count() < len(want)  # equal lists are told by membership


def test_a_gram_of_all_files_makes_no_pair(spark):
    head = "licence of all the files in this place".split()
    rows = [(i, head + [f"t{i}x{k}" for k in range(60)]) for i in range(40)]
    lists = spark.createDataFrame(rows, "id long, tokens array<string>").withColumns({"u": F.col("id"), "kind": F.lit(""), "shape": F.col("tokens")})
    met = setjoin.candidates(lists, lists, 0.3)
    assert {(r.x, r.y) for r in met.collect()} == {(i, i) for i in range(40)}


def test_kinds_and_empty_sides(spark):
    side = spark.createDataFrame([(1, "a b c d e f g".split(), "go"), (2, "a b c d e f g".split(), "c")], "id long, tokens array<string>, kind string")
    assert {(r.a, r.b) for r in setjoin.similar(side, side, 0.5).expanded().collect()} == {(1, 1), (2, 2)}
    assert setjoin.similar(side.limit(0), side, 0.3).pairs.count() == setjoin.similar(side, side.limit(0), 0.3).pairs.count() == 0
    with pytest.raises(ValueError):
        setjoin.similar(side, side, 0)


def test_files_of_whole_collections(spark):
    """As comparing all given pairs and dropping what is below the threshold."""
    texts = [" ".join(x) for x in lists(5, 40)]
    row = lambda i, t: (f"r{i % 5}", ("", "me")[i % 4 == 0], f"f{i}", ("go", "c")[i % 3 == 0], 1, t)
    kinds = "repo_id string, owner string, path string, language string, loc long, text string"
    files = spark.createDataFrame([row(i, t) for i, t in enumerate(texts)], kinds).withColumn("created_at", F.lit(None).cast("timestamp"))
    others = spark.createDataFrame([row(i + 3, t) for i, t in enumerate(texts[::-1])], kinds).withColumnRenamed("repo_id", "slug").withColumn("created_at", F.lit(None).cast("timestamp"))
    pairs = files.select("repo_id").distinct().crossJoin(others.select("slug").distinct())
    key = lambda df: sorted((r.repo_id, r.slug, r.path, r.other, r.logic, r.structural) for r in df.where("logic >= 0.3").collect())
    want = key(clone.compared_files(files, others, "plain", pairs)[0])
    assert key(clone.compared_files(files, others, "plain", least=0.3)[0]) == want and len(want) > 20
