"""Runs of words against brute force, at all thresholds, and rows that come seldom."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import periods as pr
from tracewell.llm import queries


def brute(w, least=6, times=4):
    """(start, length, period) of all runs, one period after the other."""
    got = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                got.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in got.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=7), st.integers(1, 9)), max_size=9), st.sampled_from([(6, 4), (6, 4), (5, 3), (4, 2), (1, 2)]))
def test_runs_equal_brute_force(blocks, limits):
    words = [c for block, n in blocks for c in block * n]
    owner, start, length, period = pr.of_texts([b"x y", " ".join(words).encode(), b""], *limits)
    assert set(owner.tolist()) <= {1}
    assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == brute(words, *limits)


def test_fewest_shared_words():
    assert pr.window(6, 4) == 5 and pr.window(1, 2) == 1 and pr.window(10, 2) == 5
    for least in range(1, 15):
        for times in range(2, 6):
            assert pr.window(least, times) == min(max(least, times * q) - q for q in range(1, 60))


def test_words_out_of_repeated_windows_are_masked():
    words = "a b c d e f a b c d e g h i j k l k l k l k l k l m n".split()
    h = np.array([zlib.crc32(w.encode()) for w in words], np.uint64)
    at, part = pr.survivors(h, np.zeros(len(h), np.int64), 5)
    # the first two windows are equal, but in stretches of their own; only the run is left
    assert [words[i] for i in at] == ["k", "l"] * 5 and len(set(part.tolist())) == 1


def rows():
    r = random.Random(3)
    out = [(i, " ".join(w for _ in range(r.randint(0, 6)) for w in [r.choice("abcdé漢") * r.randint(1, 3) for _ in range(r.randint(1, 5))] * r.randint(1, 8))) for i in range(120)]
    return [*out, (5, out[5][1]), (5, out[5][1]), (None, "n " * 9), (200, None), (201, ""), (202, " \t\n\x0b"), (203, "one"), (204, "x\ty\x0bx  y\nx y x y x\u00a0y"), (205, "long run " * 30_000 + "end"), (206, "w" * 400_000 + " tail " * 7)]


def test_frames(spark):
    docs = spark.createDataFrame([(i, t, "mine", 4) for i, t in rows()], "doc_id long, text string, runs string, start int").repartition(3)
    got = pr.with_runs(docs).collect()
    assert got[0].start == 4
    mine = sorted((str(r.doc_id), r.text or "", [tuple(x) for x in r.runs], r.collapsed) for r in got)
    want = []
    for i, t in rows():
        w = [x.decode() for x in (t or "").encode().split()]
        found = [(0, 60_000, 2)] if i == 205 else brute(w)
        want.append((str(i), t or "", found, "long run end" if i == 205 else collapsed(w, found)))
    assert mine == sorted(want)
    assert pr.with_runs(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pr.with_runs(docs, times=1)


def test_planted_runs(spark):
    docs = [(i, " ".join(f"w{i}x{k}" for k in range(i % 90))) for i in range(300)] + [(None, "a b c"), (10, None)]
    got = {(str(r.doc_id), len((r.text or "").split())): r.text for r in queries._with_planted_runs(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    changed = 0
    for i, t in docs:
        w = (t or "").split()
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
            changed += 1
        assert (got[str(i), n] or "").split() == w
    assert changed > 15


def test_the_query_takes_texts_without_words_where_runs_are_planted(spark, tmp_path):
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 10 == 0][:4]
    docs = [*zip(ids, ["", " \n\t", None, "a"], strict=True)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_runs, r.start, r.runs_sha256 == r.collapsed_sha256) for r in queries.op12_word_runs(spark, str(tmp_path)).collect()}
    assert got == {i: (0, None, t != "a") for i, t in docs}
