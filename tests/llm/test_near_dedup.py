import random
import re

import numpy as np
import pytest

from tracewell.llm import near_dedup as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, numerator, denominator):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(rows)))
    find = lambda i: i if up[i] == i else find(up[i])
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and denominator * len(a & b) >= numerator * len(a | b):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets))


def corpus(seed, n=260):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgÄö") for _ in range(r.randint(2, 7))) for _ in range(3000)]
    passage = [r.choice(words) for _ in range(60)]
    out = [None, "", " \t\n", "one", "One", "one two three", "a b c d e", "a b c d e f"]
    bases = [[r.choice(words) for _ in range(k)] for k in (12, 40, 90, 200, 600)]
    while len(out) < n:
        kind = r.random()
        if kind < 0.5:
            w = list(r.choice(bases))
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in w))
        else:
            out.append(" ".join(passage + [r.choice(words) for _ in range(r.randint(5, 120))]))
    return [(i * 3 + 1, t) for i, t in enumerate(out)]


@pytest.mark.parametrize(("numerator", "block"), [(85, None), (80, 40)])
def test_equals_brute_force(spark, monkeypatch, numerator, block):
    rows = corpus(numerator)
    if block:
        monkeypatch.setattr(nd, "BLOCK_DOCS", block)
        monkeypatch.setattr(nd, "STAR_DOCS", block // 2)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(tuple(x) for x in nd.near_duplicates(df, numerator=numerator).collect())
    assert got == brute(rows, numerator, 100)


def test_edge_rows(spark):
    t = " ".join(f"w{i}" for i in range(80))
    rows = [(5, t, 1), (5, t, 1), (9, t.upper(), 2), (None, t, 3), (7, None, 4), (None, None, 5), (8, t + " end", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, family long")
    got = sorted((tuple(x) for x in nd.near_duplicates(df).collect()), key=str)
    want = [(5, 76, 5, True), (5, 76, 5, True), (9, 76, 5, False), (None, 76, None, True), (7, 0, 7, True), (None, 0, None, True), (8, 77, 5, False)]
    assert got == sorted(want, key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_near_the_truth():
    g = np.random.default_rng(1)
    a = np.unique(g.integers(0, 2**64, 4000, dtype=np.uint64))
    for share in (0.3, 0.6, 0.9):
        b = np.unique(np.r_[a[g.permutation(len(a))[: int(len(a) * share)]], g.integers(0, 2**64, int(len(a) * (1 - share)), dtype=np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(nd.estimate(nd.registers(a, 40), nd.registers(b, 40)[None], len(a), np.array([len(b)]))[0] - truth) < 0.12


@pytest.mark.parametrize("n", [400, 3000, 30000])
def test_correction_removes_the_bias(n):
    """Registers of few bits agree by chance; without the correction estimates would be too high by (1 - truth) * chance."""
    g = np.random.default_rng(n)
    bits, plain, corrected = 2, [], []
    for _ in range(150):
        a = np.unique(g.integers(0, 2**64, n, dtype=np.uint64))
        b = np.unique(np.r_[a[g.permutation(len(a))[: n // 2]], g.integers(0, 2**64, n // 2, dtype=np.uint64)])
        truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        x, y = nd.registers(a, 40, bits), nd.registers(b, 40, bits)
        some = (x != nd.EMPTY) | (y != nd.EMPTY)
        plain.append(((x == y) & some).sum() / some.sum() - truth)
        corrected.append(nd.estimate(x, y[None], len(a), np.array([len(b)]), bits)[0] - truth)
    assert abs(np.mean(corrected)) < 0.01 < 0.02 < np.mean(plain)


def test_keys_hold_enough_bits():
    for t in (0.8, 0.85):
        for lower, bands in zip(nd.BOUNDS, nd.classes(t), strict=True):
            filled = nd.PER_BAND * (1 - np.exp(-lower / (bands * nd.PER_BAND)))
            assert nd.mantissa(lower, bands) == nd.MOST_MANTISSA or nd.mantissa(lower, bands) * filled >= nd.KEY_BITS - 1e-6
    assert nd.mantissa(100_000, 40) == nd.LEAST_MANTISSA


def test_sets_compared_with_a_hub_are_bounded_by_shingles(spark, monkeypatch):
    """Long near copies, few enough for one block by number: no task gets many more shingles than BLOCK_SHINGLES."""
    confirm = nd._confirm

    def watched(numerator, denominator):
        inner = confirm(numerator, denominator)

        def compute(group):
            held = sum(map(len, group.column("set").to_pylist()))
            assert held <= 6_000, held
            return inner(group)

        return compute

    monkeypatch.setattr(nd, "_confirm", watched)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 4_000)
    r = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        w = list(base)
        for k in r.sample(range(300), 2):
            w[k] = f"x{i}-{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {x.component_id for x in nd.near_duplicates(df).collect()} == {0}
