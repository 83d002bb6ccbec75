import numpy as np
import pytest

from tracewell.llm import inner_product as ip


def brute(rows, k=20, every=20):
    ok = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q)[:k]
            out |= {(q, n, i, -p) for n, (p, i) in enumerate(s, 1)}
    return sorted(out)


@pytest.mark.parametrize("block", [None, 64])
def test_equals_brute_force(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(ip, "CANDIDATE_BLOCK", block)
        monkeypatch.setattr(ip, "QUERY_BLOCK", 8)
    g = np.random.default_rng(1)
    rows = [(i, (g.normal(size=12) * g.choice([0.05, 0.5, 3])).astype(np.float32).tolist()) for i in range(500)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)] + [(2000, None), (2020, [float("nan")] * 12), (2040, [None] * 12), (2060, [float("inf")] * 12), (2080, [0.0] * 12), (None, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(tuple(x) for x in ip.top_products(df).collect()) == brute(rows)


def test_queries_that_need_few_bands_share_blocks(spark, monkeypatch):
    """Long-tailed lengths: blocks meet few bands, and a rotation fitted on few rows changes nothing."""
    monkeypatch.setattr(ip, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(ip, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ip, "ROTATION_ROWS", 100)
    needs, keep = [], ip.stored
    monkeypatch.setattr(ip, "stored", lambda df, name: needs.append(keep(df, name)) or needs[-1] if name == "needs" else keep(df, name))
    g = np.random.default_rng(3)
    axis = g.normal(size=12)
    rows = [(i, (np.exp(g.normal()) * (axis + g.choice([0.2, 3]) * g.normal(size=12))).astype(np.float32).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    assert sorted(tuple(x) for x in ip.top_products(df).collect()) == brute(rows)
    met = [(r.block, r.band) for r in needs[-1].collect()]
    blocks = {b for b, _ in met}
    assert len(blocks) > 4 and len(met) < 0.5 * len(blocks) * 31
    bands = {b: sorted(x for y, x in met if y == b) for b in blocks}
    assert all(x == list(range(1, len(x) + 1)) for x in bands.values())  # the first few bands


def test_classes():
    assert ip._classes([(0, 5000), (1, 10), (2, 3000), (9, 1)]) == [(0, 5000), (1, 3010), (9, 1)]


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (5, [-1.0, 0.5]), (5, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(tuple(x) for x in ip.top_products(df).collect()) == [(0, 1, 5, 0), (0, 2, 5, 0)]
    assert ip.top_products(df.limit(0)).count() == 0
