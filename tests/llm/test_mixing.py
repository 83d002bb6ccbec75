import re

import pytest

from tracewell.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights):
    """The words of a target, stated as a loop: share out, stop what is above three times its size, share the excess."""
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in sizes if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weights[s] for s in rest)
        over = [s for s in rest if left * weights[s] / w > 3 * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / w for s in rest}
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_and_takings(spark):
    import random

    r = random.Random(5)
    rows = []
    for i in range(900):
        source = r.choice(["a", "b", "B", "é", "z", None, "tiny"]) if i % 3 else "hot"
        n = r.randint(0, 3) if source == "tiny" else r.randint(0, 80)
        rows.append((i, None if i % 97 == 0 else " w\t\n".join(["x"] * n) + "\x0b", source, 7))
    rows += rows[5:8]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    texts = {i: t for i, t, _, _ in rows}
    taken = dict.fromkeys(sizes, 0)
    for g in got:
        assert g["size"] == size(texts[g.doc_id]) and g.source_size == sizes[g.source]
        assert g.target == pytest.approx(want[g.source], rel=1e-12)
        assert g.taken == g.copies * g["size"] <= 3 * g["size"]
        taken[g.source] += g.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 161, s
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted((g.doc_id, g.taken) for g in got) == sorted((g.doc_id, g.taken) for g in again)
    assert mixing.mixed_documents(df).count() == sum(g.copies for g in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_all_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert [(g["size"], g.taken, g.target) for g in mixing.mix(df).collect()] == [(0, 0, 0.0)] * 2


def test_chances_grow_with_the_size(spark):
    """Of a source that gives half a copy more, long documents are taken again more often, and the words still meet the target."""
    rows = [(i, " ".join(["w"] * (4 if i % 2 else 64)), "a") for i in range(3000)] + [(9000 + i, "w " * 30, "b") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [r for r in mixing.allocation(df).collect() if r.doc_id < 9000]
    target, size = got[0].target, got[0].source_size
    sure = int(target / size)
    fraction = target / size - sure
    extra = {n: [r.copies - sure for r in got if r["size"] == n] for n in (4, 64)}
    rate = {n: sum(x) / len(x) for n, x in extra.items()}
    assert all(set(x) <= {0, 1} for x in extra.values()) and rate[4] < fraction < rate[64] + 0.02
    # chances go with the square root of the size class: 64 has 7 bits and 4 has 3
    assert rate[64] / rate[4] == pytest.approx(4, rel=0.3)
    assert abs(sum(r.taken for r in got) - target) <= 64
