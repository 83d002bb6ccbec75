"""Importance resampling against brute force, and rows that come seldom."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import resampling as rs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, longest):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(words[i : i + k]).encode() for k in range(1, longest + 1) for i in range(len(words) - k + 1)], len(words)


def brute(docs, target, longest, buckets, percent, least, seed):
    bucket = lambda f: zlib.crc32(f) % buckets
    held = [grams(t, longest) for _, t in docs]
    s = Counter(bucket(f) for fs, _ in held for f in fs)
    t = Counter(bucket(f) for _, x in target for f in grams(x, longest)[0])
    size, aim = sum(s.values()), sum(t.values())
    rows = []
    for (i, _), (fs, n) in zip(docs, held, strict=True):
        gain = [math.floor(1000 * math.log((t[b] + 1) * (size + buckets) / ((s[b] + 1) * (aim + buckets)))) for b in map(bucket, fs)]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n])
    order = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(order[: len(order) * percent // 100])}
    return sorted((str(r[0]), *r[1:4], rank.get(id(r), 0)) for r in rows)


def sample(n, seed):
    r = random.Random(seed)
    words = ["The", "of", "Ärger", "naïve", "x1", "99", "漢字", "word", "Z" * 70, "straße", "and", "☃", "B"]
    text = lambda: "".join(r.choice(words) + r.choice([" ", "-", "\n", ". ", "\x7f", "__"]) for _ in range(r.randint(0, 60)))
    return [(i, text()) for i in range(n)]


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 100), (3, 35)])
def test_equals_brute_force(spark, longest, percent):
    docs = [*sample(150, 1), (7, "again " * 30), (7, "again " * 30), (None, "no id " * 20), (900, None), (901, ""), (902, " .-\n"), (903, "long " * 400_000), (904, "q" * 300_000)]
    target = [*sample(20, 2), (None, None), (5, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(target, "item_id long, text string")
    got = rs.resampled(a, b, longest=longest, buckets=512, percent=percent, seed=5).collect()
    assert sorted((str(r.doc_id), r.n_features, r.weight, r.score, r.rank or 0) for r in got) == brute(docs, target, longest, 512, percent, 20, 5)


def test_the_target_is_drawn(spark):
    docs = [(i, " ".join(("apple", "pear", "plum")[(i + k) % 3] if i % 4 == 0 else ("gear", "cog", "axle")[(i + k) % 3] for k in range(40))) for i in range(400)]
    out = rs.resampled(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, "apple pear plum " * 9)], "item_id long, text string"))
    drawn = [r.doc_id for r in out.where("rank is not null").collect()]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) > 35


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame(sample(60, 3), "doc_id long, text string")
    target = spark.createDataFrame(sample(5, 4), "item_id long, text string")
    assert rs.resampled(docs.limit(0), target).count() == 0
    assert rs.resampled(docs.limit(0), target.limit(0)).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    plain = sorted(rs.resampled(docs, target.limit(0)).collect())
    assert len(plain) == 60 and sum(r.rank is not None for r in plain) == sum(grams(t, 1)[1] >= 20 for _, t in sample(60, 3)) // 10
    odd = docs.selectExpr("doc_id", "text", "'x' as score", "1 as key", "'b' as body", "2 as rank", "3 as stream", "4 as at")
    key = lambda rows: sorted(rows, key=lambda r: r.doc_id)
    assert key(rs.resampled(odd, target).collect()) == key(rs.resampled(docs, target).collect())
    with pytest.raises(ValueError):
        rs.streams(docs, "doc_id", buckets=70_000)


def test_crc_of_spans_of_all_lengths():
    r = np.random.default_rng(0)
    data = r.integers(0, 256, 5_000).astype(np.uint8)
    start = r.integers(0, 4_000, 300)
    end = start + r.integers(0, 200, 300)
    want = [zlib.crc32(data[a:b].tobytes()) for a, b in zip(start, end, strict=True)]
    assert rs.crc32_of_spans(data, start, end).tolist() == want
    assert rs.crc32_of_spans(data, start[:0], end[:0]).tolist() == []
