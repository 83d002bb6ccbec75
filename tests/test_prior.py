"""Prior submissions only: inside a batch, across batches, and after a killed one; minima merged in steps."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import minhash
from tracewell.sources import versions
from tracewell.streaming import registry

KIND = "slug string, owner string, at int, signature array<long>"


def brute(rows, least):
    out = {}
    for slug, owner, at, sig in rows:
        best = None
        for other, o, t, s in rows:
            if other != slug and not (owner and owner == o) and (t, other) < (at, slug) and sig and len(sig) == len(s):
                j = int(sum(a == b for a, b in zip(sig, s, strict=True)) / len(sig) * 10000 + 0.5) / 10000
                if j > 0 and j >= least and (best is None or (-j, t, other) < best):
                    best = (-j, t, other)
        if best:
            out[slug] = (best[2], -best[0])
    return out


@pytest.mark.parametrize("least", [0.0, 0.5, 0.9])
def test_equals_brute_force(spark, least):
    r = random.Random(9)
    kinds = [[r.randint(0, 6) for _ in range(24)] for _ in range(5)]
    rows = [(f"s{i:03d}", r.choice(["", "x", "y"]), r.randint(0, 30), [v if r.random() < 0.85 else r.randint(0, 20) for v in r.choice(kinds)] if i % 2 else r.choice(kinds)) for i in range(90)]
    rows += [("empty", "", 1, []), ("short", "", 2, [1, 2]), ("short2", "", 3, [1, 2])]
    every = spark.createDataFrame(rows, KIND).repartition(3)
    got = {x.slug: (x.other, x.jaccard) for x in minhash.prior(every, least=least).collect()}
    assert got == brute(rows, least) and len(got) > 40
    # the same from a registry and a batch; only the batch is asked for
    new = F.col("at") >= 20
    part = {x.slug: (x.other, x.jaccard) for x in minhash.prior(every.where(new), every.where(~new), least).collect()}
    late = {s for s, _, at, _ in rows if at >= 20}
    assert part == {k: v for k, v in got.items() if k in late}


def test_of_two_like_ones_in_a_batch_only_the_later_matches(spark, tmp_path):
    schema = "slug string, owner string, repo_name string, repo_url string, repo_created_at timestamp, ingested_at timestamp, signature array<long>"
    row = lambda slug, day: (slug, slug, "n", "u", None, dt.datetime(2024, 1, day), [1, 2, 3])
    at = str(tmp_path)
    for n, rows in enumerate(([row("late", 9), row("first", 2), row("mid", 5)], [row("older", 1), row("last", 20)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{at}/queue")
        s = spark.readStream.schema(schema).parquet(f"{at}/queue")
        registry.run(s, f"file://{at}/reg", f"{at}/out", f"{at}/check").awaitTermination()
        got = {x.slug: (x.other, x.registry_match) for x in spark.read.parquet(f"{at}/out/batch={n}").collect()}
        assert got == ({"late": ("first", 1.0), "mid": ("first", 1.0), "first": (None, 0.0)}, {"older": (None, 0.0), "last": ("older", 1.0)})[n]
    assert versions.versions(spark, f"{at}/reg") == [1, 2] and versions.read(spark, f"{at}/reg").count() == 5


def test_a_half_written_version_is_not_read(spark, tmp_path):
    schema = "slug string, owner string, repo_name string, repo_url string, repo_created_at timestamp, ingested_at timestamp, signature array<long>"
    df = spark.createDataFrame([("a", "a", "n", "u", None, dt.datetime(2024, 1, 1), [1])], schema)
    at = str(tmp_path)
    df.where("false").write.parquet(f"{at}/reg/v=0")  # what a killed batch has left
    df.coalesce(1).write.parquet(f"{at}/queue")
    registry.run(spark.readStream.schema(schema).parquet(f"{at}/queue"), f"{at}/reg", f"{at}/out", f"{at}/check").awaitTermination()
    assert versions.read(spark, f"{at}/reg").count() == 1


def test_merged_minima(spark, monkeypatch):
    monkeypatch.setattr(minhash, "MERGE_KEYS", 3)
    r = random.Random(2)
    rows = [(r.choice(["hot", "hot", *"abcdefg", None]), [r.randint(0, 99) for _ in range(5)]) for _ in range(200)] + [("x", None), ("a", None), ("y", [7]), ("y", [9, 1])]
    got = {x.k: x.signature for x in minhash.merged(spark.createDataFrame(rows, "k string, signature array<long>").repartition(5), "k").collect()}
    want = {}
    for k, s in rows:
        if s is not None:
            old = want.get(k, [])
            want[k] = [min(v) for v in zip(old, s, strict=False)] + (old[len(s) :] or s[len(old) :])
    assert got == want


def test_values_of_one_signature_alone_go_no_further(spark, monkeypatch):
    from tracewell.operators import minhash

    kept = {}
    whole = minhash.staged
    monkeypatch.setattr(minhash, "staged", lambda df, name: kept.setdefault(name, whole(df, name)))
    rows = [(i, f"o{i}", i, [i * 100 + k for k in range(4)]) for i in range(5)] + [(9, "o9", 9, [0, 1, 2, 999])]
    targets = spark.createDataFrame(rows, "slug long, owner string, at long, signature array<long>")
    got = minhash.prior(targets, least=0.5).collect()
    assert [(r.slug, r.other, r.jaccard) for r in got] == [(9, 0, 0.75)]
    assert kept["positions"].count() == 3 and kept["rare-positions"].count() == 4


def test_signatures_move_in_packed_lists(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART_POSTINGS", 500)
    monkeypatch.setattr(minhash, "GROUP", 16)
    monkeypatch.setattr(minhash, "LIST", 4)
    r = random.Random(4)
    rows = [(i, [7, *(r.choice([-5, r.randint(0, 30), r.randint(0, 2**40)]) for _ in range(r.choice([3, 40])))]) for i in range(80)]
    frame = spark.createDataFrame(rows, "u long, signature array<long>").repartition(3)
    want = {}
    for u, sig in rows:
        for i, v in enumerate(sig):
            want.setdefault((len(sig), i, v), set()).add(u)
    want = {k: us for k, us in want.items() if len(us) > 1}
    got = {}
    for x in minhash._shared(frame).collect():
        assert x.c == len(want[x.n, x.i, x.v]) and len(x.us) <= 4
        got.setdefault((x.n, x.i, x.v), []).extend(x.us)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()} and len({k[0] for k in got}) == 2
    # a posting takes a few bytes on its way, not a row
    plain = spark.range(2000).select(F.col("id").alias("u"), F.transform(F.sequence(F.lit(1), F.lit(128)), lambda i: F.pmod(F.xxhash64("id", i), F.lit(minhash.PRIME))).alias("signature"))
    dealt = minhash._dealt(plain, 8)
    assert dealt.count() < 2000 and dealt.agg(F.sum(F.length("i") + F.length("v") + F.length("at"))).first()[0] <= 2000 * 128 * 7
