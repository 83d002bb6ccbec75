import random

import numpy as np
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewell.llm import token_store as ts

NAME = path("word_bpe_49k.json")


def corpus():
    r = random.Random(9)
    words = ["".join(r.choice("abcdefgé") for _ in range(r.randint(1, 8))) for _ in range(400)]
    long = " ".join(r.choice(words) for _ in range(6000))
    out = [None, "", " ", long, "x " + long, long[:9000], "same", "same"]
    out += [" ".join(r.choice(words) for _ in range(r.choice([2, 50, 900]))) for _ in range(60)]
    return [((i * 37) % 101, t) for i, t in enumerate(out)]


def test_round_trip(spark):
    rows = corpus() + [(None, "no id <|endoftext|>"), (5, "more"), (5, "more")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    store = ts.write(df, NAME)
    got = ts.read(store).collect()
    t = Tokenizer.from_file(NAME)
    want = sorted(((i is not None, i or 0), (*t.encode(x or "", add_special_tokens=False).ids, 1)) for i, x in rows)
    have = sorted(((g.doc_id is not None, g.doc_id or 0), tuple(np.frombuffer(g.ids, "<u4").tolist())) for g in got)
    assert have == want
    at = 0
    for g in sorted(got, key=lambda g: g.start):
        assert g.start == at and len(g.ids) == 4 * g.n_tokens
        at += g.n_tokens
    keyed = [g.doc_id for g in sorted(got, key=lambda g: g.start)]
    assert keyed == sorted(keyed, key=lambda i: (i is not None, i))
    chunks = store.chunks.where("ids is not null")
    assert chunks.count() == chunks.select("bucket_key").distinct().count() < store.chunks.count()
    assert store.manifest.agg(F.sum("ids")).first()[0] == at
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("tracewell_chunks")]
    assert ts.read(ts.write(df.limit(0), NAME)).count() == 0


def test_damage_is_found(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    store = ts.write(df, NAME)
    broken = ts.Store(spark, store.chunks, store.recipes.withColumn("root", F.lit(b"0" * 16)), store.manifest, store.width)
    with pytest.raises(Exception, match="Merkle"):
        ts.read(broken).collect()


def test_cuts_move_with_the_content():
    g = np.random.default_rng(3)
    a = g.integers(0, 49_000, 50_000)
    b = np.r_[g.integers(0, 49_000, 77), a]
    ends, shifted = set(ts.cuts(a).tolist()), {int(x) - 77 for x in ts.cuts(b)}
    assert len(ends & shifted) > 0.9 * len(ends)
    assert max(np.diff(np.r_[0, ts.cuts(a)])) <= ts.MOST
