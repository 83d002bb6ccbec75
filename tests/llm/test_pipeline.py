import random
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tests.llm.test_mixing import WORD, brute_targets
from tests.llm.test_near_dedup import brute as components
from tests.llm.test_quality import brute as stats
from tests.llm.test_repeats import brute_passages
from tracewell.llm.repeats import LENGTH


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("data")
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgéhij") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, rows, labels = prose(90), [], []
    for i in range(160):
        t = prose(r.randint(60, 300))
        if i % 8 == 0:
            t = " ".join(w + "***" for w in t.split())
        elif i % 8 == 1:
            t = t[:200] + " " + passage + " " + t[200:]
        elif i % 8 == 2 and i > 20:
            t = rows[i - 9][1] + " end"
        rows.append((i, t, r.choice(["en", "de"]), r.choice(["a", "b", None]), len(t)))
        labels.append((i, int(i % 8 != 0), 0))
    rows += [(500, None, "en", "a", None), (501, "", None, "a", 0), (None, prose(80), "en", "b", 1), rows[12]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_against_brute_force(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "source_mix", "packing"]
    at = [docs.collect()]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        at.append(docs.collect())
        if k < 4:
            assert tuple(docs.columns) == cp.COLUMNS
    raw, good, once, cut, mixed, pieces = at
    fails = lambda t: (s := stats(t))[0] < 50 or 100 * s[-1] > 50 * s[0]
    assert not any(fails(r.text) for r in good)
    clean = {r.doc_id for r in raw if r.doc_id is not None and r.doc_id < 160 and r.doc_id % 8 and not fails(r.text)}
    assert len(clean - {r.doc_id for r in good}) <= 0.03 * len(clean)
    assert not any(r.doc_id is not None and r.doc_id < 160 and r.doc_id % 8 == 0 for r in good)
    named = [(r.doc_id, r.text) for r in good if r.doc_id is not None]
    keep = sorted({d for d, _, _, k in components(named, cp.SIMILARITY_PERCENT, 100) if k})
    assert sorted(r.doc_id for r in once if r.doc_id is not None) == keep
    assert sum(r.doc_id is None for r in once) == sum(r.doc_id is None for r in good)
    texts = [r.text for r in once]
    rest = dict(zip([r.doc_id for r in once], brute_passages(texts, cp.PASSAGE_BYTES, cp.PASSAGE_WORDS, LENGTH), strict=True))
    assert any(v != t for v, t in zip(rest.values(), texts, strict=True))
    assert {r.doc_id: r.text for r in cut} == {k: v for k, v in rest.items() if v.strip()}
    assert all(r.n_chars == len(r.text) for r in cut)
    sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in cut:
        n = len(WORD.findall(r.text))
        sizes[r.source] += n
        most[r.source] = max(most[r.source], n)
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = brute_targets(sizes, {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)})
    assert all(abs(taken[s] - want[s]) <= most[s] for s in sizes)
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert sum(p.length for p in pieces) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    windows = defaultdict(int)
    for p in pieces:
        windows[p.sequence_id] += p.length
    assert all(n & (n - 1) == 0 and n <= 2048 for n in windows.values())


def test_run_equals_its_stages(spark, folder):
    got = cp.run(spark, folder)
    assert got.count() > 100 and {"doc_id", "sequence_id", "ids"} <= set(got.columns)
