import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import repeats


def brute(texts, length=repeats.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        rest = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        edges = int(np.count_nonzero(np.diff(np.r_[0, gone.view(np.int8)]) == 1))
        out.append((len(d), int(gone.sum()), edges, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (75, 90, 130, 300)]
    docs = [None, "", "x", "a" * 399, "a" * 400, "b" * 401, "c" * 1500, "ab" * 700]
    for _ in range(60):
        body = prose(r.randint(0, 200))
        for p in r.sample(passages, r.randint(0, 3)):
            at = r.randint(0, len(body))
            cut = r.randint(0, 60)
            body = body[:at] + p[cut : len(p) - r.randint(0, 60)] + body[at:]
        docs.append(body)
    docs += docs[20:25] + [docs[30] + "!", "!" + docs[31], docs[32][5:]]
    return docs


@pytest.mark.parametrize(("seed", "group", "length", "part"), [(1, None, 400, None), (2, 2, 400, None), (3, None, 200, 300), (4, 2, 61, None)])
def test_equals_brute_force(spark, monkeypatch, seed, group, length, part):
    if part:
        monkeypatch.setattr(repeats, "PART_BYTES", part)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(5)
    got = {r.doc_id: r for r in repeats.removal_digest(df, group=group, length=length).collect()}
    assert [tuple(got[i])[1:5] for i in range(len(texts))] == brute(texts, length)
    for i, t in enumerate(texts):
        kept = repeats.cut((t or "").encode(), [tuple(r) for r in got[i].removed])
        assert hashlib.sha256(kept).hexdigest() == got[i].kept_sha256


def brute_passages(texts, length, words, size):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            drop = z - a >= size or len(d[a:z].split()) >= words
            inner = d[a:z].split(b" ")
            if drop and len(inner) > 2:  # words that stand there in part stay
                lo = a if a == 0 or d[a - 1 : a] == b" " else a + len(inner[0])
                hi = z if z == len(d) or d[z : z + 1] == b" " else z - len(inner[-1])
                gone[a:lo] = gone[hi:z] = False
            elif not drop:
                gone[a:z] = False
        out.append(np.frombuffer(d, np.uint8)[~gone].tobytes().decode("utf-8", "ignore"))
    return out


def test_passages_of_words(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    long, short = prose(55), prose(44)
    assert len(long.encode()) < 400 and len(short.encode()) > 200
    texts = [" ".join([prose(r.randint(3, 60)), r.choice([long, short, "x" + long + "y", prose(60)]), prose(r.randint(3, 60))]) for _ in range(40)]
    texts += ["q" * 900, "w" + "q" * 800 + "w", None, ""]
    rows = [(i, t, "kept", len(t or ""), 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string, n_chars long, th long").repartition(4)
    got = {x.doc_id: x for x in repeats.without_repeats(df, length=200, words=50, size=400).collect()}
    assert df.columns == ["doc_id", "text", "body", "n_chars", "th"] and all(x.body == "kept" and x.th == 1 for x in got.values())
    want = brute_passages(texts, 200, 50, 400)
    for i, t in enumerate(texts):
        assert got[i].text == (None if t is None else want[i])
        assert t is None or (long not in got[i].text and (short in got[i].text) == (short in t))


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(3).choice("abcdef ") for _ in range(900))
    rows = [(1, t), (1, t), (2, t[:500]), (None, t[100:700]), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[1:5] for r in repeats.removal_digest(df).collect())
    assert got == sorted(brute([x for _, x in rows]))
    assert repeats.removal_digest(df.limit(0)).count() == 0


def test_cut_texts_stay_valid(spark):
    t = "é" * 300 + "".join(random.Random(4).choice("xyzé") for _ in range(800))
    df = spark.createDataFrame([(1, t, 1), (2, "q" + t[1:], 1), (3, None, None)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in repeats.without_repeats(df).collect()}
    assert got[3].text is None and got[3].n_chars is None
    assert got[2].text.startswith("q") and got[2].n_chars == len(got[2].text)
    assert got[1].text == "" or len(got[1].text) < 5
