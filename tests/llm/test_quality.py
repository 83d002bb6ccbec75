import random
import re
from collections import Counter

import numpy as np

from tracewell.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def corpus():
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        kind = i % 4
        if kind == 0:
            t = " ".join(x + r.choice(["***", "$$$", "&&&"]) for x in prose(90).split())
        elif kind == 1:
            t = "\n".join([prose(12)] * 9)
        else:
            t = "\n".join(prose(r.randint(20, 60)) for _ in range(4))
        rows.append((i, t, 1))
        if i % 3:
            labels.append((i, int(kind > 1)))
    rows += [(900, None, 0), (901, "", 0), (902, "a b c a b c a", 0), (903, " \n\t\n", 0), (904, "x\nx\n x\nx", 0), (None, rows[2][1], 0), (5, rows[5][1], 0)]
    return rows, [*labels, (7, None), (None, 1)]


def test_statistics_and_base_rules(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int").repartition(4)
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    got = q.judged(docs, y).collect()
    assert len(got) == len(rows)
    for g in got:
        n, *rest = brute(g.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (n, *rest)
        assert g.base_failed == (n < 50 or 100 * rest[-1] > 50 * n)
        assert g.kept == (not g.base_failed and g.rule == 0)
    held = [g for g in got if g.doc_id is not None and g.doc_id < 400 and g.doc_id % 3 == 0]
    assert np.mean([g.kept == (g.doc_id % 4 > 1) for g in held]) > 0.95
    assert q.judged(docs.limit(0), y).count() == 0


def test_no_labels_keep_what_the_base_keeps(spark):
    rows, _ = corpus()
    docs = spark.createDataFrame(rows[:40], "doc_id long, text string, n_words int")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(g.kept != g.base_failed for g in q.judged(docs, none).collect())


def test_rules_are_readable_conjunctions():
    g = np.random.default_rng(2)
    x = {f: g.random(600) for f in q.FEATURES}
    bad = (x["symbols_per_word"] > 0.7) & (x["n_words"] < 0.6)
    rules = q.learn(x, bad).rules
    assert 1 <= len(rules) <= 4
    hit = np.zeros(600, bool)
    for r in rules:
        assert 1 <= len(r.conditions) <= 3
        hit |= r.holds(x, 600)
    assert (hit == bad).mean() > 0.97
