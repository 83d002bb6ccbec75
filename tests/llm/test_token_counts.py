import math
import random
import re

from public_tokenizers import path
from tokenizers.models import Unigram

from tracewell.llm import token_counts as tc

NAME = path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(v, word, memo):
    """Best (score, -tokens) of all ways to write a word, from the end."""
    if word not in memo:
        ways = [(0.0, 0)] if not word else []
        for n in range(1, len(word) + 1):
            if word[:n] in v.score:
                s, t = brute(v, word[n:], memo)
                ways.append((v.score[word[:n]] + s, t - 1))
        if word and word[0] not in v.score:
            s, t = brute(v, word[1:], memo)
            ways.append((v.unknown + s, t - len(word[0].encode())))
        memo[word] = max(ways)
    return memo[word]


def test_equals_brute_force(spark):
    r = random.Random(4)
    v = tc.Vocabulary.load(NAME)
    words = ["".join(r.choice("abcdethionrsé,.🙂漢☃") for _ in range(r.randint(1, 14))) for _ in range(400)]
    rows = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))) + "\t\x0b\n", 0) for i in range(80)]
    rows += [(80, None, 0), (81, "", 0), (None, "null id", 0), (3, "again", 0), (3, "again", 0), (82, "long" * 40, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int").repartition(3)
    memo = {}
    got = sorted(((str(g.doc_id), g.text or "", g.n_words, g.n_tokens) for g in tc.with_counts(df, NAME).collect()))
    want = sorted((str(i), t or "", len(w := WORD.findall(t or "")), -sum(brute(v, tc.MARK + x, memo)[1] for x in w)) for i, t, _ in rows)
    assert got == want
    assert tc.with_counts(df.limit(0), NAME).count() == 0


def test_real_pieces_are_used():
    trie = tc.Trie(tc.Vocabulary({"▁": -1.0, "▁the": -0.5, "a": -2.0, "b": -2.0, "ab": -3.0, "t": -9.0, "h": -9.0, "e": -9.0}, -50.0))
    assert trie.terminals(["the", "theab", "ab", "é", "the"]) == [1, 2, 2, 3, 1]
    # a node for each prefix, however many words have it: the root, the mark, t-h-e-a-b, a-b and é
    assert len(trie.best) == 10


def test_equals_the_library():
    """The same scores in the tokenizers library's own unigram model give the same counts."""
    v = tc.Vocabulary.load(NAME)
    least = min(v.score.values())
    pieces = [("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256)), *v.score.items()]
    library = Unigram(pieces, unk_id=0, byte_fallback=True)
    r = random.Random(7)
    words = ["".join(r.choice("abcdethionrsgé,.🙂漢☃ß0") for _ in range(r.randint(1, 16))) for _ in range(3000)] + ["international", "Straßenbahn", "x" * 60, "☃☃"]
    assert tc.Trie(v).terminals(words) == [len(library.tokenize(tc.MARK + w)) for w in words]
    p = sum(math.exp(s) for s in v.score.values())
    assert abs(p - 1) < 1e-9


def ways(v, word):
    """All ways to write a word in pieces, with their scores; a character that is no piece stands alone, as ""."""
    if not word:
        return [([], 0.0)]
    out = [([word[:n], *rest], v.score[word[:n]] + s) for n in range(1, len(word) + 1) if word[:n] in v.score for rest, s in ways(v, word[n:])]
    if word[0] not in v.score:
        out += [(["", *rest], v.unknown + s) for rest, s in ways(v, word[1:])]
    return out


def test_expected_counts_equal_brute_force(spark):
    v = tc.Vocabulary.counted({"▁": 3.0, "▁the": 5.0, "a": 2.0, "b": 2.5, "ab": 1.0, "ba": 0.5, "t": 1.0, "h": 1.0, "e": 2.0, "the": 0.7})
    words = {"▁the": 4, "▁theab": 3, "▁abab": 2, "▁éab": 1, "▁": 1, "▁bbaabb": 7}
    want, total = dict.fromkeys(v.score, 0.0), 0.0
    for w, n in words.items():
        every = ways(v, w)
        z = sum(math.exp(s) for _, s in every)
        total += n * math.log(z)
        for pieces, s in every:
            for p in filter(None, pieces):
                want[p] += n * math.exp(s) / z
    got, likelihood = tc.expected(spark.createDataFrame(list(words.items()), "word string, n long").repartition(2).sortWithinPartitions("word"), v)
    assert abs(likelihood - total) < 1e-9
    assert all(abs(got[p] - want[p]) < 1e-3 for p in want)


def test_learning_raises_the_likelihood_and_equals_the_library(spark):
    r = random.Random(11)
    words = ["".join(r.choice("abcdethionrsgé,.🙂漢☃ß0") for _ in range(r.randint(1, 12))) for _ in range(300)] + ["the", "station", "national"] * 40
    rows = [(i, " ".join(r.choice(words) for _ in range(40))) for i in range(60)] + [(60, None), (61, ""), (None, "x" * 3000), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    v, heard = tc.learned(docs, tc.Vocabulary.load(NAME), rounds=5)
    assert len(heard) == 5 and all(b > a for a, b in zip(heard, heard[1:], strict=False))
    assert abs(sum(math.exp(s) for s in v.score.values()) - 1) < 1e-9
    assert v == tc.learned(docs.repartition(5), tc.Vocabulary.load(NAME), rounds=5)[0]  # however rows are dealt
    least = min(v.score.values())
    library = Unigram([("<unk>", least), *((f"<0x{b:02X}>", least) for b in range(256)), *v.score.items()], unk_id=0, byte_fallback=True)
    assert tc.Trie(v).terminals(words) == [len(library.tokenize(tc.MARK + w)) for w in words]
    start = tc.Vocabulary.load(NAME)
    assert tc.learned(docs.limit(0), start) == (start, [])
    few, _ = tc.learned(docs, start, rows=20)
    assert few != start and few != v


def test_learns_from_every_document(spark):
    """More documents than any bound that was; the pieces of one word that few of them have count as well."""
    rows = [(i, "the station" if i % 50 else f"the ablative{i % 7}") for i in range(2_400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    start = tc.Vocabulary.load(NAME)
    words: dict[str, int] = {}
    for _, t in rows:
        for w in t.split():
            words[tc.MARK + w] = words.get(tc.MARK + w, 0) + 1
    found, _ = tc.expected(spark.createDataFrame(list(words.items()), "word string, n long"), start)
    assert tc.learned(docs, start, rounds=1)[0] == tc.Vocabulary.counted(found)
