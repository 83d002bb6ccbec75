import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tracewell.llm import packing
from tracewell.llm.tokens import Encoder

ODD = ["", " ", "\n", "a\n b", "a\nb", "  lead", "trail  ", "tab\t\tx", "don't 's 've\n'll", "x\x1cy \x1d z", "nb\xa0sp  wide　x", "É́ é İ Σας ΑΣ ß ǅ", "<|endoftext|> <|startoftext|>x", "12 3½ ²x", "naïve—dash… ​zero", "\x85next", "日本語 テキスト", "\U0001f600 smile", "a" * 3000, "!?..,, __ #$%", "l'été d'aujourd'hui"]


def texts(n=200):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijÉñ'") for _ in range(r.randint(1, 9))) for _ in range(500)]
    return ODD + ["".join(r.choice(words).title() + r.choice([" ", " ", " ", "\n", ", ", "  ", "\t", ". "]) for _ in range(r.choice([3, 40, 400]))) for _ in range(n)]


CONTROL = ["<|endoftext|>", "<|startoftext|>", "'ll", "'re", "'ve", " 's", "\n's", "''s"]
CHARS = "aAsStTmMdDrRevVlLL''  \n\n\t\r0129²½.,-×÷éÉßÀŸāĀ’“ 　́ẞΣσ漢\U0001f642\x00\x1c\x85᠎"


def noise(n=4000):
    r = random.Random(4)
    wild = ["".join(r.choice([*CHARS, *CONTROL]) for _ in range(r.randint(0, 40))) for _ in range(n)]
    return wild + ["".join(r.choice("aAst' \n\t09²,éÉ\x00") for _ in range(r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("as_text", [False, True])
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name, as_text):
    t = Tokenizer.from_file(path(name))
    t.encode_special_tokens = as_text
    e = Encoder(path(name), as_text)
    assert e.kind == name[:4]
    for some in (texts(), texts()[::-1], noise()):
        ids, size = e.encode([x.encode() for x in some])
        at = np.r_[0, np.cumsum(size)]
        for i, x in enumerate(some):
            assert ids[at[i] : at[i + 1]].tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_pieces_hold_every_id_once(spark):
    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    rows = [(i, x) for i, x in enumerate([None, *texts(300)])] + [(None, "null id"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, path("byte_bpe_50k.json")).collect()
    docs, sequences, steps = defaultdict(list), defaultdict(list), defaultdict(int)
    for p in got:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length > 0
        docs[p.doc_id].append((p.start, p.doc_tokens, ids))
        sequences[p.sequence_id].append((p.offset, p.length, p.window))
        steps[p.step_group] += p.length
    for s in sequences.values():
        s.sort()
        total = sum(x[1] for x in s)
        assert [x[0] for x in s] == np.r_[0, np.cumsum([x[1] for x in s])[:-1]].tolist()
        assert total == s[0][2] <= 2048 and total & (total - 1) == 0
    for i, x in rows:
        if i in (3, None):
            continue
        parts = sorted(docs[i], key=lambda p: p[0])
        whole = np.concatenate([p[2] for p in parts])
        assert whole.tolist() == t.encode(x or "", add_special_tokens=False).ids + [1]
        assert {p[1] for p in parts} == {len(whole)}
        assert zlib.crc32(whole.astype("<u4").tobytes()) >= 0
    assert sum(len(p[2]) for p in docs[3]) == sum(len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in rows if i == 3)
    # of each partition, only the last group may be smaller
    for part in {s >> 36 for s in steps}:
        own = sorted((s, n) for s, n in steps.items() if s >> 36 == part)
        assert all(n == packing.STEP_IDS for _, n in own[:-1]) and own[-1][1] <= packing.STEP_IDS
    assert packing.pack(df.limit(0), path("byte_bpe_50k.json")).count() == 0
