"""Token counts under a unigram model, by forward scores over a trie of the distinct words."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import runs, stored

MARK = "▁"
#: Words whose counts a worker remembers, and nodes of its trie; beyond them it begins anew, which only costs time.
MOST_WORDS, MOST_NODES = 400_000, 600_000
#: Rounds of learning.
ROUNDS = 4
#: Characters of words whose pieces are laid out at once.
LATTICE_CHARS = 1 << 17
#: What each piece is counted more than it is found, so that none becomes impossible.
PRIOR = 0.01
#: Expected counts are added up as whole numbers of this unit, so that no order of adding changes them.
UNIT = 1 << 16
#: What a character that no piece stands for loses against the least likely piece.
UNKNOWN = 10.0
BATCH_BYTES = 2 << 20


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with log-probabilities; a character that is no piece counts as one token per byte, and has the score `unknown`."""

    score: dict[str, float]
    unknown: float

    @staticmethod
    def load(path: str) -> Vocabulary:
        """The pieces of a sentencepiece file, all equally likely."""
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        return Vocabulary.counted(dict.fromkeys(pieces, 0.0))

    @staticmethod
    def counted(found: dict[str, float]) -> Vocabulary:
        """Pieces with probabilities in proportion to their counts, each PRIOR higher."""
        total = math.log(sum(found.values()) + PRIOR * len(found)) if found else 0.0
        score = {p: math.log(n + PRIOR) - total for p, n in found.items()}
        return Vocabulary(score, min(score.values(), default=0.0) - UNKNOWN)


class Trie:
    """Words by their characters. A node holds the best score of the way to write its prefix in pieces, and that way's tokens.

    A prefix is computed once, when a word first brings it; every later word with that prefix, in this batch or a later one,
    walks over it. The count at a word's last node is the word's.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        #: All ends of pieces; with the piece's score if the whole is one.
        self.ends: dict[str, float | None] = {p[i:]: None for p in vocabulary.score for i in range(1, len(p))} | vocabulary.score
        #: Child by node and code point.
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def terminal(self, word: str) -> int:
        """The token count of a word."""
        child, best, count = self.child, self.best, self.count
        node, path, shared = 0, [0], 0
        for c in word:
            step = child.get(node << 21 | ord(c))
            if step is None:
                break
            node = step
            path.append(node)
            shared += 1
        ends, get, score = self.ends, self.ends.get, self.v.score
        for end in range(shared + 1, len(word) + 1):
            high, few = float("-inf"), 0
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                s = get(piece)
                if s is not None:
                    at = path[start]
                    total = best[at] + s
                    if total > high or (total == high and count[at] + 1 < few):
                        high, few = total, count[at] + 1
                elif piece not in ends:  # nor does any longer piece end so
                    break
            if word[end - 1] not in score:
                at = path[end - 1]
                total, n = best[at] + self.v.unknown, count[at] + len(word[end - 1].encode())
                if total > high or (total == high and n < few):
                    high, few = total, n
            child[node << 21 | ord(word[end - 1])] = node = len(best)
            best.append(high)
            count.append(few)
            path.append(node)
        return count[node]

    def terminals(self, words: list[str]) -> list[int]:
        """Token counts of words, each with its mark."""
        return [self.terminal(MARK + w) for w in words]


class Lattice:
    """All ways to write words in pieces, for many words at once.

    A word has a place before each character and one at its end; a piece is an edge from the place where it starts to that where
    it ends. Places are numbered by depth, then by word, so that all edges that end at one depth are taken together.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = list(vocabulary.score)
        #: Scores of the pieces, and last that of a character that is none.
        self.score = np.array([*vocabulary.score.values(), vocabulary.unknown])
        # beginnings of pieces are nodes; they are found by their parent and last character
        begins = sorted({p[:i] for p in self.pieces for i in range(1, len(p) + 1)})
        number = {"": 0} | {x: i for i, x in enumerate(begins, 1)}
        keys = np.array([number[x[:-1]] << 21 | ord(x[-1]) for x in begins], np.int64)
        # a table by hash, at most an eighth full; who finds a slot taken goes to the next
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.keys, self.node = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        slot, rest = self.slots(keys), np.arange(len(keys))
        while len(rest):
            free = rest[self.keys[slot[rest]] < 0]
            self.keys[slot[free]], self.node[slot[free]] = keys[free], free + 1  # of several for a slot the last stays
            rest = rest[self.keys[slot[rest]] != keys[rest]]
            slot[rest] = (slot[rest] + 1) % len(self.keys)
        self.piece = np.full(len(begins) + 1, -1, np.int32)
        self.piece[[number[p] for p in self.pieces]] = np.arange(len(self.pieces))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and the nodes of those."""
        slot = self.slots(keys)
        there = self.keys[slot]
        far = np.flatnonzero((there != keys) & (there >= 0))
        while len(far):
            slot[far] = (slot[far] + 1) % len(self.keys)
            there[far] = self.keys[slot[far]]
            far = far[(there[far] != keys[far]) & (there[far] >= 0)]
        known = np.flatnonzero(there == keys)
        return known, self.node[slot[known]]

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where pieces stand in characters: the first character, how many, and the piece. `left` tells how many there are to a word's end."""
        at, node, n = np.arange(len(codes)), np.zeros(len(codes), np.int64), 0
        alone = np.ones(len(codes), bool)
        out = []
        while len(at):
            known, node = self.found(node.astype(np.int64) << 21 | codes[at + n])
            at, n = at[known], n + 1
            piece = self.piece[node]
            own = piece >= 0
            out.append((at[own], np.full(int(own.sum()), n), piece[own]))
            if n == 1:
                alone[at[own]] = False
            more = left[at] > n
            at, node = at[more], node[more]
        rest = np.flatnonzero(alone)
        out.append((rest, np.ones(len(rest), np.int64), np.full(len(rest), len(self.pieces), np.int32)))
        start, length, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        return start, length, piece

    def expect(self, words: list[str], times: np.ndarray) -> tuple[np.ndarray, float]:
        """The expected count of each piece in words, in UNITs, and the words' log-probability, all ways together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-size, kind="stable")
        words, size, times = [words[i] for i in order.tolist()], size[order], times[order]
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        word = np.repeat(np.arange(len(words)), size)
        first = np.cumsum(size) - size
        depth = np.arange(len(codes)) - first[word]
        start, length, piece = self.edges(codes, size[word] - depth)
        high = int(size[0]) if len(size) else 0
        width = np.searchsorted(-size, -np.arange(high + 1), "right")  # words with a place of that depth
        place = np.r_[0, np.cumsum(width)]
        d, w = depth[start], word[start]
        end, begin = place[d + length] + w, place[d] + w
        by_end = np.argsort(end << 21 | np.minimum(length, (1 << 21) - 1))  # never equal, so the order is the same in every run
        begin, piece, end, w = begin[by_end], piece[by_end], end[by_end], w[by_end]
        zero = int(place[1])  # each place behind a word's first has an edge that ends there
        at = np.searchsorted(end, np.arange(zero, place[-1] + 1))
        count = np.diff(at)
        score = self.score[piece]
        forward, share, part = np.zeros(place[-1]), np.zeros(place[-1]), np.zeros(len(end))
        for k in range(1, high + 1):
            p, q = int(place[k]), int(place[k + 1])
            a, b = int(at[p - zero]), int(at[q - zero])
            group, each = at[p - zero : q - zero] - a, count[p - zero : q - zero]
            total = forward[begin[a:b]] + score[a:b]
            top = np.maximum.reduceat(total, group)
            odds = np.exp(total - np.repeat(top, each))
            whole = np.add.reduceat(odds, group)
            forward[p:q] = top + np.log(whole)
            part[a:b] = odds / np.repeat(whole, each)
        last = place[size] + np.arange(len(words))
        share[last] = 1.0
        for k in range(high, 0, -1):
            a, b = int(at[int(place[k]) - zero]), int(at[int(place[k + 1]) - zero])
            part[a:b] *= share[end[a:b]]
            share[begin[a:b]] += part[a:b]  # no two pieces of a word start and end alike
        found = np.floor(part * times[w] * UNIT + 0.5)
        return np.bincount(piece, found, len(self.score))[:-1].astype(np.int64), float((forward[last] * times).sum())


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n: how often each word occurs, with its mark. Tasks count their batches before anything is shuffled."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in runs(batches, text, BATCH_BYTES):
            seen: Counter[bytes] = Counter()
            for t in texts:
                seen.update(t.split())
            yield pa.RecordBatch.from_arrays([pa.array([MARK + w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return docs.select(F.col(text).cast("string").alias(text)).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def expected(words: DataFrame, vocabulary: Vocabulary) -> tuple[dict[str, float], float]:
    """Expected counts of a vocabulary's pieces in words (word, n), and the words' log-likelihood: a round's first half.

    A task gives a row per piece that it finds, so that the driver gets no more rows than the vocabulary has pieces.
    """
    lattice = Lattice(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, total = np.zeros(len(lattice.pieces), np.int64), 0.0
        some: list[str] = []
        times: list[int] = []
        chars = 0

        def add() -> None:
            nonlocal found, total, chars
            n, likelihood = lattice.expect(some, np.array(times, np.int64))
            found, total, chars = found + n, total + likelihood, 0
            some.clear()
            times.clear()

        for b in batches:
            for word, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                some.append(word)
                times.append(n)
                chars += len(word)
                if chars >= LATTICE_CHARS:
                    add()
        if some:
            add()
        hit = np.flatnonzero(found).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([*(lattice.pieces[i] for i in hit), None], pa.string()), pa.array([*found[hit].tolist(), 0], pa.int64()), pa.array([0.0] * len(hit) + [total], pa.float64())], ["piece", "n", "likelihood"])

    rows = words.select("word", "n").mapInArrow(count, "piece string, n long, likelihood double").groupBy("piece").agg(F.sum("n").alias("n"), F.sum("likelihood").alias("likelihood")).collect()
    got = {r.piece: r.n / UNIT for r in rows if r.piece is not None}
    return {p: got.get(p, 0.0) for p in vocabulary.score}, next((r.likelihood for r in rows if r.piece is None), 0.0)


def learned(docs: DataFrame, pieces: Vocabulary, *, id_: str = "doc_id", text: str = "text", rows: int | None = None, rounds: int = ROUNDS) -> tuple[Vocabulary, list[float]]:
    """The vocabulary with probabilities learned by expectation and maximisation, and the log-likelihood before each round.

    Learned from all documents; a caller who gives `rows` has about so many taken, those whose hash of id and text is lowest. Words
    are counted once, and a round takes each distinct word once. Each round raises the likelihood, up to what PRIOR takes. Null and
    empty texts have no words; without any the pieces come back as they were.
    """
    if rows is not None and (n := docs.count()) > rows:
        docs = docs.where(F.pmod(F.xxhash64(F.col(id_).cast("string"), F.col(text).cast("string")), F.lit(1 << 40)) < rows * (1 << 40) // n)
    words = stored(word_counts(docs, text), "words")
    heard = []
    for _ in range(rounds):
        found, likelihood = expected(words, pieces)
        if not any(found.values()):
            break
        heard.append(likelihood)
        pieces = Vocabulary.counted(found)
    return pieces, heard


_LOADED: dict[str, Vocabulary] = {}


def with_counts(docs: DataFrame, vocabulary: str | Vocabulary, *, text: str = "text") -> DataFrame:
    """docs with n_words and n_tokens (long) added; such columns are replaced.

    Words are runs of characters other than 0x20 and 0x09-0x0D; each stands with a mark before it, and its tokens are those of
    the likeliest way to write it in pieces, the one of the fewest if several are likeliest. Null and empty texts have none. Rows
    keep their number and order; an empty table gives an empty one. Each task looks at the distinct words of a batch that it has
    not met before; nothing is shuffled. A vocabulary given by its path has pieces that are all equally likely; learned() gives better ones.
    """
    docs = docs.drop("n_words", "n_tokens")
    schema = docs.schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if isinstance(vocabulary, str) and vocabulary not in _LOADED:
            _LOADED[vocabulary] = Vocabulary.load(vocabulary)
        trie = Trie(_LOADED[vocabulary] if isinstance(vocabulary, str) else vocabulary)
        known: dict[bytes, int] = {}
        for part, texts in runs(batches, text, BATCH_BYTES):
            split = [t.split() for t in texts]
            if len(known) > MOST_WORDS:
                known.clear()
            if len(trie.best) > MOST_NODES:
                trie = Trie(trie.v)
            fresh = list({w for s in split for w in s}.difference(known))
            known.update(zip(fresh, trie.terminals([w.decode() for w in fresh]), strict=True))
            n = np.array([len(s) for s in split], np.int64)
            each = np.fromiter((known[w] for s in split for w in s), np.int64, int(n.sum()))
            total = np.r_[0, np.cumsum(each)][np.r_[0, np.cumsum(n)]]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(n), pa.array(np.diff(total))], [*part.schema.names, "n_words", "n_tokens"])

    return docs.mapInArrow(compute, T.StructType([*schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())]))
