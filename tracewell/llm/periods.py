"""Runs of words that repeat with a period: found by masking what can't be in one, then by divide and conquer (Main and Lorentz).

A run of period q and length l holds each of its words in a window of l - q words that stands in it twice, q apart. So words outside
the repeated windows of k words, k the smallest l - q that a run may have, are in no run. What is left falls into stretches; each is
halved again and again, and at each middle the periods of runs that cross it are told by how far both sides of it agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import mixed, runs, word_hashes

#: Bytes of text that are looked at together.
BATCH_BYTES = 1 << 20
_RUN = T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")])
_ARROW_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def window(least: int, times: int) -> int:
    """The fewest words that any run shares with itself a period on."""
    return min(max(least, times * q) - q for q in range(1, least + 2))


def survivors(hashes: np.ndarray, part: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words that lie in a window of k words that their own stretch holds twice, and the stretch of each; part is each word's text.

    Stretches get shorter with each look, as windows that repeat in one text may lie in different stretches; it ends when none
    does. Unequal words of equal hash can only let more words survive.
    """
    at = np.arange(len(hashes))
    while len(at) >= k:
        g = np.zeros(len(at) - k + 1, np.uint64)
        for i in range(k):
            g = mixed(g * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(g) + i])
        inside = np.flatnonzero(part[: len(g)] == part[k - 1 :])
        g = mixed(g[inside] ^ mixed(part[inside].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(g)
        same = g[order][1:] == g[order][:-1]
        twice = np.zeros(len(g), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        cover = np.zeros(len(at) + 1, np.int64)
        np.add.at(cover, inside[twice], 1)
        np.add.at(cover, inside[twice] + k, -1)
        keep = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        fresh = np.r_[True, (np.diff(keep) > 1) | (np.diff(part[keep]) != 0)] if len(keep) else np.zeros(0, bool)
        done = len(keep) == len(at)
        at, hashes, part = at[keep], hashes[keep], np.cumsum(fresh)
        if done:
            return at, part
    return at[:0], part[:0]


class Agreement:
    """How far a sequence agrees with itself, by ranks of its stretches of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = len(symbols)
        self.ranks = [np.unique(symbols, return_inverse=True)[1].astype(np.int32)]
        while (step := 1 << (len(self.ranks) - 1)) * 2 <= self.n:
            last = self.ranks[-1].astype(np.int64)
            pair = last[: self.n - 2 * step + 1] * (int(last.max()) + 1) + last[step:]
            values, rank = np.unique(pair, return_inverse=True)
            if len(values) == len(pair):  # nothing so long is there twice
                break
            self.ranks.append(rank.astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree from i and from j > i on."""
        i, j = i.copy(), j.copy()
        first = j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[k]
            ok = np.flatnonzero(j < len(rank))
            ok = ok[rank[i[ok]] == rank[j[ok]]]
            i[ok] += 1 << k
            j[ok] += 1 << k
        return j - first

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Symbols that agree up to i and up to j > i, themselves included."""
        i, j = i + 1, j + 1
        first = j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            rank, size = self.ranks[k], 1 << k
            ok = np.flatnonzero(i >= size)
            ok = ok[rank[i[ok] - size] == rank[j[ok] - size]]
            i[ok] -= size
            j[ok] -= size
        return first - j


def found(codes: np.ndarray, part: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of all runs in stretches of codes; part is each word's stretch."""
    # a symbol of its own stands before each stretch and at the end, so that agreement never leaves one
    edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    size = np.diff(np.r_[edge, len(codes)])
    lo = edge + np.arange(1, len(edge) + 1)
    symbols = np.arange(len(codes) + len(edge) + 1) + (int(codes.max()) + 1 if len(codes) else 0)
    place = np.arange(len(codes)) + np.repeat(np.arange(1, len(edge) + 1), size)
    symbols[place] = codes
    same, hi = Agreement(symbols), lo + size
    out = [np.zeros((0, 3), np.int64)]
    while True:
        some = hi - lo >= max(least, times)
        lo, hi = lo[some], hi[some]
        if not len(lo):
            break
        middle, most = (lo + hi) // 2, (hi - lo) // times
        c = np.repeat(middle, most)
        q = np.arange(len(c)) - np.repeat(np.cumsum(most) - most, most) + 1
        right = symbols[c - 1] == symbols[c - 1 + q]  # a period or more behind the middle
        x, p = c[right], q[right]
        start, end = x - same.backward(x - 1, x - 1 + p), x + p + same.forward(x, x + p)
        left = symbols[c - q] == symbols[c]  # a period or more before it
        y, r = c[left], q[left]
        start, end, p = np.r_[start, y - r - same.backward(y - r - 1, y - 1)], np.r_[end, y + same.forward(y - r, y)], np.r_[p, r]
        long = end - start >= np.maximum(least, times * p)
        out.append(np.unique(np.stack([start[long], end[long], p[long]], 1), axis=0))
        lo, hi = np.r_[lo, middle], np.r_[middle, hi]
    every = np.unique(np.concatenate(out), axis=0)  # of one stretch the smallest period comes first
    first = np.r_[True, (every[1:, :2] != every[:-1, :2]).any(1)] if len(every) else np.zeros(0, bool)
    start, end, p = every[first].T
    back = np.zeros(len(symbols), np.int64)
    back[place] = np.arange(len(codes))
    return back[start], back[end - 1] + 1, p


def of_texts(texts: list[bytes], least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word (from 0), length and period of all runs, by text, first word and period."""
    data, start, end, hashes, bounds = word_hashes(texts)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    at, part = survivors(hashes, text, window(least, times))
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    known: dict[bytes, int] = {}
    raw = data.tobytes()
    codes = np.fromiter((known.setdefault(raw[s:e], len(known)) for s, e in zip(start[at].tolist(), end[at].tolist(), strict=True)), np.int64, len(at))
    first, stop, period = found(codes, part, least, times)
    owner, begin = text[at[first]], at[first] - bounds[text[at[first]]]
    order = np.lexsort((period, begin, owner))
    return owner[order], begin[order], (stop - first)[order], period[order]


def with_runs(docs: DataFrame, *, text: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """docs with runs and collapsed added; such columns are replaced.

    runs (array of start, length, period, by start and period) are all stretches of words, numbered from 0, with smallest period q
    and at least max(least, times * q) words that no word beside them extends. collapsed is the text's words joined by one space,
    without those that any run holds behind its first q. Words are runs of characters other than 0x20 and 0x09-0x0D. Null and empty
    texts have no runs and an empty collapsed text; rows keep their number, repeated ones too, and an empty table gives an empty
    one. Nothing is shuffled; work is about n log^2 n of the words that can be in a run, memory about 100 bytes for each such word
    of the texts looked at together, which is a single text where that is long.
    """
    if times < 2 or least < 1:
        raise ValueError("a run holds its period twice or more")
    docs = docs.drop("runs", "collapsed")

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches, text, BATCH_BYTES):
            owner, start, length, period = of_texts(texts, least, times)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            collapsed = [t.split() for t in texts]
            for i in np.unique(owner).tolist():
                drop = np.zeros(len(collapsed[i]) + 1, np.int64)
                s, n, q = (x[ends[i] : ends[i + 1]] for x in (start, length, period))
                np.add.at(drop, s + q, 1)
                np.add.at(drop, s + n, -1)
                collapsed[i] = compress(collapsed[i], (np.cumsum(drop[:-1]) == 0).tolist())
            each = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], fields=list(_ARROW_RUN))
            made = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), each), pa.array([b" ".join(w) for w in collapsed], pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(compute, T.StructType([*docs.schema.fields, T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())]))
