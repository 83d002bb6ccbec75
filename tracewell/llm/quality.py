"""Quality rules: a decision list learned from labelled statistics by sequential covering."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import grams, runs, word_hashes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Labelled rows that a fit takes at most, chosen by a hash of doc_id.
FIT_ROWS = 20_000
BATCH_BYTES = 1 << 20
#: Names that columns of docs are unlikely to have.
_ID, _Y = "_quality_id_9e27", "_quality_label_9e27"


def text_stats(texts: list[bytes]) -> np.ndarray:
    """The five statistics (columns, in the order of STATS) of whole UTF-8 texts. Words and windows are told apart by 64-bit hashes."""
    data, start, end, words, bounds = word_hashes(texts)
    out = np.zeros((len(texts), len(STATS)), np.int64)
    out[:, 0] = np.diff(bounds)
    lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = np.r_[0, np.cumsum(lead[end] - lead[start])]
    out[:, 1] = chars[bounds[1:]] - chars[bounds[:-1]]
    limits = np.r_[0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)]
    symbols = np.r_[0, np.cumsum(_IS_SYMBOL[data])]
    out[:, 2] = symbols[limits[1:]] - symbols[limits[:-1]]
    for i, t in enumerate(texts):
        if b"\n" in t:
            lines = [x for x in t.split(b"\n") if x.strip()]
            out[i, 3] = len(lines) - len(set(lines))
    found, whole = grams(words, bounds, 3)
    at = np.flatnonzero(whole)
    text = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = at[np.lexsort((found[at], text[at]))]
    same = (found[order[1:]] == found[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
    covered = np.zeros(len(words) + 2, bool)
    for hit in (order[1:][same], order[:-1][same]):
        for k in range(3):
            covered[hit + k] = True
    repeated = np.r_[0, np.cumsum(covered)]
    out[:, 4] = repeated[bounds[1:]] - repeated[bounds[:-1]]
    return out


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns STATS (long) added, computed on whole texts in Arrow batches; no shuffle.

    Null text counts as empty: all zero. A column of docs that has a statistic's name is replaced.
    """
    docs = docs.drop(*STATS)
    schema = docs.schema

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches, text, BATCH_BYTES):
            found = text_stats(texts)
            yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[:, i]) for i in range(len(STATS)))], [*part.schema.names, *STATS])

    return docs.mapInArrow(compute, T.StructType([*schema.fields, *(T.StructField(s, T.LongType()) for s in STATS)]))


#: What the rules look at: ratios of the statistics, so that a threshold holds at any length.
FEATURES: dict[str, str] = {
    "n_words": "cast(n_words as double)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "dup_lines_per_word": "n_dup_lines / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.expr(FEATURES[self.feature])
        return c > F.lit(self.threshold) if self.above else c <= F.lit(self.threshold)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def holds(self, x: dict[str, np.ndarray], n: int) -> np.ndarray:
        out = np.ones(n, bool)
        for c in self.conditions:
            out &= c.holds(x)
        return out


@dataclass(frozen=True)
class DecisionList:
    """Rules in order, each rejecting; a row that none matches is kept."""

    rules: tuple[Rule, ...]

    def matched(self) -> Column:
        """The number of the first rule that a row matches, from 1; 0: none."""
        out = F.lit(0)
        for i, r in reversed(list(enumerate(self.rules, 1))):
            test = F.lit(True)
            for c in r.conditions:
                test = test & c.column()
            out = F.when(test, F.lit(i)).otherwise(out)
        return out

    def keeps(self) -> Column:
        return self.matched() == 0


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if not p:
        return -np.inf
    return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, weight: np.ndarray, most: int) -> Rule:
    """Add the condition of the highest information gain until only bad rows are covered."""
    inside = np.ones(len(bad), bool)
    chosen: list[Condition] = []
    while len(chosen) < most:
        p0, n0 = weight[inside & bad].sum(), weight[inside & ~bad].sum()
        if not n0 or not p0:
            break
        best, pick = 1e-9, None
        for f in x:
            v, w, b = x[f][inside], weight[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, wb, wg = v[order], np.where(b[order], w[order], 0), np.where(b[order], 0, w[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            below_p, below_n = np.cumsum(wb)[cut], np.cumsum(wg)[cut]
            for above, ps, ns in ((False, below_p, below_n), (True, p0 - below_p, n0 - below_n)):
                for i, p, n in zip(cut, ps, ns, strict=True):
                    if p > 0 and (g := _gain(p, n, p0, n0)) > best:
                        best, pick = g, Condition(f, above, float((v[i] + v[i + 1]) / 2))
        if pick is None:
            break
        chosen.append(pick)
        inside &= pick.holds(x)
    return Rule(tuple(chosen))


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Drop trailing conditions while (bad - good) / covered on the held-out part doesn't fall."""

    def worth(r: Rule) -> float:
        hit = r.holds(x, len(bad))
        p, n = int((hit & bad).sum()), int((hit & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    best, value = rule, worth(rule)
    for k in range(len(rule.conditions) - 1, 0, -1):
        shorter = Rule(rule.conditions[:k])
        if (v := worth(shorter)) >= value:
            best, value = shorter, v
    return best


def learn(x: dict[str, np.ndarray], bad: np.ndarray, *, max_rules: int = 12, max_conditions: int = 3, least_precision: float = 0.9, seed: int = 7) -> DecisionList:
    """Sequential covering: grow a conjunction on two thirds, prune it on the last third, keep it if precise enough there, remove what it covers, repeat.

    Empty input, or labels of one class, give an empty list, which keeps every row.
    """
    n = len(bad)
    turn = np.random.default_rng(seed).permutation(n) % 3
    left = np.ones(n, bool)
    rules: list[Rule] = []
    while len(rules) < max_rules:
        grow, hold = left & (turn < 2), left & (turn == 2)
        if bad[grow].sum() < 3 or not bad[hold].sum():
            break
        g = {f: v[grow] for f, v in x.items()}
        rule = _grow(g, bad[grow], np.ones(int(grow.sum())), max_conditions)
        if not rule.conditions:
            break
        rule = _prune(rule, {f: v[hold] for f, v in x.items()}, bad[hold])
        hit = rule.holds(x, n) & left
        p, q = int((hit & bad).sum()), int((hit & ~bad).sum())
        h, k = int((hit & bad & hold).sum()), int((hit & ~bad & hold).sum())
        if p < 3 or p / (p + q) < least_precision or (h + k and h / (h + k) < least_precision):
            break
        rules.append(rule)
        left &= ~hit
    return DecisionList(tuple(rules))


def fit(stats: DataFrame, labels: DataFrame, *, rows: int = FIT_ROWS, doc_id: str = "doc_id", quality: str = "quality", **options) -> DecisionList:
    """Learn a list from the rows of stats that labels has, at most `rows` of them (the smallest hashes of doc_id).

    Null labels and ids are left out; of several labels of one id the lowest holds. The sample is joined before the statistics are needed, and only it reaches the driver.
    """
    y = labels.select(F.col(doc_id).alias(_ID), F.col(quality).cast("int").alias(_Y)).dropna().groupBy(_ID).agg(F.min(_Y).alias(_Y))
    sample = stats.join(y, stats[doc_id] == y[_ID]).orderBy(F.xxhash64(_ID), _ID, *STATS).limit(rows)
    got = sample.selectExpr(f"{_Y} as _y", *(f"cast({e} as double) as `{f}`" for f, e in FEATURES.items())).toPandas()
    x = {f: got[f].to_numpy(float) for f in FEATURES}
    return learn(x, got["_y"].to_numpy() == 0, **options)


def judged(docs: DataFrame, labels: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with STATS, base_failed, rule (number of the rule that rejects it, 0 for none) and kept; such columns are replaced, all others stay.

    Null and empty texts have no words and fail the base rules; repeated rows are judged alike; an empty table gives an empty one.
    """
    sampled = with_stats(labelled_sample(docs, labels, options.get("rows", FIT_ROWS)), text)
    rules = fit(sampled, labels, **options)
    out = with_stats(docs.drop("base_failed", "rule", "kept"), text)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("rule", rules.matched()).withColumn("kept", ~failed & (F.col("rule") == 0))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """The documents among the `rows` labelled ids of the smallest hashes: a bounded set of ids, so it may be broadcast."""
    ids = labels.select(F.col(doc_id).alias(_ID)).dropna().distinct().orderBy(F.xxhash64(_ID), _ID).limit(rows)
    return docs.join(F.broadcast(ids), docs[doc_id] == ids[_ID], "left_semi")


