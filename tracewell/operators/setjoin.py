"""All pairs of two collections of token lists whose logic reaches a threshold, without comparing each with each.

Logic is 0.6 of the Jaccard index J of five-grams and 0.4 of R, the longest common run over the tokens of the shorter list. A pair of logic
t has J >= t, or else R > t. Both can be told from few grams, taken in an order of rarity that all lists share:

- J >= t: two sets meet in the rarest n - ceil(t n) + 1 grams of each (prefix filter); sizes and places exclude most that meet.
- R >= t: a common run holds all grams of a window of ceil(t l) - 4 grams, l the shorter list's tokens. So it holds a gram that is the
  rarest of some window of the shorter list, and the longer list has that gram somewhere.
- a run of fewer than five tokens has no five-gram: it reaches t only in lists of at most 1.6 / t tokens, which are looked up by
  shorter grams.

A gram that every file has is neither among a set's rarest nor the rarest of a window, unless a file has little else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, round4
from ..sources.staging import staged
from .similarity import LOGIC_GRAM, MAX_TOKENS, measured

SHARE_J, SHARE_R = 0.6, 0.4
#: Logic is rounded to four decimals; what may be rounded up to the threshold counts.
SLACK = 0.0001


@dataclass(frozen=True)
class Similar:
    """pairs (a, b, logic, structural) between lists that stand for all equal ones, and who they stand for: (id, stands) of each side."""

    pairs: DataFrame
    left: DataFrame
    right: DataFrame

    def expanded(self) -> DataFrame:
        """Every pair of ids; a group of equal lists on both sides gives the product of their numbers."""
        l, r = self.left.withColumnRenamed("id", "x"), self.right.withColumnRenamed("id", "y")  # noqa: E741
        out = self.pairs.join(l, F.col("a") == F.col("stands")).drop("stands").join(r, F.col("b") == F.col("stands"))
        return out.select(F.col("x").alias("a"), F.col("y").alias("b"), "logic", "structural")


def _classes(side: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Different lists (u, id, tokens, shape, kind, and h, the hashes of their grams), the least id for all equal ones, and (id, stands).

    Null or empty lists go. Tokens are made once, and so are hashes; members are told by a digest.
    """
    has, kind = "shape" in side.columns, F.col("kind").cast("string") if "kind" in side.columns else F.lit("")
    rows = side.select("id", "tokens", *([F.col("shape")] if has else []), kind.alias("kind"))
    told = F.to_json(F.struct("kind", "tokens", *(["shape"] if has else [])))
    # empty lists have no digest and go when tokens are written: a filter before would make those twice
    rows = staged(rows.withColumn("d", F.when(F.size("tokens") > 0, F.sha2(told, 256))), f"{name}-rows").where("d is not null")
    keyed = rows.select("id", "d")
    members = staged(keyed.join(keyed.groupBy("d").agg(F.min("id").alias("stands")), "d"), f"{name}-members")
    copies = staged(members.where(F.col("id") != F.col("stands")).select("id", "d").distinct(), f"{name}-copies")
    lists = rows.join(copies, ["id", "d"], "left_anti").drop("d").withColumns({"u": F.monotonically_increasing_id(), "h": _hashes(LOGIC_GRAM)})
    lists = staged(lists, f"{name}-lists")
    return lists if has else lists.withColumn("shape", F.col("tokens")), members.select("id", "stands")


def _hashes(n: int) -> Column:
    """Hash of each run of n tokens, by its first; a shorter list is one run, which no longer list has. A token is hashed once, a run from its tokens' hashes."""

    def made(t: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - n, F.lit(0)))
        return F.transform(starts, lambda i: F.xxhash64("kind", *(F.get(t, i + k) for k in range(n))))

    return bound(F.transform("tokens", lambda x: F.xxhash64(x)), made)


def _least_of_windows(x: np.ndarray, w: int) -> np.ndarray:
    """The distinct least values of all windows of w."""
    low, have = x, 1
    while have < w:
        step = min(have, w - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    return np.unique(low)


def _shared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Grams (g, f) that both sides have, and how often. The side of fewer lists is counted first, so that the other's grams only go on if they are there."""
    few, many = sorted((left, right), key=lambda df: df.count())
    each = [df.select(F.explode("h").alias("g")) for df in (few, many)]
    known = staged(each[0].groupBy("g").agg(F.count("*").alias("n")), "grams")
    return staged(each[1].join(known, "g").groupBy("g").agg((F.count("*") + F.max("n")).alias("f")), "shared-grams")


def _keys(lists: DataFrame, often: DataFrame, least: float, most: int, name: str) -> DataFrame:
    """What each list is found by: rows (how, u, n, l, place, g).

    how p: a gram of the set's prefix, at its place in the order, n the size of the set; s: a gram that is the rarest of a window,
    l the tokens that count for runs; a: any gram of those. Grams that the other side lacks come first in the order: they take places
    of a prefix, and no window with one is in a common run, but nobody is found by them, so they go no further than the join here.
    """
    grams = lists.select("u", F.size("tokens").alias("l"), F.size(F.array_distinct("h")).alias("n"), F.posexplode("h").alias("at", "g"))
    told = grams.join(often, "g").groupBy("u", "l", "n").agg(F.collect_list(F.struct("at", "f", "g")).alias("x"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, ls, ns = (batch.column(k).to_pylist() for k in range(3))
            ends, values = np.asarray(batch.column(3).offsets), batch.column(3).values
            at, f, g = (np.asarray(values.field(k)) for k in range(3))
            out: list[tuple] = []
            for i, (u, l, n) in enumerate(zip(us, ls, ns, strict=True)):  # noqa: E741
                s = slice(ends[i], ends[i + 1])
                order = np.lexsort((g[s], f[s]))
                first = np.r_[True, np.diff(g[s][order]) != 0]
                rarest, run = g[s][order][first], min(l, most)
                alone = n - len(rarest)
                prefix = n - int(np.ceil(least * n - 1e-9)) + 1 - alone
                if prefix > 0:
                    some = np.arange(min(prefix, len(rarest)))
                    out.append(("p", u, n, run, alone + some, rarest[some]))
                if run >= LOGIC_GRAM:
                    rank = np.full(l, -1, np.int64)
                    rank[at[s][order]] = np.cumsum(first) - 1
                    seen = rank[: run - LOGIC_GRAM + 1]
                    w = max(1, int(np.ceil(least * run - 1e-9)) - LOGIC_GRAM + 1)
                    for how, some in (("s", _least_of_windows(seen, w)), ("a", np.unique(seen))):
                        some = some[some >= 0]
                        out.append((how, u, n, run, some, rarest[some]))
            size = [len(x[5]) for x in out]
            cat = lambda k: np.concatenate([x[k] for x in out]) if out else np.zeros(0, np.int64)
            flat = lambda k: np.repeat(np.array([x[k] for x in out]), size) if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat(0).astype(object), pa.string()), pa.array(flat(1).astype(np.int64)), pa.array(flat(2).astype(np.int64)), pa.array(flat(3).astype(np.int64)), pa.array(cat(4).astype(np.int64)), pa.array(cat(5).astype(np.int64))], ["how", "u", "n", "l", "place", "g"])

    return staged(told.mapInArrow(compute, "how string, u long, n long, l long, place long, g long"), name)


def _short_runs(few: DataFrame, many: DataFrame, least: float, most: int) -> DataFrame:
    """(short, long): lists of at most 1.6 / least tokens and lists not shorter that share a run of so many tokens as R = least / 0.4 takes."""
    need = F.ceil(F.size("tokens") * (least / SHARE_R) - 1e-9).cast("int")
    short = few.where(F.size("tokens") <= 4 * SHARE_R / least + 1e-9).withColumn("r", need).where("r between 1 and 4")
    if short.limit(1).count() == 0:
        return few.sparkSession.createDataFrame([], "short long, long long")
    runs = lambda df, r: df.where(F.size("tokens") >= r).select("u", F.size("tokens").alias("l"), F.explode(F.array_distinct(_hashes(r))).alias("g"))
    out = None
    for r in range(1, 5):
        x = runs(short.where(F.col("r") == r), r).select(F.col("u").alias("short"), F.col("l").alias("ls"), "g")
        y = runs(many.withColumn("tokens", F.slice("tokens", 1, most)), r).select(F.col("u").alias("long"), F.col("l").alias("ll"), "g")
        met = x.join(y, "g").where("ls <= ll").select("short", "long")
        out = met if out is None else out.unionByName(met)
    return out


def candidates(left: DataFrame, right: DataFrame, least: float, most: int = MAX_TOKENS) -> DataFrame:
    """Distinct pairs (x, y) of u of lists that may reach `least`; none that does is left out."""
    t = least - SLACK
    left, right = (df if "h" in df.columns else df.withColumn("h", _hashes(LOGIC_GRAM)) for df in (left, right))
    often = _shared(left, right)
    l, r = (_keys(df, often, t, most, f"keys-{k}") for df, k in ((left, "left"), (right, "right")))  # noqa: E741
    side = lambda df, how, by: df.where(F.col("how") == how).select("g", *[F.col(c).alias(f"{c}_{by}") for c in ("u", "n", "l", "place")])
    need = (F.col("n_x") + F.col("n_y")) * (t / (1 + t)) - 1e-9
    fits = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y")) >= need
    alike = side(l, "p", "x").join(side(r, "p", "y"), "g").where(fits)
    one = side(l, "s", "x").join(side(r, "a", "y"), "g").where("l_x <= l_y")
    two = side(l, "a", "x").join(side(r, "s", "y"), "g").where("l_x > l_y")
    pairs = alike.select("u_x", "u_y").unionByName(one.select("u_x", "u_y")).unionByName(two.select("u_x", "u_y")).toDF("x", "y")
    if t <= SHARE_R:
        pairs = pairs.unionByName(_short_runs(left, right, t, most).toDF("x", "y")).unionByName(_short_runs(right, left, t, most).toDF("y", "x"))
    return pairs.distinct()


def similar(left: DataFrame, right: DataFrame, least: float, most: int = MAX_TOKENS) -> Similar:
    """Pairs of rows (id, tokens; shape and kind if need be) whose logic is at least `least` (over 0, at most 1), with both axes.

    Exactly those that comparing each with each would give (grams are compared by 64-bit hashes until a pair is judged on its
    tokens). Lists of different kinds, languages say, don't meet. Equal lists are looked at once and told by membership. Null and
    empty lists are in no pair; runs look at the first `most` tokens, as everywhere. A common gram is one key of a join of plain
    rows, which adaptive execution can split.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    (l, lm), (r, rm) = _classes(left, "left"), _classes(right, "right")  # noqa: E741
    ids = lambda df, u, k: df.select(F.col("u").alias(u), F.col("id").alias(k))
    met = candidates(l, r, least, most).join(ids(l, "x", "a"), "x").join(ids(r, "y", "b"), "y").select("a", "b")
    parts = ("id", "tokens", "shape")
    found = measured(met, l.select(*parts), r.select(*parts), most)
    logic, structural = round4(SHARE_J * F.col("j5") + SHARE_R * F.col("run_ratio")), round4(0.5 * F.col("multiset") + 0.5 * F.col("j3"))
    return Similar(found.select("a", "b", logic.alias("logic"), structural.alias("structural")).where(F.col("logic") >= least), lm, rm)
