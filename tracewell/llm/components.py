"""Connected components of an edge table, by alternating large-star and small-star steps on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stored


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the smallest of u and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of u, and u, point to the smallest of them. Here u > v in each edge."""
    joined = edges.join(_least(edges), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(u, v) of long ids to (node, component): component is the smallest id of those that the edges connect.

    Nodes without an edge have no row; loops and repeated edges don't matter; an empty table gives an empty one.
    Each round is written to the shared folder. It ends when a round changes nothing, after about log(n) rounds.
    """
    clean = lambda e: e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state = stored(clean(edges), "edges")
    n = state.count()
    mark = None
    for _ in range(rounds):
        # a round has two links at most for each that there was: a node's own, and the one that it hands on
        state = stored(clean(_small_star(clean(_large_star(state)))), "edges", 2 * n)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n = now, now[0]
    else:
        raise RuntimeError("components didn't settle")
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
