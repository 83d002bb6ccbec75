"""Exact largest inner products: vectors by descending length, rotated partial sums, Cauchy-Schwarz bounds on the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Queries, and candidates, that meet in one task.
QUERY_BLOCK, CANDIDATE_BLOCK = 2_048, 16_384
#: Ranges of the length at most; their rows are dealt further by id.
BANDS = 256
#: Rotated components that the partial sums take first; the bound on the rest decides who is looked at in full.
HEAD_SHARE = 0.25
EPS = 1e-6
#: Share of a block's pairs from which it is multiplied as a whole.
DENSE = 0.02
#: Vectors that the rotation is fitted on, about. It decides how much is excluded, never what is found.
ROTATION_ROWS = 50_000
#: Pairs of a block of queries and a band that are broadcast at most; more are joined.
BROADCAST_ROWS = 100_000


def _vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """id and whole-number vectors floor(64 x); vectors that are null, empty or hold null, NaN or infinite components are left out."""
    x = F.col("x")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).where(x.isNotNull() & F.col("id").isNotNull() & (F.size(x) > 0) & ~bad)
    return rows.select("id", F.transform(x, lambda v: F.floor(v * 64).cast("double")).alias("v"))


def _gram(rows: DataFrame, dim: int, count: int) -> np.ndarray:
    """The dim x dim matrix of second moments of about ROTATION_ROWS of the rows (those with the lowest hash of their id): an array for each of eight tasks."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["g"])

    if count > ROTATION_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(1 << 40)) < ROTATION_ROWS * (1 << 40) // count).repartition(8)
    got = [np.asarray(r.g) for r in rows.select("v").coalesce(8).mapInArrow(sums, "g array<double>").collect()]  # at most eight arrays
    return sum(got).reshape(dim, dim) if got else np.eye(dim)


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(col.flatten()).reshape(-1, dim)


def _best(query: np.ndarray, qid: np.ndarray, floor_: np.ndarray, cand: np.ndarray, cid: np.ndarray, norm: np.ndarray, rotation: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per query its k largest products among candidates sorted by descending norm: row of the query, candidate id, product.

    floor_ is a product that k candidates of the query reach already (-inf: unknown); what is surely below is not looked at.
    """
    head = max(1, int(np.ceil(query.shape[1] * HEAD_SHARE)))
    q, c = query @ rotation, cand @ rotation
    q_rest, c_rest = np.sqrt((q[:, head:] ** 2).sum(1)), np.sqrt((c[:, head:] ** 2).sum(1))
    q_norm = np.sqrt((query**2).sum(1))
    low = floor_.copy()
    scores: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = 1_024
    for at in range(0, len(cand), step):
        end = min(at + step, len(cand))
        slack = EPS * (1 + q_norm * norm[at])
        live = np.flatnonzero(q_norm * norm[at] + slack >= low)  # the block's longest vector can't reach the others
        if not len(live):
            break
        part = q[live, :head] @ c[at:end, :head].T
        bound = part + np.outer(q_rest[live], c_rest[at:end]) + slack[live, None]
        r, j = np.nonzero(bound >= low[live, None])
        r = live[r]
        j += at
        keep = cid[j] != qid[r]
        r, j = r[keep], j[keep]
        if len(r) > DENSE * len(live) * (end - at):  # few are excluded: the whole block at once is cheaper
            whole = query[live] @ cand[at:end].T
            product = whole[np.searchsorted(live, r), j - at]
        else:
            product = np.einsum("ij,ij->i", query[r], cand[j])
        reach = product >= low[r]
        r, j, product = r[reach], j[reach], product[reach]
        scores.append((r, cid[j], product))
        if sum(len(x[0]) for x in scores) > 20 * k * len(query) or end == len(cand) or at == 0:
            scores = [_top(scores, k)]
            r, _, p = scores[0]
            full = np.bincount(r, minlength=len(query)) >= k
            least = np.full(len(query), np.inf)
            np.minimum.at(least, r, p)
            low = np.where(full, np.maximum(low, least), low)
    return _top(scores, k)


def _top(scores: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not scores:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    r, c, p = (np.concatenate(x) for x in zip(*scores, strict=True))
    order = np.lexsort((c, -p, r))
    r, c, p = r[order], c[order], p[order]
    first = np.searchsorted(r, r)
    keep = np.arange(len(r)) - first < k
    return r[keep], c[keep], p[keep]


def _classes(of_reach: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring reaches (reach, queries) put together until a class has QUERY_BLOCK queries: each class's least reach, and its queries."""
    out: list[tuple[int, int]] = []
    for reach, n in of_reach:
        if out and out[-1][1] < QUERY_BLOCK:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((reach, n))
    return out


def top_products(df: DataFrame, *, id_: str = "vec_id", vector: str = "embedding", queries: int = 20, k: int = 20) -> DataFrame:
    """For each row whose id is divisible by `queries`: its k largest whole-number inner products with the other rows.

    Returns query_id, rank (int, from 1), vec_id, score (long); all others if they are fewer than k; ties go to smaller ids. Vectors
    that are null, empty or hold null or non-finite components, and rows with a null id, take no part. Shorter vectors count as if zeros
    followed. Repeated rows are candidates of their own, but a query's own id never is its candidate; of a query id with
    different vectors the smallest vector, component by component, asks. An empty table gives an empty one, other columns are left out. Products are exact as long as they stay under 2**53.

    Candidates are dealt to bands by descending length. The band of the longest gives each query a score that k candidates
    reach; a query meets a further band only if its length times the band's largest can reach that. As longer bands come first,
    it so needs the first few; queries that need equally many are dealt to blocks together, and a band goes to the blocks that need it.
    """
    spark = df.sparkSession
    out = "query_id long, rank int, vec_id long, score long"
    rows = _vectors(df, id_, vector)
    one = rows.select(F.size("v").alias("n")).agg(F.max("n")).first()[0]
    if one is None:
        return spark.createDataFrame([], out)
    dim = int(one)
    padded = F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).otherwise(F.col("v"))
    rows = stored(rows.withColumn("v", padded).withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v))), "vectors")
    # bands of candidates: ranges of the length; a band's rows are dealt by id to pieces of about CANDIDATE_BLOCK rows
    count = rows.count()
    parts = min(BANDS, max(1, -(-count // CANDIDATE_BLOCK)))
    edges = sorted(set(rows.select(F.percentile_approx("norm", [i / parts for i in range(1, parts)], 10_000)).first()[0]), reverse=True) if parts > 1 else []
    band = F.lit(0)
    for i, e in enumerate(edges, 1):
        band = F.when(F.col("norm") < e, i).otherwise(band)
    banded = rows.withColumn("band", band)
    sizes = {r.band: r for r in banded.groupBy("band").agg(F.count("*").alias("c"), F.max("norm").alias("longest")).collect()}  # at most BANDS rows
    pieces = {b: -(-r.c // CANDIDATE_BLOCK) for b, r in sizes.items()}
    n_pieces = F.element_at(F.array(*[F.lit(pieces.get(b, 1)) for b in range(max(sizes) + 1)]), F.col("band") + 1)
    cands = banded.withColumn("piece", F.pmod(F.xxhash64("id"), n_pieces).cast("int"))
    every = stored(rows.where(F.pmod("id", F.lit(queries)) == 0).groupBy("id").agg(F.min("v").alias("v")), "queries")
    every = every.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v * v)))
    q_blocks = max(1, -(-every.count() // QUERY_BLOCK))
    asked = every.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(q_blocks)))
    rotation = np.linalg.eigh(_gram(rows, dim, count))[1][:, ::-1].copy()  # the right singular vectors, the largest first

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        q, c = group[group["side"] == 0], group[group["side"] == 1].sort_values("x", ascending=False, kind="stable")
        if not len(q) or not len(c):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        low = q["x"].to_numpy(float)
        r, who, p = _best(np.stack(q["v"].to_numpy()), q["id"].to_numpy(), np.where(np.isnan(low), -np.inf, low), np.stack(c["v"].to_numpy()), c["id"].to_numpy(), c["x"].to_numpy(), rotation, k)
        return pd.DataFrame({"query_id": q["id"].to_numpy()[r], "vec_id": who, "score": p.astype(np.int64)})

    def met(q: DataFrame, c: DataFrame) -> DataFrame:
        """Products of the queries (block, bands, id, v, low) with the candidates of their bands; a block meets each piece in one task."""
        left = q.select("block", F.explode("bands").alias("band"), "id", "v", "low")
        n = F.element_at(F.array(*[F.lit(pieces.get(b, 1)) for b in range(max(sizes) + 1)]), F.col("band") + 1)
        left = left.select("block", "band", F.explode(F.sequence(F.lit(0), n - 1)).alias("piece"), F.lit(0).alias("side"), "id", "v", F.col("low").alias("x"))
        # candidates go to the blocks that have a query which reaches their band, and to no other
        need = stored(q.select("block", F.explode("bands").alias("band")).distinct(), "needs")
        need = F.broadcast(need) if need.count() <= BROADCAST_ROWS else need
        right = c.join(need, "band").select("block", "band", "piece", F.lit(1).alias("side"), "id", "v", F.col("norm").alias("x"))
        return left.unionByName(right).groupBy("block", "band", "piece").applyInPandas(compare, "query_id long, vec_id long, score long")

    top = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda s: s.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k)
    best = min(sizes)
    first = ranked(met(asked.select("block", F.array(F.lit(best)).alias("bands"), "id", "v", F.lit(None).cast("double").alias("low")), cands.where(F.col("band") == best)))
    further = sorted(b for b in sizes if b != best)
    if further:
        first = stored(first, "products")
        low = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("low"))
        known = asked.join(low, asked["id"] == low["query_id"], "left")
        reaches = [F.when(F.col("low").isNull() | (F.col("norm") * sizes[b].longest * (1 + EPS) + EPS >= F.col("low")), F.lit(b)) for b in further]
        known = stored(known.withColumn("bands", F.array_compact(F.array(*reaches))).withColumn("reach", F.size("bands")), "known")
        # classes of queries that need about equally many bands, each of a block at least
        of_reach = sorted((r.reach, r.n) for r in known.groupBy("reach").agg(F.count("*").alias("n")).collect())  # at most BANDS rows
        classes, cls = _classes(of_reach), F.lit(0)
        for i, (least, _) in enumerate(classes):
            cls = F.when(F.col("reach") >= least, i).otherwise(cls)
        n_blocks = F.element_at(F.array(*[F.lit(-(-n // QUERY_BLOCK)) for _, n in classes]), F.col("class") + 1)
        known = known.withColumn("class", cls).withColumn("block", F.col("class") * F.lit(1 << 40) + F.pmod(F.xxhash64("id", F.lit(1)), n_blocks))
        others = met(known, cands.where(F.col("band") != best))
        first = ranked(first.select("query_id", "vec_id", "score").unionByName(others))
    return first.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
