"""Near-duplicate documents by HyperMinHash: compressed registers, banding, corrected estimates, exact confirmation."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import grams, is_empty, mixed, runs, stored, word_hashes

#: Buckets in a band. Long texts get so many bands that links miss each other in all of them less than once in 10**8.
PER_BAND, MISS = 6, 1e-8
#: Short texts get fewer, so that a band holds some shingles of theirs and a passage in common isn't enough to meet: sizes from
#: one bound to the next make a class with as many bands as a link may have differing shingles, and some more.
BOUNDS = (1, 12, 18, 27, 40, 60, 90, 135, 200, 300)
#: A link of a set with fewer shingles is found by single shingles too, as all it shares may fall into the bands of what differs.
SINGLE_BELOW = 12
#: Bits of a register kept after the leading one; the leading zeros have six more. In bands of short texts few registers are
#: filled, so they keep more bits there: about KEY_BITS in all, in the registers that a class's smallest sets fill.
LEAST_MANTISSA, MOST_MANTISSA, KEY_BITS = 10, 42, 60
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
SHINGLE = 5
#: Shingles that one task compares at once, and documents.
BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 8_192
#: Larger groups are tied to a hub this often before what is left is dealt to pairs of blocks; documents that a task compares with a hub.
STARS, STAR_DOCS = 3, 1_024
#: Only sets of at least so many shingles are judged by the estimate, and it must be this far below.
ESTIMATE_FROM, ESTIMATE_SLACK, SKETCH_BANDS, SKETCH_MANTISSA = 300, 0.2, 40, 6
BATCH_BYTES = 1 << 20
#: Names that columns of docs are unlikely to have.
_D, _T, _C = "_near_id_7f31", "_near_hash_7f31", "_near_copies_7f31"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> list[np.ndarray]:
    """For each text its distinct shingles of k words (A-Z lower-cased) as sorted 64-bit hashes; of fewer words, one shingle."""
    _, _, _, words, bounds = word_hashes(texts, lower=True)
    found, _ = grams(words, bounds, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= k:
            h = np.sort(found[a : b - k + 1])
            out.append(h[np.r_[True, h[1:] != h[:-1]]])
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for w in words[a:b]:
                h = mixed(h * _GOLD + w)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def classes(t: float) -> list[int]:
    """Bands of each size class for links of similarity t."""
    most = int(np.ceil(np.log(MISS) / np.log(1 - t**PER_BAND)))
    return [min(most, max(8, int(np.ceil(1.15 * upper * (1 - t) / t)) + 1)) for upper in (*BOUNDS[1:], 1 << 40)]


def size_class(n: int) -> int:
    return bisect_right(BOUNDS, n) - 1


def mantissa(lower: int, bands: int) -> int:
    """Bits after the leading one in the registers of a class whose smallest sets have `lower` shingles."""
    filled = PER_BAND * -np.expm1(-lower / (bands * PER_BAND))
    return int(np.clip(np.ceil(KEY_BITS / filled), LEAST_MANTISSA, MOST_MANTISSA))


def registers(hashes: np.ndarray, bands: int, bits: int = SKETCH_MANTISSA) -> np.ndarray:
    """HyperMinHash registers of a sorted set of 64-bit hashes.

    The hash's high part deals it to a bucket; of the smallest rest in a bucket, the register has the number of leading
    zeros and the `bits` after the leading one.
    """
    out = np.full(bands * PER_BAND, EMPTY, np.uint64)
    if not len(hashes):
        return out
    high = (hashes >> np.uint64(32)) * np.uint64(bands * PER_BAND)
    bucket = (high >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    # within a bucket hashes ascend, and so does the rest: position inside the bucket, in 56 bits
    rest = ((high[first] & np.uint64(0xFFFFFFFF)) << np.uint64(24)) | ((hashes[first] & np.uint64(0xFFFFFFFF)) >> np.uint64(8))
    rest = np.maximum(rest, np.uint64(1))
    top = np.frexp(rest.astype(np.float64))[1] - 1
    top = np.where(rest >> top.astype(np.uint64) == 0, top - 1, top)  # a float may round up to the next power of two
    shift = np.maximum(top - bits, 0).astype(np.uint64)
    tail = (rest >> shift) & np.uint64((1 << bits) - 1)
    out[bucket[first]] = (np.minimum(55 - top, 62).astype(np.uint64) << np.uint64(bits)) | tail
    return out


_OCTAVES = 2.0 ** -np.arange(56)


def agreement(n: float, m: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Chance that registers of different minima agree, for sets of n and (each of) m hashes dealt to so many buckets.

    With x hashes to a bucket the minimum lies in the octave below 2**-k with a chance of exp(-x / 2**(k + 1)) - exp(-x / 2**k),
    and there it has one of 2**bits mantissas.
    """

    def share(x: np.ndarray) -> np.ndarray:
        x = np.maximum(np.asarray(x, float), 1e-9)[..., None] / buckets
        return (np.exp(-x * _OCTAVES / 2) - np.exp(-x * _OCTAVES)) / -np.expm1(-x)

    return (share(n) * share(m)).sum(axis=-1) * 2.0**-bits


def estimate(a: np.ndarray, b: np.ndarray, n: float, m: np.ndarray, bits: int = SKETCH_MANTISSA) -> np.ndarray:
    """Jaccard estimates between the sketch of a set of n hashes and others (rows of b) of m, corrected for registers that agree by chance."""
    some, both = (a != EMPTY) | (b != EMPTY), (a != EMPTY) & (b != EMPTY)
    chance = agreement(n, m, a.shape[-1], bits)
    # of the registers that both have filled, those of different minima agree by chance
    same = (((a == b) & both).sum(axis=-1) - chance * both.sum(axis=-1)) / (1 - chance)
    return np.clip(same / np.maximum(some.sum(axis=-1), 1), 0, 1)


def single_keys(hashes: np.ndarray, t: float) -> np.ndarray:
    """Keys of single shingles, for sets that may link to one of under SINGLE_BELOW shingles; bands may miss such links, these can't.

    Linked sets share t of either's shingles at least, so the first they share is among the first n - t * n + 1 of each, in the
    order of hashes.
    """
    n = len(hashes)
    if n * t >= SINGLE_BELOW:
        return np.zeros(0, np.int64)
    return mixed(hashes[: n - int(np.ceil(t * n - 1e-9)) + 1] * _GOLD + np.uint64(SHINGLE)).view(np.int64)


def band_keys(hashes: np.ndarray, t: float) -> np.ndarray:
    """64-bit keys of the bands that have a filled bucket, in the set's size class and in any class above that a link may be in; and single_keys."""
    n, out = len(hashes), [np.zeros(0, np.int64)]
    if n:
        out.append(single_keys(hashes, t))
    per_class = classes(t)
    for c in range(size_class(n), size_class(int(n / t)) + 1) if n else ():
        bands = registers(hashes, per_class[c], mantissa(BOUNDS[c], per_class[c])).reshape(-1, PER_BAND)
        key = mixed(np.arange(1, len(bands) + 1, dtype=np.uint64) + np.uint64(c << 32))
        for i in range(PER_BAND):
            key = mixed(key * _GOLD + bands[:, i])
        out.append(key[(bands != EMPTY).any(axis=1)].view(np.int64))
    return np.concatenate(out)


_SKETCH = "n_shingles long, s1 long, s2 long, bands array<long>"


def sketched(docs: DataFrame, text: str, keep: list[str], t: float) -> DataFrame:
    """The columns `keep`, the number of shingles, a 128-bit digest of the set and the keys of its bands; no shuffle."""
    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(_SKETCH).fields)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches, text, BATCH_BYTES):
            n, digest, keys = [], [], []
            for h in shingle_sets(texts):
                n.append(len(h))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                keys.append(band_keys(h, t))
            two = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            at = pa.array(np.r_[0, np.cumsum([len(k) for k in keys])], pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(n, pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), lists], schema.names)

    return docs.select(*keep, text).mapInArrow(compute, schema)


def linked(flat: np.ndarray, size: np.ndarray, side: np.ndarray, numerator: int, denominator: int) -> np.ndarray:
    """For each set the smallest index that links connect it with. flat: the sets' sorted hashes after each other.

    A link: denominator * intersection >= numerator * union. Exact: sets that link share one of their first
    size - ceil(t * size) + 1 shingles in the order of rarity; those found so are confirmed on full sets unless the size
    or the estimate already excludes them. Whole groups are first compared with a few sets of theirs at once, so that of many
    near copies only those are looked at one by one which no such set ties. size is never 0. With two sides, only links between the
    sides count; a side 1 of a single set is a hub, and nothing but links with it is looked for.
    """
    n = len(size)
    label = np.arange(n)
    if n < 2:
        return label
    t = numerator / denominator
    start = np.r_[0, np.cumsum(size)]
    if (side == 1).sum() == 1:
        i = int(np.argmax(side == 1))
        mine = np.sort(flat[start[i] : start[i + 1]])
        inter = np.add.reduceat(mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat, start[:-1], dtype=np.int64)
        hit = denominator * inter >= numerator * (size[i] + size - inter)
        label[hit] = np.flatnonzero(hit)[0]
        return label
    own = np.repeat(np.arange(n), size)
    value, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    rank_of = np.empty(len(value), np.int64)
    rank_of[np.lexsort((value, count))] = np.arange(len(value))
    rank = rank_of[place]
    order = np.lexsort((rank, own))
    prefix = size - np.ceil(t * size - 1e-9).astype(np.int64) + 1
    use = np.arange(len(flat)) - start[own] < prefix[own]
    # shingles of these prefixes that several sets have there, and who has them
    by = np.lexsort((own[use], rank[order][use]))
    r, o = rank[order][use][by], own[use][by]
    begin = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])

    def open_groups(begin: np.ndarray) -> np.ndarray:
        end = np.r_[begin[1:], len(r)] if len(begin) else begin
        return (np.minimum.reduceat(label[o], begin) != np.maximum.reduceat(label[o], begin)) & (end - begin > 1) if len(begin) else np.zeros(0, bool)

    def confirmed(inter: np.ndarray, i: int, others: np.ndarray) -> np.ndarray:
        return denominator * inter >= numerator * (size[i] + size[others] - inter)

    def join(i: int, j: int) -> None:
        a, b = sorted((label[i], label[j]))
        label[label == b] = a

    two = len(np.unique(side)) > 1
    tried = np.zeros(n, bool)
    for _ in range(8):
        # the set that most others may still link with is compared with all at once
        many = np.bincount(o[np.repeat(open_groups(begin), np.diff(np.r_[begin, len(r)]))], minlength=n)
        many[tried] = 0
        i = int(np.argmax(many))
        if many[i] == 0 or n < 16:
            break
        tried[i] = True
        inside = np.zeros(len(value), np.int64)
        inside[place[start[i] : start[i + 1]]] = 1
        hit = confirmed(np.add.reduceat(inside[place], start[:-1]), i, np.arange(n))
        if two:
            hit &= side != side[i]
        for j in np.unique(label[hit]).tolist():
            join(i, j)
    keep = open_groups(begin)
    regs = [registers(flat[a:b].view(np.uint64), SKETCH_BANDS) if b - a >= ESTIMATE_FROM else None for a, b in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)] if keep.any() else []
    ends = np.r_[begin[1:], len(r)]
    lists: dict[int, np.ndarray] = {int(r[b]): o[b:e] for b, e in zip(begin[keep].tolist(), ends[keep].tolist(), strict=True)}
    ranked = rank[order]
    for i in np.unique(np.concatenate(list(lists.values()))).tolist() if lists else ():
        near = [lists[x] for x in ranked[start[i] : start[i] + prefix[i]].tolist() if x in lists]
        found = np.unique(np.concatenate(near))
        found = found[(found < i) & (label[found] != label[i])]
        if two:
            found = found[side[found] != side[i]]
        lo, hi = np.minimum(size[found], size[i]), np.maximum(size[found], size[i])
        found = found[denominator * lo >= numerator * hi]
        if len(found) and size[i] >= ESTIMATE_FROM:
            large = size[found] >= ESTIMATE_FROM
            likely = np.ones(len(found), bool)
            if large.any():
                likely[large] = estimate(regs[i], np.array([regs[j] for j in found[large].tolist()]), size[i], size[found[large]]) >= t - ESTIMATE_SLACK
            found = found[likely]
        mine = flat[start[i] : start[i + 1]]
        for j in found.tolist():
            if label[i] == label[j]:
                continue
            other = flat[start[j] : start[j + 1]]
            inter = len(np.intersect1d(mine, other, assume_unique=True))
            if denominator * inter >= numerator * (int(size[i]) + int(size[j]) - inter):
                join(i, j)
    return label


def _confirm(numerator: int, denominator: int):
    def compute(group: pa.Table) -> pa.Table:
        group = group.select(["node", "side", "set"]).sort_by("node")
        node = group.column("node").to_numpy()
        first = np.r_[True, node[1:] != node[:-1]]
        if not first.all():  # repeated rows
            group, node = group.filter(pa.array(first)), node[first]
        sets = group.column("set").combine_chunks()
        size = np.diff(np.asarray(sets.offsets)).astype(np.int64)
        flat = np.asarray(sets.flatten())
        label = linked(flat, size, group.column("side").to_numpy(), numerator, denominator)
        out = pa.table({"u": pa.array(node, pa.int64()), "v": pa.array(node[label], pa.int64())})
        return out.filter(pa.array(node != node[label]))

    return compute


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept (doc_id is its component's smallest).

    Sets: distinct shingles of five words (A-Z lower-cased) of the whole text; shorter texts are one shingle; texts without
    words, and null, have none and link with nothing. Documents link if denominator * intersection >= numerator * union.
    Rows of one set share a component; rows with a null id are kept, and have a null component. Repeated rows give repeated
    rows; rows of one id with different texts are documents of their own. An empty table gives an empty one; further columns of
    docs are left out.

    Equal sets fold into one before anything is compared. Bands of registers decide which sets may link at all, the rarest
    shingles of those who with whom; full sets decide, in groups of a bounded size.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    out = _grouped(base, numerator, denominator).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", numerator: int = 80, denominator: int = 100) -> DataFrame:
    """Of each group of rows that links connect, the row of the smallest doc_id (of equal ids, the smallest hash of the text).

    Groups are those of near_duplicates, told apart even where two of them have the same smallest id. Rows without an id or
    without words are in no group and all stay.
    """
    id_, hash_ = F.col(doc_id).cast("long"), F.xxhash64(F.col(text).cast("string"))
    base = docs.select(id_.alias("doc_id"), F.col(text).cast("string").alias("body"), hash_.alias("th"))
    grouped = _grouped(base, numerator, denominator, ("th",)).where("node is not null")
    rows = grouped.groupBy("node", "doc_id", "th").agg(F.count("*").alias("copies"))
    chosen = rows.groupBy("node").agg(F.min(F.struct("doc_id", "th", "copies")).alias("r"))
    chosen = stored(chosen.select(F.col("r.doc_id").alias(_D), F.col("r.th").alias(_T), F.col("r.copies").alias(_C)), "chosen")
    alone = F.col(doc_id).isNull() | F.col(text).isNull() | ~F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]")
    mine = docs.where(~alone).join(chosen, (id_ == F.col(_D)) & (hash_ == F.col(_T)))
    single, repeated = mine.where(F.col(_C) == 1), mine.where(F.col(_C) > 1).dropDuplicates([_D, _T])
    return single.unionByName(repeated).select(*docs.columns).unionByName(docs.where(alone))


def _grouped(base: DataFrame, numerator: int, denominator: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """Of each row doc_id, the columns `keep`, n_shingles, node (the same number for all of a group; null without words or id), component_id."""
    t = numerator / denominator
    rows, sets = _folded(base, ["doc_id", *keep], t)
    links = _links(_candidates(base, rows, sets, t), numerator, denominator)
    final = stored(sets.join(links, "node", "left").select("s1", "s2", "least", F.coalesce("component", "node").alias("node")), "groups")
    # a component's name is the smallest id of its sets
    names = final.groupBy("node").agg(F.min("least").alias("name"))
    final = final.join(names, "node").select("s1", "s2", "node", "name")
    out = rows.select("doc_id", *keep, "n_shingles", "s1", "s2").join(final, ["s1", "s2"], "left")
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return out.select("doc_id", *keep, "n_shingles", F.when(some, F.col("node")).alias("node"), F.when(some, F.col("name")).otherwise(F.col("doc_id")).alias("component_id"))


def _folded(base: DataFrame, keep: list[str], t: float) -> tuple[DataFrame, DataFrame]:
    """Sketches of all rows, and the different sets: s1, s2, least (the smallest id that has it), node (a number of its own)."""
    rows = stored(sketched(base, "body", keep, t), "sketches")
    sets = rows.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("least"))
    sets = stored(sets, "sets")
    several = sets.groupBy("least").agg(F.count("*").alias("n")).where("n > 1").select("least")
    if is_empty(several):
        return rows, sets.withColumn("node", F.col("least"))
    # ids that stand for several sets: these get numbers that are no ids
    named = sets.join(several.withColumn("_many", F.lit(True)), "least", "left")
    return rows, named.select("s1", "s2", "least", F.when(F.col("_many"), F.xxhash64("least", "s1", "s2")).otherwise(F.col("least")).alias("node"))


def _candidates(base: DataFrame, rows: DataFrame, sets: DataFrame, t: float) -> DataFrame:
    """node, n and set (sorted hashes of its shingles) of the sets that share a band with another one."""
    first = rows.join(sets, (rows.doc_id == sets.least) & (rows.s1 == sets.s1) & (rows.s2 == sets.s2)).select("node", "bands")
    bands = first.select("node", F.explode("bands").alias("key"))
    several = bands.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key")
    nodes = bands.join(several, "key", "left_semi").select("node").distinct()
    wanted = sets.join(nodes, "node", "left_semi").select("least", "node", "s1", "s2")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part, texts in runs(batches, "body", BATCH_BYTES):
            out, sets_ = [], []
            for node, a, b, h in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), shingle_sets(texts), strict=True):
                if node != last and (a, b) == tuple(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64).tolist()):
                    last = node
                    out.append((node, len(h)))
                    sets_.append(h.view(np.int64))
            at = pa.array(np.r_[0, np.cumsum([len(h) for h in sets_])], pa.int32())
            lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate([np.zeros(0, np.int64), *sets_])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), lists], ["node", "n", "set"])

    # texts are shuffled once, at any size: the ids of candidates grow with the input. Rows come sorted by id, so repeated ones meet
    texts = base.join(wanted.hint("merge"), F.col("doc_id") == F.col("least")).select("body", "node", "s1", "s2")
    return stored(texts.mapInArrow(hashed, "node long, n long, set array<long>"), "candidates")


def _prefixes(cand: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(node, x): the shingles by which a set may meet those it links with.

    Sets that link share one of their first size - ceil(t * size) + 1 shingles in the order of rarity among the candidates.
    What a set has alone comes first in its order and ties it to nobody; if that is enough, it can link with nobody.
    """
    each = cand.select("node", F.explode("set").alias("x"))
    counted = each.groupBy("x").agg(F.count("*").alias("c"), F.min("node").alias("m"))
    alone = counted.where("c = 1").groupBy(F.col("m").alias("node")).agg(F.count("*").alias("own"))
    first = f"n - cast(ceil({numerator} * n / {denominator} - 1e-9) as long) + 1 - coalesce(own, 0)"
    open_ = cand.select("node", "n").distinct().join(alone, "node", "left").withColumn("k", F.expr(f"cast({first} as int)")).where("k > 0").select("node", "k")
    shared = cand.join(open_, "node").select("node", "k", F.explode("set").alias("x")).join(counted.where("c >= 2").select("x", "c"), "x")
    ranked = shared.groupBy("node", "k").agg(F.sort_array(F.collect_set(F.struct("c", "x"))).alias("s"))
    return stored(ranked.select("node", F.explode(F.expr("slice(s.x, 1, k)")).alias("x")), "prefixes")


def _met(prefix: DataFrame, n: int) -> DataFrame:
    """(node, cluster, x, family) of rows (node, cluster, x) whose x joins different clusters; family: the clusters that so hang together."""
    heads = prefix.groupBy("x").agg(F.min("cluster").alias("head"), F.max("cluster").alias("last")).where("head < last").select("x", "head")
    open_ = stored(prefix.join(heads, "x").select("node", "cluster", "head", "x"), "open", n)
    family = components(open_.where("cluster <> head").select(F.col("cluster").alias("u"), F.col("head").alias("v")))
    return open_.select("node", "cluster", "x").join(family.select(F.col("node").alias("cluster"), F.col("component").alias("family")), "cluster")


def _links(cand: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(node, component) of confirmed links among candidates.

    Groups that a task can hold are confirmed whole. Of a larger one, all are compared with a hub, and those that link with it
    are one cluster; what then still joins different clusters is grouped anew. After STARS hubs, blocks meet blocks.
    """
    confirm = _confirm(numerator, denominator)
    pairs = "u long, v long"

    def checked(tasks: DataFrame) -> DataFrame:
        work = cand.join(tasks, "node").select("node", "set", "family", "block", "side")
        return work.groupBy("family", "block").applyInArrow(confirm, pairs)

    prefix = _prefixes(cand, numerator, denominator).withColumn("cluster", F.col("node"))
    found: list[DataFrame] = []
    for star in range(STARS + 1):
        n = prefix.count()
        met = stored(_met(prefix, n), "met", n)
        sized = stored(met.groupBy("node", "cluster", "family").agg(F.count("*").alias("shared")).join(cand.select("node", "n").distinct(), "node"), "families", n)
        total = sized.groupBy("family").agg(F.sum("n").alias("all_n"), F.count("*").alias("docs"))
        large = stored(total.where((F.col("all_n") > BLOCK_SHINGLES) | (F.col("docs") > BLOCK_DOCS)).select("family", "all_n", "docs"), "large", 0)
        small = sized.join(large, "family", "left_anti").select("node", F.col("family"), F.lit("").alias("block"), F.lit(0).alias("side"))
        if is_empty(large):
            found.append(checked(small))
            break
        found.append(stored(checked(small), "links"))
        rest = sized.join(large, "family")
        if star == STARS:
            found.append(stored(checked(stored(_blocks(rest, numerator, denominator), "blocks")), "links"))
            break
        hubs = rest.groupBy("family").agg(F.max(F.struct("shared", -F.col("node"))).alias("h")).select("family", (-F.col("h.col2")).alias("hub"))
        tied = stored(checked(_spokes(rest, hubs)), "links")
        found.append(tied)
        # whoever links with the hub takes its cluster along
        name = components(tied.unionByName(rest.where("node <> cluster").select(F.col("node").alias("u"), F.col("cluster").alias("v"))))
        left = met.join(large, "family", "left_semi").select("node", "cluster", "x")
        prefix = left.join(name, "node", "left").select("node", F.coalesce("component", "cluster").alias("cluster"), "x")
        prefix = stored(prefix, "prefixes", n)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return components(out)


def _spokes(rest: DataFrame, hubs: DataFrame) -> DataFrame:
    """Deal the sets of large families to blocks, each with the family's hub on side 1: by number and by shingles, as sets may be long."""
    salts = F.greatest(F.ceil(F.col("docs") / STAR_DOCS), F.ceil(2 * F.col("all_n") / BLOCK_SHINGLES)).cast("int")
    spokes = rest.join(hubs, "family").where("node <> hub").select("node", "family", F.pmod(F.xxhash64("node"), salts).cast("string").alias("block"), F.lit(0).alias("side"))
    used = rest.join(hubs, "family").where("node <> hub").select(F.col("hub").alias("node"), "family", F.pmod(F.xxhash64("node"), salts).cast("string").alias("block"))
    return spokes.unionByName(used.distinct().withColumn("side", F.lit(1)))


def _blocks(hot: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """Deal large families to pairs of blocks, ordered by size, whose sizes can link.

    A cell is a family's range of sizes: 2 % wide. Cells are cut by a hash of the node into blocks that fit a task.
    """
    cell = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.02)))).cast("long")
    cells = hot.withColumn("cell", cell)
    load = cells.groupBy("family", "cell").agg(F.sum("n").alias("w"), F.count("*").alias("c"))
    parts = load.withColumn("parts", F.greatest(F.ceil(2 * F.col("w") / BLOCK_SHINGLES), F.ceil(2 * F.col("c") / BLOCK_DOCS)).cast("int"))
    reach = int(np.ceil(np.log(denominator / numerator) / np.log(1.02))) + 1
    blocks = parts.select("family", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    a, b = blocks.alias("a"), blocks.alias("b")
    meets = a.join(b, (F.col("a.family") == F.col("b.family")) & (F.col("b.cell") >= F.col("a.cell")) & (F.col("b.cell") <= F.col("a.cell") + reach) & ((F.col("b.cell") > F.col("a.cell")) | (F.col("b.part") >= F.col("a.part"))))
    name = F.concat_ws("/", "a.cell", "a.part", "b.cell", "b.part")
    meets = meets.select(F.col("a.family").alias("family"), name.alias("block"), F.array(F.struct(F.col("a.cell").alias("cell"), F.col("a.part").alias("part"), F.lit(0).alias("side")), F.struct(F.col("b.cell").alias("cell"), F.col("b.part").alias("part"), F.lit(1).alias("side"))).alias("ends"))
    ends = meets.select("family", "block", F.explode("ends").alias("e")).select("family", "block", "e.cell", "e.part", "e.side").dropDuplicates(["family", "block", "cell", "part"])
    dealt = cells.join(parts.select("family", "cell", "parts"), ["family", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    return dealt.join(ends, ["family", "cell", "part"]).select("node", "family", "block", "side")
