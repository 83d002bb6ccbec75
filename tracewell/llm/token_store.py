"""Content-addressed store of token ids: rolling-hash chunks stored once, recipes per document, Merkle roots.

Files, all Parquet, under one folder of the shared file system:
  chunks   bucketed by address: unique chunks (address, n, ids), and the rows of recipes before they are put in order
  recipes  in ascending doc_id: uid, doc_id, n_tokens, the addresses of the document's chunks in order, its Merkle root, its place
           in the file and the ids before it there
  manifest a row for every BLOCK documents of a recipe file: documents, ids, first and last doc_id, and the Merkle root over their roots
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import mixed, no_shuffle_left, runs, scratch_path, stored
from .tokens import encoder

END_ID = 1
#: A chunk ends where the hash of the last WIDTH ids has BITS zero bits, between LEAST and MOST ids.
WIDTH, BITS, LEAST, MOST = 16, 10, 256, 4096
#: Addresses that a task remembers, so that copies it meets again bring no bytes.
SEEN = 400_000
BUCKETS_PER_PARTITION = 1
#: Documents of a recipe file under one row of the manifest.
BLOCK = 1_024
BATCH_BYTES = 1 << 20


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree over the leaves; an odd one moves up as it is; of no leaves, the hash of nothing."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [address(b"")]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[::2], level[1::2], strict=False)]
        level = pairs + level[len(pairs) * 2 :]
    return level[0]


def cuts(ids: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one document."""
    return np.array(next(document_cuts(ids, [0, len(ids)])))


def document_cuts(ids: np.ndarray, begin: list[int]) -> Iterator[list[int]]:
    """For each document, from one of `begin` to the next, the ends of its chunks. Equal runs of ids are cut alike wherever they
    stand, once a cut has been met."""
    hits: list[int] = []
    if len(ids) > LEAST:
        x = mixed(ids.astype(np.uint64) + np.uint64(1))
        m = 1
        while m < WIDTH:
            x = x[:-m] * np.uint64(0x9E3779B97F4A7C15) + x[m:]
            m *= 2
        # a cut is LEAST ids away from a document's start at least, so its WIDTH ids are all the document's
        hits = (np.flatnonzero(mixed(x) >> np.uint64(64 - BITS) == 0) + WIDTH).tolist()
    for at, n in itertools.pairwise(begin):
        out = []
        while n - at > LEAST:
            i = bisect_left(hits, at + LEAST)
            at = min(hits[i] if i < len(hits) else n, at + MOST, n)
            out.append(at)
        if at < n:
            out.append(n)
        yield out


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    chunks: DataFrame
    recipes: DataFrame
    manifest: DataFrame
    width: int


_ROW = "uid long, doc_id long, seq int, n int, address binary, ids binary, bucket_key binary"


def _encoded(docs: DataFrame, tokenizer: str, end_id: int, dtype: str) -> DataFrame:
    """A row per chunk of each document; ids only where the task has not met the address before."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        uid = TaskContext.get().partitionId() << 36
        seen: set[bytes] = set()
        for part, texts in runs(batches, "body", BATCH_BYTES):
            flat, size = encode(texts)
            ids = np.insert(flat, np.cumsum(size), end_id)
            begin = np.r_[0, np.cumsum(size + 1)].tolist()
            raw = memoryview(ids.astype(dtype).tobytes())
            width, out = len(raw) // len(ids), []
            for key, at, ends in zip(part.column(0).to_pylist(), begin, document_cuts(ids, begin), strict=False):
                for seq, end in enumerate(ends):
                    chunk = raw[at * width : end * width]
                    where = address(chunk)
                    if where in seen:
                        out.append((uid, key, seq, end - at, where, None, address(where + uid.to_bytes(8, "little"))))
                    else:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(where)
                        out.append((uid, key, seq, end - at, where, bytes(chunk), where))
                    at = end
                uid += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["uid", "doc_id", "seq", "n", "address", "ids", "bucket_key"])

    return docs.mapInArrow(compute, _ROW)


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by bucket_key, those with ids first, only the first of an address keeps its ids."""
    last = None
    for batch in batches:
        key, ids = batch.column(6).to_pylist(), batch.column(5).to_pylist()
        for i, k in enumerate(key):
            if k == last:
                ids[i] = None
            elif ids[i] is not None:
                last = k
        cols = list(batch.columns)
        cols[5] = pa.array(ids, pa.binary())
        yield pa.RecordBatch.from_arrays(cols, batch.schema.names)


def write(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> Store:
    """Encode every whole text (null: empty), append end_id, and store the ids.

    Rows keep their doc_id; null ids come first, repeated ones in the order of their rows' uids. No rows: an empty store.
    """
    spark = docs.sparkSession
    size = encoder(tokenizer).size
    dtype = "<u2" if size <= 1 << 16 else "<u4"
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("body"))
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * BUCKETS_PER_PARTITION
    name = f"tracewell_chunks_{uuid.uuid4().hex}"
    rows = _encoded(base, tokenizer, end_id, dtype).repartition(buckets, "bucket_key").sortWithinPartitions(F.col("bucket_key"), F.col("ids").isNull(), "uid", "seq").mapInArrow(_once, _ROW)
    with no_shuffle_left(spark):
        # the rows are in their buckets already; a bucketed table lets later joins on the address leave the bytes where they are
        rows.write.bucketBy(buckets, "bucket_key").option("path", scratch_path(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, and chunks knows them with their buckets
    addresses = F.sort_array(F.collect_list(F.struct("seq", "address"))).getField("address")
    recipes = chunks.groupBy("uid", "doc_id").agg(F.sum("n").cast("long").alias("n_tokens"), addresses.alias("addresses"))

    def rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, place, inside = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            roots = [merkle(a) for a in batch.column(3).to_pylist()]
            n = batch.column(2).to_numpy()
            before = inside + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary()), pa.array([file] * len(batch), pa.int32()), pa.array(np.arange(place, place + len(batch))), pa.array(before)], [*batch.schema.names, "root", "file", "place", "before"])
            place, inside = place + len(batch), inside + int(n.sum())

    ordered = recipes.repartitionByRange("doc_id", "uid").sortWithinPartitions("doc_id", "uid")
    recipes = stored(ordered.mapInArrow(rooted, "uid long, doc_id long, n_tokens long, addresses array<binary>, root binary, file int, place long, before long"), "recipes")
    return Store(spark, chunks, recipes, stored(_topped(recipes), "manifest"), 2 if dtype == "<u2" else 4)


_MANIFEST = "file int, block long, documents long, ids long, before long, first_id long, last_id long, ordered boolean, root binary"


def _topped(recipes: DataFrame) -> DataFrame:
    """The manifest of recipes: a row for every BLOCK documents of a file, with the Merkle root over their roots in order."""
    each = F.sort_array(F.collect_list(F.struct("place", "doc_id", "uid", "n_tokens", "before", "root")))
    blocks = recipes.groupBy("file", F.floor(F.col("place") / BLOCK).alias("block")).agg(each.alias("d"))

    def topped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, block, docs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = [(d["doc_id"] is not None, d["doc_id"] or 0, d["uid"]) for d in docs]
                ordered = key == sorted(key) and all(b["before"] == a["before"] + a["n_tokens"] and b["place"] == a["place"] + 1 for a, b in itertools.pairwise(docs))
                out.append((file, block, len(docs), sum(d["n_tokens"] for d in docs), docs[0]["before"], docs[0]["doc_id"], docs[-1]["doc_id"], ordered, merkle([d["root"] for d in docs])))
            kinds = [pa.int32(), *[pa.int64()] * 6, pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in _MANIFEST.split(", ")])

    return blocks.mapInArrow(topped, _MANIFEST)


def verify(store: Store) -> None:
    """Raises unless the recipes of every block give the manifest's Merkle root and its numbers of documents and ids, and all are in order."""
    said, found = store.manifest.alias("m"), _topped(store.recipes).alias("r")
    same = F.col("r.ordered")
    for c in store.manifest.columns:
        same = same & F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}"))
    joined = said.join(found, (F.col("m.file") == F.col("r.file")) & (F.col("m.block") == F.col("r.block")), "full")
    bad = joined.where(~F.coalesce(same, F.lit(False))).select(F.coalesce("m.file", "r.file")).head()
    if bad is None:  # blocks in order in their file, and files among each other
        w = Window.partitionBy("file").orderBy("block")
        least = F.lit(-(1 << 63))
        next_ = F.lead(F.coalesce("first_id", least)).over(w)
        bad = store.manifest.select("file", (F.coalesce("last_id", least) > next_).alias("late"), (F.col("before") + F.col("ids") != F.lead("before").over(w)).alias("gap")).where("late or gap").head()
    if bad is None:
        files = store.manifest.groupBy("file").agg(F.min(F.coalesce("first_id", least)).alias("a"), F.max(F.coalesce("last_id", least)).alias("z"))
        bad = files.withColumn("next", F.lead("a").over(Window.orderBy("file"))).where("z > next").head()
    if bad is not None:
        raise ValueError(f"the recipes of file {bad[0]} don't match the Merkle manifest")


def starts(store: Store) -> DataFrame:
    """file and the ids of all files before, from the manifest's sums: a row per recipe file."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return store.manifest.groupBy("file").agg(F.sum("ids").alias("ids")).select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset"))


def read(store: Store) -> DataFrame:
    """Every document from the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, binary).

    Raises at once if recipes don't match the manifest; and, as documents are read, where a chunk doesn't hash to its address or a
    document's addresses don't give its Merkle root. Documents of one root have the same ids, which are put together once.
    """
    verify(store)
    width = store.width
    # copies of one input partition are put together once; a document with many copies has a row for each such partition
    recipes = store.recipes.withColumn("part", F.shiftright("uid", 36))
    different = recipes.groupBy("root", "part").agg(F.first("addresses").alias("addresses"))
    pieces = different.select("root", "part", F.posexplode("addresses").alias("seq", "bucket_key"))
    chunks = store.chunks.where("ids is not null").select("bucket_key", "ids")
    placed = pieces.join(chunks, "bucket_key", "left").select("root", "part", "seq", F.col("bucket_key").alias("address"), "ids")
    whole = placed.groupBy("root", "part").agg(F.sort_array(F.collect_list(F.struct("seq", "address", "ids"))).alias("c")).select("root", "part", "c.address", "c.ids")

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids = None, b""
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                out = []
                for root, n, where, chunks_ in zip(*(part.column(k).to_pylist() for k in (0, 3, 4, 5)), strict=True):
                    if root != last:
                        if where is None or len(where) != len(chunks_) or any(c is None or address(c) != a for a, c in zip(where, chunks_, strict=True)):
                            raise ValueError("a chunk is missing or doesn't match its address")
                        if merkle(where) != root:
                            raise ValueError("a document doesn't match its Merkle root")
                        last, ids = root, np.frombuffer(b"".join(chunks_), f"<u{width}").astype("<u4").tobytes()
                    if len(ids) != 4 * n:
                        raise ValueError("a document has another number of ids")
                    out.append(ids)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.array(out, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    info = recipes.join(F.broadcast(starts(store)), "file").select("root", "part", "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens")
    out = info.join(whole, ["root", "part"], "left").select("root", "doc_id", "start", "n_tokens", "address", "ids")
    return out.mapInArrow(rebuilt, "doc_id long, start long, n_tokens long, ids binary")
