"""What the operators share: scratch tables in the cluster's shared folder, Arrow helpers, 64-bit mixing."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch folders of this process by owner, so that a finished owner's folders can be removed.
_FOLDERS: dict[str, list[str]] = {}
#: Whose scratch folders are made now. Threads have contexts of their own, so their runs don't touch each other's folders.
_OWNER: ContextVar[str] = ContextVar("owner", default="query")


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset (tests, one machine) a temporary one is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Rows of a small scratch table's file: tables of ids and links need few files.
FILE_ROWS = 100_000
#: Rows of an Arrow batch where the session has Spark's default of 10,000, which long texts make large.
BATCH_ROWS = "1000"


def modest(spark: SparkSession) -> SparkSession:
    """Let texts go to Python in smaller batches, unless the session says otherwise."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, BATCH_ROWS)
    return spark


def stored(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    rows: how many there are at most, if that is known; they go to as many files as so many rows fill.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    path = f"{scratch_root(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    _kept(spark, path)
    with no_shuffle_left(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def no_shuffle_left(spark: SparkSession):
    """Shuffle files of what is written in this block go as soon as it is written, as nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for files that an operator writes itself."""
    path = f"{scratch_root(spark)}/tracewell/{name}-{uuid.uuid4().hex}"
    _kept(spark, path)
    return path


def remove(spark: SparkSession, owner: str) -> None:
    """Delete the scratch folders that an owner whose results are written has left."""
    for path in _FOLDERS.pop(owner, []):
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _kept(spark: SparkSession, path: str) -> None:
    """Remember a folder: its owner may remove it, and what is left goes when the driver's process ends."""
    if not _FOLDERS:
        atexit.register(_end, spark)
    _FOLDERS.setdefault(_OWNER.get(), []).append(path)


def _end(spark: SparkSession) -> None:
    with contextlib.suppress(Exception):  # the session may have ended before
        for owner in list(_FOLDERS):
            remove(spark, owner)


def owned_by(owner: str) -> None:
    """Scratch folders that this thread makes from now on belong to this owner."""
    _OWNER.set(owner)


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts in column `name` hold about `most` bytes (at least one row); only a slice's texts are copied."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(name))), 0).to_numpy(zero_copy_only=False)
        end = np.cumsum(size.astype(np.int64))
        start = 0
        while start < len(batch):
            stop = max(start + 1, int(np.searchsorted(end, (end[start - 1] if start else 0) + most, "right")))
            part = batch.slice(start, stop - start)
            yield part, binary_column(part, name)
            start = stop


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (multiply, shift, multiply, shift), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def is_empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def uniform(*cols, seed: int = 0):
    """A number in (0, 1) that depends on the columns and the seed alone: 48 bits of an MD5, so that other engines can state it too."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[0x41:0x5B] = _BYTE[0x61:0x7B]
_BASE = 0xC2B2AE3D27D4EB4F
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, for n places at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 20)
        _POWERS[:] = [np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _POWERS[0], _POWERS[1]


def word_hashes(texts: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than 0x20 and 0x09-0x0D) of several texts at once.

    Gives the joined bytes, each word's start, end and 64-bit hash, and the index of each text's first word (and the end).
    With lower, A-Z count as a-z.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    power, back = _powers(len(data) + 1)
    edge = np.flatnonzero(np.diff(_SPACE[data].view(np.int8), prepend=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((_LOWER if lower else _BYTE)[data] * power[: len(data)], out=total[1:])
    hashes = mixed((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64))
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(start, np.r_[0, np.cumsum(length)])
    return data, start, end, hashes, bounds


def grams(hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each run of k words, by its first word, and whether the run lies within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : n + i])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    return out, text[:n] == text[k - 1 :]
