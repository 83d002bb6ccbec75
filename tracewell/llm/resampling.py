"""Importance resampling towards a target: documents whose words are commoner in the target than in the corpus are drawn first.

Words go to hash buckets. Each task writes the buckets of its documents as packed streams of unsigned 16-bit numbers, with the
place where each document ends. Counts come from sorting each stream and encoding its runs; the streams are read once more to
gather each document's gains, which are summed between its bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import runs, stored

BUCKETS = 10_000
#: Bytes of text that become one stream.
STREAM_BYTES = 4 << 20
#: Longer features are hashed one by one, shorter ones a byte of each at a time.
LONG = 48

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ np.where(c & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return c


_CRC = _crc_table()


def crc32_of_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of the bytes: a byte of every span that is long enough at a time."""
    size = end - start
    order = np.argsort(size, kind="stable")
    s, n = start[order], size[order]
    state = np.full(len(s), 0xFFFFFFFF, np.uint32)
    short = int(np.searchsorted(n, LONG, "right"))
    for k in range(int(n[short - 1]) if short else 0):
        first = int(np.searchsorted(n, k, "right"))
        x = state[first:short]
        state[first:short] = _CRC[(x ^ data[s[first:short] + k]) & np.uint32(0xFF)] ^ (x >> np.uint32(8))
    state ^= np.uint32(0xFFFFFFFF)
    whole = memoryview(data)
    for i in range(short, len(s)):
        state[i] = zlib.crc32(whole[s[i] : s[i] + n[i]])
    out = np.empty_like(state)
    out[order] = state
    return out


def features(texts: list[bytes], longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to `longest` words, document by document; each document's features and words."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    word = _WORD[data]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    length = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    bounds = np.searchsorted(start, np.r_[0, np.cumsum(length)])
    n_words = np.diff(bounds)
    if longest > 1:  # words side by side with one space between
        size = end - start
        new_end = np.cumsum(size + 1) - 1
        spaced = np.full(int(new_end[-1]) + 1 if len(new_end) else 0, 0x20, np.uint8)
        new_start = new_end - size
        spaced[np.arange(len(spaced))[np.repeat(new_start, size) + _within(size)]] = data[word]
        data, start, end = spaced, new_start, new_end
    text = np.repeat(np.arange(len(texts)), n_words)
    got, owner = [], []
    for k in range(min(longest, len(start))):
        inside = text[: len(text) - k] == text[k:]
        got.append(crc32_of_spans(data, start[: len(start) - k][inside], end[k:][inside]) % np.uint32(buckets))
        owner.append(text[: len(text) - k][inside])
    stream = np.concatenate(got).astype(np.uint16) if got else np.zeros(0, np.uint16)
    if longest > 1 and got:
        stream = stream[np.argsort(np.concatenate(owner), kind="stable")]
    held = np.zeros(len(texts), np.int64)
    for k in range(longest):
        held += np.maximum(n_words - k, 0)
    return stream, held, n_words


def _within(size: np.ndarray) -> np.ndarray:
    """0 to size - 1 for each size, one after the other."""
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)


def streams(docs: DataFrame, key: str, text: str = "text", longest: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """A row per some megabytes of text: keys of its documents, their features and words, and the packed stream of buckets.

    keys (array), n_features and n_words (binary, little-endian 64-bit), stream (binary, little-endian unsigned 16-bit).
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must fit 16 bits")
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("body"))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in runs(batches, "body", STREAM_BYTES):
            stream, held, n_words = features(texts, longest, buckets)
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([held.astype("<i8").tobytes()]), pa.array([n_words.astype("<i8").tobytes()]), pa.array([stream.astype("<u2").tobytes()])], ["keys", "n_features", "n_words", "stream"])

    return rows.mapInArrow(compute, "keys array<bigint>, n_features binary, n_words binary, stream binary")


def counts(packed: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all streams: each is sorted and its runs are counted; the sums of a task meet in Spark.

    What comes to the driver is one number per bucket.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                x = np.sort(np.frombuffer(blob.as_buffer() or b"", "<u2"), kind="stable")
                if len(x):
                    at = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                    total[x[at]] += np.diff(np.r_[at, len(x)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    got = packed.select("stream").mapInArrow(compute, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log of its smoothed share of the target over that of the corpus, floored."""
    s, t, n = corpus.astype(float), target.astype(float), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def weighed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, n_features, n_words and weight: the floored mean of the gains of a document's features (none: 0)."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                keys = batch.column(0)[i].values
                held, n_words, stream = (np.frombuffer(batch.column(k)[i].as_buffer() or b"", kind) for k, kind in ((1, "<i8"), (2, "<i8"), (3, "<u2")))
                total, some = np.zeros(len(held), np.int64), held > 0
                if some.any():
                    total[some] = np.add.reduceat(gain[stream], (np.cumsum(held) - held)[some])
                yield pa.RecordBatch.from_arrays([keys, pa.array(held), pa.array(n_words), pa.array(total // np.maximum(held, 1))], ["key", "n_features", "n_words", "weight"])

    return packed.select("keys", "n_features", "n_words", "stream").mapInArrow(compute, "key long, n_features long, n_words long, weight long")


def noise(key: Column, seed: int) -> Column:
    """1000 times a Gumbel variate that depends on the key and the seed alone, floored; a null key counts as an empty string."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resampled(docs: DataFrame, target: DataFrame, *, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text", longest: int = 1, buckets: int = BUCKETS, percent: int = 10, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """Every document with n_features, weight, score and rank (long; null where it isn't drawn), columns doc_id first.

    Drawn is the floored `percent` of the documents with `least_words` words, by descending score, ties by ascending id; adding
    Gumbel noise to log weights and taking the highest is a sample without replacement in proportion to the weights. Words are
    runs of ASCII letters, digits and other characters from 0x80, A-Z lower-cased. Null and empty texts have no features and
    weigh 0; a null id ranks behind all others of its score; rows of one id count each. An empty target gives gains from the
    corpus alone, an empty corpus an empty result. Texts pass once; what the driver gets is a number per bucket and a count per
    distinct score, and scores span at most some 100,000 whole numbers whatever the input. Ranks are given within each score,
    so no task orders more than the ties of one.
    """
    packed = stored(streams(docs, key, text, longest, buckets), "buckets")
    gain = gains(counts(packed, buckets), counts(streams(target, target_key, target_text, longest, buckets), buckets))
    rows = stored(weighed(packed, gain).withColumn("score", F.col("weight") + noise(F.col("key"), seed)), "weights")
    some = rows.where(F.col("n_words") >= least_words)
    histogram = some.groupBy("score").agg(F.count("*").alias("n")).toPandas().sort_values("score", ascending=False)
    score, n = histogram["score"].to_numpy(), histogram["n"].to_numpy()
    drawn = int(n.sum()) * percent // 100
    before = np.cumsum(n) - n
    spark = docs.sparkSession
    ahead = spark.createDataFrame(pa.table({"at": score[before < drawn], "ahead": before[before < drawn]}), "at long, ahead long")
    lowest = int(score[before < drawn].min()) if drawn else None
    open_ = (F.col("n_words") >= least_words) & (F.col("score") >= lowest) if drawn else F.lit(False)
    ranked = rows.where(open_).join(F.broadcast(ahead), F.col("score") == F.col("at"))
    place = F.row_number().over(_within_score())
    ranked = ranked.select("key", "n_features", "weight", "score", (F.col("ahead") + place).alias("rank"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(~open_).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest).withColumnRenamed("key", "doc_id")


def _within_score():
    from pyspark.sql import Window

    return Window.partitionBy("score").orderBy(F.col("key").asc_nulls_last(), "n_features", "weight")
