"""An extension: prior submissions kept up as they arrive, by state that is keyed by band of the signature.

Two submissions meet where a band of their signatures is equal. A submission waits in its bands until the watermark has passed its time,
and is then compared with those before it, so the answers don't depend on how the stream is cut into batches. The late-data rule is
the watermark's: what arrives later than `delay` behind the newest submission is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PLACE = "at long, slug string, owner string"
_FOUND = "slug string, at long, other string, other_at long, jaccard double"


def band_keys(signature: Column, bands: int) -> Column:
    """Number and hash of each band that a signature has, as text; a signature shorter than bands has a band of each value."""
    width = F.greatest(F.floor(F.size(signature) / bands).cast("int"), F.lit(1))
    n = F.least(F.lit(bands), F.size(signature))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(":", i.cast("string"), F.xxhash64(F.slice(signature, i * width + 1, width)).cast("string")))


class Band(StatefulProcessor):
    """State of one band: who waits, and of each signature seen the first submission and the first of another owner."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"{_PLACE}, signature array<bigint>")
        self.seen = handle.getMapState("seen", "signature array<bigint>", "at long, slug string, owner string, next_at long, next_slug string, next_owner string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        for df in rows:
            new = [(int(a), s, o, [int(v) for v in g]) for a, s, o, g in zip(df["ms"], df["slug"], df["owner"], df["signature"], strict=True)]
            self.waiting.appendList(new)
            for at in {x[0] for x in new}:
                self.handle.registerTimer(at)
        yield pd.DataFrame(columns=["slug", "at", "other", "other_at", "jaccard"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(((int(x[0]), x[1], x[2], tuple(int(v) for v in x[3])) for x in self.waiting.get()), key=lambda x: x[:2])
        due, later = [x for x in waiting if x[0] <= now], [x for x in waiting if x[0] > now]
        if due:  # the first timer of a time takes all that is due
            self.waiting.put([(*x[:3], list(x[3])) for x in later]) if later else self.waiting.clear()
            seen = {tuple(int(v) for v in k[0]): tuple(v) for k, v in self.seen.iterator()}
            out = [self._judged(x, seen) for x in due]
            yield pd.DataFrame(out, columns=["slug", "at", "other", "other_at", "jaccard"])

    def _judged(self, x: tuple, seen: dict) -> tuple:
        at, slug, owner, signature = x
        best = (0.0, 0, None)
        for other, (a, s, o, b, t, p) in seen.items():
            if len(other) != len(signature):
                continue
            free = [(w, n) for w, n, whose in ((a, s, o), (b, t, p)) if n is not None and n != slug and not (owner and owner == whose)]
            if free:
                j = int(sum(u == v for u, v in zip(signature, other, strict=True)) / len(signature) * 10000 + 0.5) / 10000
                best = min(best, (-j, *free[0])) if best[2] is not None else (-j, *free[0])
        a, s, o, b, t, p = seen.get(signature, (at, slug, owner, None, None, None))
        if signature in seen and t is None and slug != s and not (owner and owner == o):
            b, t, p = at, slug, owner
        if seen.get(signature) != (a, s, o, b, t, p):
            seen[signature] = (a, s, o, b, t, p)
            self.seen.updateValue((list(signature),), seen[signature])
        return (slug, at, best[2], best[1] if best[2] is not None else None, -best[0] if best[2] is not None else 0.0)

    def close(self) -> None:
        pass


def run(submissions: DataFrame, results: str, checkpoint: str, delay: str = "1 hour", bands: int = 32) -> StreamingQuery:
    """submissions (slug, owner, at, signature), a stream: to `results` go slug, at, other, jaccard of each, `other` null if none before it shares a band.

    The best is as in minhash.prior(): the highest estimated Jaccard, then the first to come. Times count in milliseconds. A batch
    that is repeated writes its own folder again. State grows with the different signatures of a band, not with their copies.
    """
    spark = submissions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = submissions.where(F.size("signature") > 0).withWatermark("at", delay)
    keyed = timed.select("at", F.unix_millis("at").alias("ms"), "slug", F.coalesce("owner", F.lit("")).alias("owner"), "signature", F.explode(band_keys(F.col("signature"), bands)).alias("band"))
    found = keyed.groupBy("band").transformWithStateInPandas(statefulProcessor=Band(), outputStructType=_FOUND, outputMode="Append", timeMode="EventTime")

    def batch(df: DataFrame, number: int) -> None:
        order = F.when(F.col("other").isNotNull(), F.struct((-F.col("jaccard")).alias("j"), F.col("other_at").alias("t"), F.col("other").alias("s")))
        best = df.groupBy("slug", "at").agg(F.min(order).alias("x"))
        out = best.select("slug", F.timestamp_millis("at").alias("at"), F.col("x.s").alias("other"), F.coalesce(-F.col("x.j"), F.lit(0.0)).alias("jaccard"))
        out.write.mode("overwrite").parquet(f"{results}/batch={number}")

    return found.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
