"""The stream of submissions gives what a batch gives, however it is cut, and drops what comes too late."""

import datetime as dt
import random

import pytest

from tracewell.streaming import bands

START = dt.datetime(2024, 1, 1)
KIND = "slug string, owner string, at timestamp, signature array<long>"


def brute(rows, n):
    """Best submission before each of those that share a band of two values."""
    out = {}
    for slug, owner, at, sig in rows:
        fit = []
        for other, o, t, s in rows:
            if (t, other) < (at, slug) and other != slug and not (owner and owner == o) and any(sig[i : i + 2] == s[i : i + 2] for i in range(0, 2 * n, 2)):
                fit.append((-int(sum(a == b for a, b in zip(sig, s, strict=True)) / len(sig) * 10000 + 0.5) / 10000, t, other))
        out[slug] = (min(fit)[2], -min(fit)[0]) if fit else (None, 0.0)
    return out


@pytest.mark.parametrize("cuts", [1, 3])
def test_equals_the_batch_answer(spark, tmp_path, cuts):
    r = random.Random(4)
    kinds = [[r.randint(0, 9) for _ in range(8)] for _ in range(3)]
    rows = [(f"s{i:02d}", r.choice(["", "x", "y"]), START + dt.timedelta(minutes=r.randint(0, 50)), [v if r.random() < 0.7 else r.randint(0, 9) for v in r.choice(kinds)] if i % 2 else r.choice(kinds)) for i in range(24)]
    far = [("end", "", START + dt.timedelta(days=9), [99] * 8)]
    at, got = str(tmp_path), {}
    parts = [rows[k::cuts] for k in range(cuts)] + [far, [("end2", "", START + dt.timedelta(days=9), [98] * 8)]]
    for part in parts:
        spark.createDataFrame(part, KIND).coalesce(1).write.mode("append").parquet(f"{at}/queue")
        bands.run(spark.readStream.schema(KIND).parquet(f"{at}/queue"), f"{at}/out", f"{at}/check", "1 hour", 4).awaitTermination()
    for x in spark.read.parquet(f"{at}/out").collect():
        assert x.slug not in got
        got[x.slug] = (x.other, x.jaccard)
    assert got == brute(rows, 4)
    late = [("late", "", START, kinds[0])]
    spark.createDataFrame(late, KIND).coalesce(1).write.mode("append").parquet(f"{at}/queue")
    bands.run(spark.readStream.schema(KIND).parquet(f"{at}/queue"), f"{at}/out", f"{at}/check", "1 hour", 4).awaitTermination()
    assert "late" not in {x.slug for x in spark.read.parquet(f"{at}/out").collect()}
