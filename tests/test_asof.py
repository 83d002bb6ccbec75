"""As-of joins against brute force: hot keys over many parts, ties, nulls."""

import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import asof


@pytest.mark.parametrize("equal", [False, True])
def test_equals_brute_force(spark, equal):
    r = random.Random(5)
    key = lambda: r.choice(["hot", "hot", "hot", "a", "b", None])
    left = [(i, key(), r.choice([None, *range(60)]), i % 4) for i in range(300)] + [(7, "hot", 30, 1)] * 2
    right = [(1000 + i, key(), r.choice([None, *range(60)]), i % 4) for i in range(200)] + [(5000, "late", 99, 0)]
    schema = "id long, k string, at int, n int"
    l, s = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)  # noqa: E741
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted((x.id, str(x.k), str(x.at), x.n, x.prior.id if x.prior else -1) for x in asof.latest_before(l, s, ["k"], "at", ties=["n"], equal=equal).collect())
        parts = asof.staged(l.where("k = 'hot' and at is not null").repartitionByRange("k", "at").withColumn("p", F.spark_partition_id()), "x").select("p").distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 4  # the hot key is no single task's
    want = []
    for i, k, at, n in left:
        fit = [(a, m, j) for j, q, a, m in right if k is not None and at is not None and q == k and a is not None and ((a, m) < (at, n) or equal and (a, m) == (at, n))]
        want.append((i, str(k), str(at), n, max(fit)[2] if fit else -1))
    assert got == sorted(want)


def test_empty_sides(spark):
    rows = spark.createDataFrame([(1, "a", 1)], "id long, k string, at int")
    assert [x.prior for x in asof.latest_before(rows, rows.limit(0), ["k"], "at").collect()] == [None]
    assert asof.latest_before(rows.limit(0), rows, ["k"], "at").count() == 0
    assert asof.latest_before(rows, rows, ["k"], "at").first().prior is None
    assert asof.latest_before(rows, rows, ["k"], "at", equal=True).first().prior.id == 1
