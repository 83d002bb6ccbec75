"""As-of joins: for each row the latest earlier row of its key, by a merge of two tables in order of key and time.

Rows are dealt by ranges of key and time, so a key of any number of rows falls into as many parts as it fills. What goes over the border
of a part is one row: the last one before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged


def latest_before(left: DataFrame, right: DataFrame, by: Sequence[str], at: str, *, ties: Sequence[str] = (), equal: bool = False, name: str = "prior") -> DataFrame:
    """left with `name`: the row of right (a struct) of the same key with the greatest (at, *ties) below the left row's own; null if there is none.

    With equal, one of the same (at, *ties) is earlier as well. by, at and ties are columns of both. A null in a key or a time matches
    nothing; left rows keep their number, repeated ones too, and of right rows that agree in key, time and ties the greatest counts.
    Two shuffles of both sides; the one table that is broadcast has a row per partition.
    """
    when = [at, *ties]
    known = lambda: F.expr(" and ".join(f"`{c}` is not null" for c in (*by, *when)))
    key, time = F.struct(*[F.col(c) for c in by]).alias("k"), F.struct(*[F.col(c) for c in when]).alias("t")
    mine, theirs = F.struct(*[F.col(c) for c in left.columns]), F.struct(*[F.col(c) for c in right.columns])
    # 0: a right row that may be earlier, 1: a left row; of the same time the one that is to come second has the higher number
    first, second = (0, 1) if equal else (1, 0)
    none = lambda df: F.lit(None).cast(df.select(F.struct(*df.columns).alias("x")).schema["x"].dataType)
    l = left.where(known()).select(key, time, F.lit(second if equal else 0).alias("o"), mine.alias("l"), none(right).alias("r"))  # noqa: E741
    r = right.where(known()).select(key, time, F.lit(first if equal else 1).alias("o"), none(left).alias("l"), theirs.alias("r"))
    rows = l.unionByName(r).repartitionByRange("k", "t", "o").withColumn("part", F.spark_partition_id())
    rows = staged(rows, "in-order")
    inside = Window.partitionBy("part", "k").orderBy("t", "o", F.col("r").isNull(), "r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = rows.withColumn("p", F.last("r", ignorenulls=True).over(inside)).where("l is not null")
    # a row per part: its first key, and the last right row in it
    ends = rows.groupBy("part").agg(F.min("k").alias("k"), F.max(F.when(F.col("r").isNotNull(), F.struct("k", "t", "r"))).alias("e"))
    before = ends.alias("x").join(ends.alias("y"), (F.col("x.k") == F.col("y.e.k")) & (F.col("y.part") < F.col("x.part")))
    carried = before.groupBy(F.col("x.part").alias("part"), F.col("x.k").alias("k")).agg(F.max_by("y.e.r", "y.part").alias("c"))
    met = seen.join(F.broadcast(carried), ["part", "k"], "left").select(F.col("l.*"), F.coalesce("p", "c").alias(name))
    return met.unionByName(left.where(~F.coalesce(known(), F.lit(False))).withColumn(name, none(right)))
