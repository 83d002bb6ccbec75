"""Mixing sources to target weights: whole copies for certain, the rest by Pareto order sampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored, uniform

MAX_COPIES = 3
#: Ranges of the sampling order that are summed before the last one is looked into.
RANGES = 1 << 14
#: Words are the runs of characters other than these.
SPACE = r"[\x20\x09-\x0D]+"


def word_count(text: str) -> Column:
    """Number of words; null is 0. Words are what is left between runs of white space, ends aside."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), rf"^{SPACE}|{SPACE}$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE, -1))).cast("long")


def targets(sources: DataFrame, weight: Column, cap: float = MAX_COPIES) -> DataFrame:
    """sources (one row each: source, source_size) with target added: all sizes shared by weight, none above cap times its source's size.

    The excess of capped sources goes to the others by weight, until none is above. In the order of size / weight, the capped
    ones come first, so running sums find them: a source is capped if its cap is at most its share of what those before it leave.
    """
    w = Window.orderBy((F.col("source_size") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy()
    s = sources.withColumn("_w", weight).withColumn("_all", F.sum("source_size").over(rest)).withColumn("_all_w", F.sum("_w").over(rest))
    s = s.withColumn("_left", F.col("_all") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("_left_w", F.col("_all_w") - F.coalesce(F.sum("_w").over(before), F.lit(0)))
    s = s.withColumn("_capped", cap * F.col("source_size") * F.col("_left_w") <= F.col("_left") * F.col("_w"))
    # the first that isn't capped fixes the share of a unit of weight for all that follow
    first = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("_w"), F.col("source").isNull(), F.col("source"), F.col("_left"), F.col("_left_w")))).over(rest)
    s = s.withColumn("_first", first)
    share = F.col("_first._left") * F.col("_w") / F.col("_first._left_w")
    target = F.when(F.col("_capped") | F.col("_first").isNull(), (cap * F.col("source_size")).cast("double")).otherwise(share.cast("double"))
    return s.select("source", "source_size", target.alias("target"))


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """sources with weight: by code point of source, null last, the weights in turn."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("long"))


#: The inclusion chance of one more copy goes with the size to this power, up to certainty; 0 would give all the same chance.
POWER = 0.5
#: Names that columns of docs are unlikely to have.
_N, _S, _I, _Z, _U = "_mix_null_b0d4", "_mix_source_b0d4", "_mix_id_b0d4", "_mix_size_b0d4", "_mix_number_b0d4"


def _chances(light: DataFrame, goal: DataFrame, power: float) -> DataFrame:
    """Per source and size class (bits of the size): the inclusion chance min(1, c * g), g = 2 ** (class * power).

    c is such that the words to expect are those wanted. Classes of the largest g reach certainty first, so running sums find
    them: a class is certain if what those before it leave, shared by g, gives it 1 or more.
    """
    classes = light.where(F.col(_Z) > 0).groupBy(_N, _S, F.length(F.bin(_Z)).alias("k")).agg(F.sum(_Z).alias("words")).join(goal.where("want > 0").select(_N, _S, "want"), [_N, _S])
    w = Window.partitionBy(_N, _S).orderBy(F.col("k").desc())
    g = F.pow(F.lit(2.0), F.col("k") * power)
    c = classes.withColumn("g", g).withColumn("left", F.col("want") - F.coalesce(F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    c = c.withColumn("c", F.col("left") / F.sum(F.col("words") * F.col("g")).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    first = F.max(F.when(F.col("c") * F.col("g") < 1, F.struct("k", "c"))).over(Window.partitionBy(_N, _S))
    c = c.withColumn("first", first)
    chance = F.when(F.col("first").isNull() | (F.col("k") > F.col("first.k")), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("first.c") * F.col("g")))
    return c.select(_N, _S, "k", chance.alias("chance"))


#: Rows of a table by source and class that are broadcast at most; a larger one is joined.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Plan:
    """By source: source_size, target, sure copies, the words still wanted. By source and class: chances. By source: where the sample ends."""

    goal: DataFrame
    chances: DataFrame
    ends: DataFrame


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _ranked(rows: DataFrame, goal: DataFrame, chances: DataFrame) -> DataFrame:
    """rows with their source's goal, and q, their place in the Pareto order: the odds of a uniform number over the odds of inclusion."""
    out = rows.withColumn("k", F.length(F.bin(_Z))).join(_small(chances), [_N, _S, "k"], "left").join(_small(goal), [_N, _S])
    odds = (F.col(_U) / (1 - F.col(_U))) / (F.col("chance") / (1 - F.col("chance")))
    # certain ones (infinite odds) come first
    out = out.withColumn("q", F.when(F.col(_Z) > 0, F.when(F.col("chance") >= 1, F.lit(0.0)).when(F.col("chance") > 0, odds)))
    return out.withColumn("r", F.floor(F.col("q") / (1 + F.col("q")) * RANGES).cast("int"))


def planned(light: DataFrame, weights: tuple[int, ...], cap: int, power: float = POWER) -> Plan:
    """The plan of a mix from light: source (as null mark and string), id, size and uniform number of every row."""
    sums = light.groupBy(_N, _S).agg(F.sum(_Z).alias("source_size")).withColumn("source", F.when(~F.col(_N), F.col(_S)))
    weighted = cyclic_weights(sums.select("source", "source_size"), weights)
    goal = targets(weighted, F.col("weight"), cap).withColumn(_N, F.col("source").isNull()).withColumn(_S, F.coalesce("source", F.lit(""))).drop("source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("sure", F.floor(ratio + 1e-12).cast("int")).withColumn("want", F.when(ratio - F.col("sure") > 0, F.col("target") - F.col("sure") * F.col("source_size")).otherwise(0.0))
    goal = stored(goal, "targets")
    chances = stored(_chances(light, goal, power), "chances")
    ranked = _ranked(light, goal, chances).where("q is not null")
    # sums by range, then by row inside the one range in which the wanted words are reached
    by_range = ranked.groupBy(_N, _S, "r").agg(F.sum(_Z).alias("w"), F.max("want").alias("want"))
    run = Window.partitionBy(_N, _S).orderBy("r")
    by_range = by_range.withColumn("upto", F.sum("w").over(run)).withColumn("begin", F.col("upto") - F.col("w"))
    last = stored(by_range.where("upto > want and begin <= want").select(_N, _S, F.col("r").alias("last"), "begin"), "last")
    inside = ranked.join(_small(last), [_N, _S]).where("r = last")
    each = Window.partitionBy(_N, _S).orderBy("q", _I, _Z)
    inside = inside.withColumn("upto", F.col("begin") + F.sum(_Z).over(each.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = inside.where(F.abs(F.col("upto") - F.col("want")) < F.abs(F.col("upto") - F.col(_Z) - F.col("want")))
    stop = near.groupBy(_N, _S).agg(F.max(F.struct("q", _I, _Z)).alias("stop"))
    return Plan(goal, chances, stored(last.select(_N, _S, "last").join(stop, [_N, _S], "left"), "ends"))


def _copies(rows: DataFrame, plan: Plan) -> DataFrame:
    """rows with source_size, target and copies; the plan's tables are by source and class, so rows stay where they are."""
    out = _ranked(rows, plan.goal, plan.chances).join(_small(plan.ends), [_N, _S], "left")
    before = F.col("last").isNull() | (F.col("r") < F.col("last"))
    at = F.struct("q", F.col(_I), F.col(_Z)) <= F.struct("stop.q", f"stop.{_I}", f"stop.{_Z}")
    extra = F.col("q").isNotNull() & (before | F.coalesce((F.col("r") == F.col("last")) & F.col("stop").isNotNull() & at, F.lit(False)))
    copies = F.when(F.col(_Z) > 0, F.col("sure") + extra.cast("int")).otherwise(0)
    return out.withColumn("copies", copies)


def _keys(doc_id: str, source: str, text: str, seed: int) -> list[Column]:
    null = F.col(source).isNull()
    return [null.alias(_N), F.coalesce(F.col(source).cast("string"), F.lit("")).alias(_S), F.col(doc_id).alias(_I), word_count(text).alias(_Z), uniform(doc_id, seed=seed).alias(_U)]


def _light(docs: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    return docs.select(*_keys(doc_id, source, text, seed))


def allocation(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES, seed: int = 11, power: float = POWER) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, copies and taken, as mix() has them; texts are read once."""
    light = stored(_light(docs, doc_id, source, text, seed), "sizes")
    out = _copies(light, planned(light, weights, cap, power))
    return out.select(F.col(_I).alias("doc_id"), F.col(_Z).alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col(_Z)).alias("taken"))


def mix(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), cap: int = MAX_COPIES, seed: int = 11, power: float = POWER) -> DataFrame:
    """docs with size, source_size, target, copies and taken (= copies * size) added (such columns are replaced; all others stay).

    Of a source, target / source_size copies are wanted of each document. Their whole part is certain. For the rest, documents
    have unequal chances of one more copy: they grow with the size to the power given, up to certainty, such that the words to
    expect are those still wanted. Documents are ranked by the odds of a uniform number, which the id and seed alone give, over
    their odds of inclusion (Pareto order sampling), and the first are taken. The size of the sample is fixed in words: as near
    to those wanted as whole documents can come. Nothing exceeds cap copies. Null texts have size 0 and are not taken; a null
    source is a source; ties in rank go by id. Rows of one id and size share a number and a chance, so they are taken or left
    together. No rows: no rows.
    """
    added = ["size", "source_size", "target", "copies", "taken"]
    docs = docs.drop(*added)
    light = stored(_light(docs, doc_id, source, text, seed), "sizes")
    names = [f"_mix_{i}_b0d4" for i in range(len(docs.columns))]  # so that no column of docs is taken for one of the plan
    plain = docs.toDF(*names)
    at = {c: names[docs.columns.index(c)] for c in (doc_id, source, text)}
    keyed = plain.select("*", *_keys(at[doc_id], at[source], at[text], seed))
    out = _copies(keyed, planned(light, weights, cap, power))
    return out.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)), F.col(_Z).alias("size"), "source_size", "target", "copies", (F.col("copies") * F.col(_Z)).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken, with the columns of docs."""
    added = [c for c in docs.columns if c in ("size", "source_size", "target", "copies", "taken")]
    plain = docs.withColumnsRenamed({c: f"_mix_{c}_b0d4" for c in added})
    taken = mix(plain, **options).where("copies > 0").select(*plain.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_mix_copy_b0d4"))
    return taken.select(*plain.columns).toDF(*docs.columns)
