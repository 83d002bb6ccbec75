"""The operators of this subpackage as queries over the driver's tables, each over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import tables
from . import chat, inner_product, licences, mixing, near_dedup, packing, periods, quality, repeats, reputation, resampling, shared, token_counts, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.table(shared.modest(spark), sf_dir, name)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces, _ = token_counts.learned(docs, token_counts.Vocabulary.load(_tokenizer("piece_bpe_32k.model")))
    return token_counts.with_counts(docs, pieces).select("doc_id", "n_words", "n_tokens")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *quality.STATS, "base_failed", "rule", "kept")


def op5_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inner_product.top_products(_table(spark, sf_dir, "embeddings"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), numerator=85, denominator=100)


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(chat.formatted(turns.unionByName(own)))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.allocation(docs)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.with_licences(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    families = F.array_sort(F.array_distinct(F.col("notices.family")))
    return found.select("doc_id", F.size("notices").cast("long").alias("n_notices"), F.concat_ws(",", families).alias("families"), F.expr("cast(size(filter(notices, n -> n.confirmed)) as long)").alias("n_confirmed"), F.array_max("notices.probability").alias("best_probability"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = token_store.write(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return token_store.read(store).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digest(_table(spark, sf_dir, "documents")).drop("removed")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; every tenth document by the CRC of its id repeats a stretch of its own words from one of them on to its end."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split("text", "[ \t-\r]+"), lambda w: w != "")
    g, n = F.floor(h / 10).cast("long"), F.size("_w").cast("long")
    a = F.expr("_g % nullif(_n, 0)")  # a text without words has no place to repeat from
    p = F.expr("1 + (_n - _a) div (3 + _g % 8)")
    told = docs.select("doc_id", "text", h.alias("_h"), g.alias("_g"), F.when((h % 10 == 0) & F.col("doc_id").isNotNull(), words).alias("_w"))
    told = told.withColumn("_n", n).withColumn("_a", a).withColumn("_p", p)
    again = F.expr("concat_ws(' ', transform(sequence(0L, _n - 1), i -> element_at(_w, cast(if(i < _a, i, _a + (i - _a) % _p) + 1 as int))))")
    return told.select("doc_id", F.when(F.size("_w") > 0, again).otherwise(F.col("text")).alias("text"))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periods.with_runs(_with_planted_runs(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.expr("array_min(transform(runs, r -> struct(-r.length as l, r.start as s, r.period as p)))")
    lines = F.expr("array_join(transform(runs, r -> concat_ws(',', r.start, r.length, r.period)), '\n')")
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("lines"), "collapsed")
    milli = F.expr("(1000 * -b.l) div b.p")
    return out.select("doc_id", "n_runs", F.col("b.s").alias("start"), (-F.col("b.l")).alias("length"), F.col("b.p").alias("period"), milli.alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


#: The rules of the query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op13_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label of low quality is a bad outcome of the page whose id it has."""
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return reputation.judged(_table(spark, sf_dir, "pages"), labels, RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_source_mix": op2_source_mix,
    "op3_token_counts": op3_token_counts,
    "op4_quality_rules": op4_quality_rules,
    "op5_top_products": op5_top_products,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_packing": op7_packing,
    "op8_licence_scan": op8_licence_scan,
    "op9_token_store": op9_token_store,
    "op10_repeated_passages": op10_repeated_passages,
    "op11_importance_resample": op11_importance_resample,
    "op12_word_runs": op12_word_runs,
    "op13_host_reputation": op13_host_reputation,
}
