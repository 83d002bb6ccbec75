"""From raw documents to packed training sequences, as five stages.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the columns of documents; the last returns the
pieces of packed sequences. A stage's result is written as Parquet and read again as the next one's docs, so its scratch tables
are removed when the next stage begins.
"""

from __future__ import annotations

import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import mixing, near_dedup, packing, quality, repeats, shared

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SIMILARITY_PERCENT = 80
#: Passages of so many words are looked for, by strings of four bytes a word.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200


#: A name for this thread's run, so that runs side by side keep their scratch tables apart.
_RUN: ContextVar[str | None] = ContextVar("run", default=None)


def _begin(spark: SparkSession) -> None:
    if _RUN.get() is None:
        _RUN.set(f"pipeline-{uuid.uuid4().hex}")
    shared.remove(spark, _RUN.get())
    shared.owned_by(_RUN.get())
    shared.modest(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the learned list keep. A null text has no words and goes."""
    _begin(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.judged(docs, labels).where("kept").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: that of the smallest doc_id, or of equal ids the smallest text."""
    _begin(spark)
    return near_dedup.one_of_each(docs, numerator=SIMILARITY_PERCENT, denominator=100).select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that repeat: what strings of PASSAGE_BYTES find and has PASSAGE_WORDS words or LENGTH bytes.

    A document of which no word is left goes.
    """
    _begin(spark)
    out = repeats.without_repeats(docs, length=PASSAGE_BYTES, words=PASSAGE_WORDS, size=repeats.LENGTH)
    return out.where(F.col("text").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    _begin(spark)
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids as binary."""
    import public_tokenizers

    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup),
    ("source_mix", source_mix),
    ("packing", pack),
]

#: SQL can't express learned rules; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        shared.owned_by("results")
        docs = shared.stored(out, f"stage-{k}-{name}")
    shared.remove(spark, _RUN.get())
    shared.owned_by("query")
    return docs
