"""Recipes are checked against the manifest."""

import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from tracewell.llm import token_store as ts

NAME = path("word_bpe_49k.json")


def test_lost_and_replaced_recipes_are_found(spark):
    df = spark.createDataFrame([(i, f"document {i} of some words") for i in range(40)], "doc_id long, text string")
    store = ts.write(df, NAME)
    assert ts.read(store).count() == 40
    other = store.recipes.where("doc_id = 8").select("n_tokens", "addresses", "root").first()
    replaced = store.recipes
    for c in ("n_tokens", "addresses", "root"):
        replaced = replaced.withColumn(c, F.when(F.col("doc_id") == 7, F.lit(list(other[c]) if c == "addresses" else bytes(other[c]) if c == "root" else other[c])).otherwise(F.col(c)))
    doubled = store.recipes.unionByName(store.recipes.where("doc_id = 7").withColumn("uid", F.col("uid") + 1_000_000))
    for recipes in (store.recipes.where("doc_id <> 7"), store.recipes.where("false"), replaced, doubled):
        with pytest.raises(ValueError, match="manifest"):
            ts.read(ts.Store(spark, store.chunks, recipes, store.manifest, store.width)).collect()
