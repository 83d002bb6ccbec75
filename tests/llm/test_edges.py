"""Rows and columns that come seldom: clashing names, ids with several rows, probes in roles, runs side by side."""

import threading

from pyspark.sql import functions as F

import corpus_pipeline as cp
from tracewell.llm import chat, inner_product, mixing, near_dedup, quality, shared


def test_roles_and_texts_like_probes(spark):
    rows = [(1, 0, "zq0", "yq17 zq0"), (1, 1, "yq17", "zq00"), (1, 2, "assistant", "yq1777zq0")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.formatted(df)).first()
    assert got.n_turns == 3 and got.loss_chars == len(rows[2][3])


def test_columns_that_quality_rules_use_inside(spark):
    docs = spark.createDataFrame([(i, "word " * 60 + ("***" * i if i % 2 else ""), i, "x", 5, "old") for i in range(40)], "doc_id long, text string, _id long, _y string, rule int, kept string")
    labels = spark.createDataFrame([(i, 1 - i % 2, "q") for i in range(40)], "doc_id long, quality int, _id string")
    out = quality.judged(docs, labels)
    assert out.count() == 40 and out.where("_y = 'x' and _id = doc_id").count() == 40
    assert dict(out.dtypes)["kept"] == "boolean"


def test_columns_that_mixing_uses_inside(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", False, "mine", 9, "left") for i in range(20)], "doc_id long, text string, source string, _n boolean, _s string, k int, last string")
    out = mixing.mix(docs)
    assert out.where("not _n and _s = 'mine' and k = 9 and last = 'left'").count() == 20
    mixed = mixing.mixed_documents(docs.withColumn("size", F.lit(-1)).withColumn("copies", F.lit("c")))
    assert mixed.columns == [*docs.columns, "size", "copies"] and mixed.where("size = -1 and copies = 'c'").count() == mixed.count() == 20


def test_ragged_vectors_and_repeated_query_ids(spark):
    rows = [(0, [1.0, 2.0]), (0, [3.0]), (1, [1.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in inner_product.top_products(df).collect()}
    # the smaller vector of id 0 asks: (1, 2, 0), times 64
    assert got == {(0, 1, 2, 2 * 64 * 64), (0, 2, 3, 2 * 64 * 64), (0, 3, 1, 64 * 64)}


def test_rows_of_one_id_with_different_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(1, one, "x"), (1, two, "y"), (1, two, "y"), (2, one + " end", "z"), (3, two, "w"), (None, one, "n"), (4, " ", "e"), (5, None, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, th string")
    got = sorted(((r.doc_id, r.th) for r in near_dedup.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, "x"), (1, "y"), (4, "e"), (5, "v"), (None, "n")], key=str)
    found = near_dedup.near_duplicates(docs).where("n_shingles > 0 and doc_id is not null").select("component_id").distinct().collect()
    assert [r.component_id for r in found] == [1]


def test_runs_side_by_side_keep_their_tables(spark):
    kept, other = [], []

    def run(out):
        cp._begin(spark)
        out.append(shared.stored(spark.range(5), "mine"))
        cp._begin(spark) if out is other else None

    threads = [threading.Thread(target=run, args=(kept,)), threading.Thread(target=run, args=(other,))]
    for t in threads:
        t.start()
        t.join()
    assert kept[0].count() == 5
