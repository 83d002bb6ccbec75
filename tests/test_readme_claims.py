"""Technology claims against whole texts."""

from tracewell.plans import catalog


def test_technology_claims_read_long_documents_too(spark, tmp_path):
    long = "word " * 1000 + "xtherehaingx"
    spark.createDataFrame([(1, long, "en", "src1", len(long)), (2, "THEREHAING", "en", "src2", None), (3, "short", "en", "src3", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "u", "<p>ing</p>") for i in (1, 2, 3, 4)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.repo_id: r.status for r in catalog.tech_vocab_scan(spark, str(tmp_path)).collect()}
    assert got == {1: "verified", 2: "verified", 3: "unverified", 4: "contradicted"}
    assert {r.repo_id: r.contradicted for r in catalog.readme_consistency(spark, str(tmp_path)).collect()} == {1: 0, 2: 0, 3: 0, 4: 1}
