"""Versions of a table: a killed write leaves the one before, a retry succeeds, of two writers one wins."""

import pytest

from tracewell.sources import versions


def test_versions(spark, tmp_path):
    for folder in (str(tmp_path / "plain"), f"file://{tmp_path}/address"):
        assert versions.read(spark, folder) is None and versions.versions(spark, folder) == []
        assert versions.publish(spark.range(3), folder) == 1 and versions.publish(spark.range(5), folder) == 2
        assert versions.read(spark, folder).count() == 5 and versions.read(spark, folder, 1).count() == 3
        # killed before the manifest: the data lie there, and nobody reads them
        spark.range(99).write.parquet(f"{folder}/v=3")
        assert versions.read(spark, folder).count() == 5
        assert versions.publish(spark.range(7), folder, data="v=3") == 3
        assert versions.read(spark, folder).count() == 7
        # killed in the middle of writing
        boom = spark.range(8).selectExpr("assert_true(id < 5) as x", "id")
        with pytest.raises(Exception, match="id"):
            versions.publish(boom, folder)
        assert versions.versions(spark, folder) == [1, 2, 3] and versions.read(spark, folder).columns == ["id"]
        # two writers after the same version
        assert versions.publish(spark.range(1), folder, after=3) == 4
        with pytest.raises(versions.Conflict):
            versions.publish(spark.range(2), folder, after=3)
        assert versions.read(spark, folder).count() == 1
        # a repeated batch
        assert versions.publish(spark.range(11), folder, tag="batch 9") == versions.publish(spark.range(12), folder, tag="batch 9") == 5
        assert versions.read(spark, folder).count() == 11
        versions.prune(spark, folder, 1)
        assert versions.versions(spark, folder) == [5] and versions.read(spark, folder).count() == 11


def test_empty_table_keeps_its_columns(spark, tmp_path):
    df = spark.createDataFrame([], "slug string, signature array<long>, at timestamp")
    versions.publish(df, str(tmp_path / "t"))
    assert versions.read(spark, str(tmp_path / "t")).schema == df.schema
