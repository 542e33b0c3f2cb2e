"""Digest trees, chunked file hashes and content-addressed publication."""

import glob
import hashlib
import tempfile

import pytest
from pyspark.sql import functions as F

from tickloom.operators import features as ft
from tickloom.plans import pipelines
from tickloom.sources import manifest as mf
from tickloom.sources import tables


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_digest_tree_knows_content_not_order(spark):
    df = spark.range(3000).selectExpr("id % 700 AS a", "cast(id % 7 AS string) AS b")
    root = mf.merkle_root(df).first()["digest"]
    assert root == mf.merkle_root(df.repartition(7, "b").select("b", "a")).first()["digest"]
    assert root != mf.merkle_root(df.unionByName(df.limit(1))).first()["digest"]  # a further copy counts
    assert root != mf.merkle_root(df.withColumn("a", F.when((F.col("a") == 5) & (F.col("b") == "5"), 6).otherwise(F.col("a")))).first()["digest"]
    assert len(mf.merkle_root(df.where("false")).first()["digest"]) == 64
    levels = mf.merkle_levels(df, depth=2).groupBy("level").count().collect()
    assert {r["level"] for r in levels} == {0, 1, 2}
    changed = df.withColumn("b", F.when(F.col("a") == 3, F.lit("x")).otherwise(F.col("b")))
    assert 1 <= mf.differing_rows(df, changed, depth=2).count() <= 16 and mf.differing_rows(df, df.repartition(2), depth=2).count() == 0


def test_files_are_hashed_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(mf, "CHUNK_BYTES", 7)
    root = folder()
    content = {f"{root}/{i}.parquet": bytes(range(i * 3)) for i in range(1, 6)}
    for path, data in content.items():
        with open(path, "wb") as fh:
            fh.write(data)
    got = {r["path"].replace("file://", ""): (r["bytes"], r["sha256"]) for r in mf.file_digests(spark, root).collect()}
    assert got == {p: (len(d), hashlib.sha256(d).hexdigest()) for p, d in content.items()}


def test_completions_must_match_their_day(spark):
    parts = spark.createDataFrame([("trades", 5)], "kind string, rows long")
    day = spark.createDataFrame([("P", "2024-01-02", 1704153600, 1704240000)], "product_id string, source_date string, day_start_epoch long, day_end_epoch long")
    one = mf.raw_manifest(parts, 10, 1, completions=day).first()
    assert one["n_trade_day_completions"] == 1 and one["manifest_id"] != mf.raw_manifest(parts, 10, 1).first()["manifest_id"]
    with pytest.raises(Exception, match="UTC date"):
        mf.raw_manifest(parts, 10, 1, completions=day.withColumn("day_end_epoch", F.lit(5))).collect()


def outputs(spark, n=5):
    return {name: spark.range(n).selectExpr("id", f"'{name}' AS s") for name in ft.FEATURE_SETS}


def test_feature_sets_are_published_once_reused_and_checked(spark, monkeypatch):
    root = folder()
    real = tables.move

    def killed(spark, old, new):
        raise KeyboardInterrupt

    monkeypatch.setattr(tables, "move", killed)
    with pytest.raises(KeyboardInterrupt):
        pipelines.write_feature_sets(outputs(spark), root)
    assert pipelines.published_feature_sets(spark, root) == [] and not glob.glob(f"{root}/features/*/part-*")
    monkeypatch.setattr(tables, "move", real)

    first = pipelines.write_feature_sets(outputs(spark), root).collect()
    again = pipelines.write_feature_sets({k: v.repartition(3) for k, v in outputs(spark).items()}, root).collect()
    assert [r["path"] for r in first] == [r["path"] for r in again]
    assert not any(r["reused"] for r in first) and all(r["reused"] and r["rows"] == 5 for r in again)
    assert len(pipelines.published_feature_sets(spark, root)) == 3
    pipelines.write_feature_sets(outputs(spark, 6), root)
    assert len(pipelines.published_feature_sets(spark, root)) == 6

    spark.range(9).selectExpr("id", "'core_v1' AS s").write.mode("append").parquet(first[0]["path"])
    with pytest.raises(ValueError, match="digest"):
        pipelines.write_feature_sets(outputs(spark), root)
