"""The pipeline's stages: decisions take effect, clean documents stay."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_their_promises(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    seen, columns = [docs], docs.columns
    for i, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, seen[-1], sf_dir)
        rows = out.collect()
        if i < 4:
            assert out.columns == columns
        seen.append(spark.createDataFrame(rows, out.schema))
    ids = [{r["doc_id"] for r in d.select("doc_id").collect()} for d in seen]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4] == ids[5] and len(ids[5]) > len(ids[0]) / 2
    good = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    assert len(good - ids[1]) <= 0.05 * len(good)
    texts = {r["text"] for r in seen[2].collect()}
    assert len(texts) == seen[2].count()
    assert seen[4].where(F.col("text").rlike("@[a-z0-9]+\\.example\\.com")).count() == 0
    assert seen[5].where("NOT exact").count() == 0


def test_stages_on_odd_and_empty_input(spark, sf_dir, edge_docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (edge_docs.select(columns), edge_docs.select(columns).where("false")):
        for _, step in corpus_pipeline.STAGES:
            out = step(spark, docs, sf_dir)
            docs = spark.createDataFrame(out.collect(), out.schema)
