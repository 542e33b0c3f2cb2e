"""Cleaning a corpus for training: quality, near duplicates, decontamination, personal data, token ids.

Every stage takes all rows that the one before kept, written as Parquet and read again, and returns them with its
decisions applied. Only whole tables are read. What a stage wrote for itself is removed when the next one starts, as
its result has been written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import decontaminate, ngram_join, pieces, pii, quality
from tickloom.llm.common import may_hold, small_batches, table
from tickloom.plans import lineage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_left_by_last: list[str] = []


def _tidy(step: Stage) -> Stage:
    """Remove what the stage before staged, and note what this one stages."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        lineage.remove(spark, _left_by_last)
        before = set(lineage.staged())
        out = step(spark, docs, sf_dir)
        _left_by_last[:] = [p for p in lineage.staged() if p not in before]
        return out

    return run_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality posterior rejects go. Ties at the cut stay; without usable labels all stay."""
    return quality.assess(docs, table(spark, sf_dir, "labels")).where("keep").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id: five-word shingles, similarity 0.8.

    Documents without words link with nothing and stay. Rows that share an id, or have none, are told apart by a row
    number first; of repeated rows one stays. Texts of rows that surely stay are not moved.
    """
    columns = docs.columns
    repeated = docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    key = "doc_id"
    if repeated:
        key = "_row"
        docs = lineage.stage(docs.withColumn(key, F.monotonically_increasing_id()))
    found = ngram_join.join(docs, id_col=key, k=5, threshold="0.8")
    gone = lineage.stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(key)))
    kept = may_hold(docs, key, gone, "left_anti").unionByName(may_hold(docs, key, gone).join(gone, key, "left_anti"))
    return kept.select(columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an exact or edited copy of a benchmark item go."""
    held = decontaminate.blocks(table(spark, sf_dir, "benchmark"))
    return docs.where(~F.arrow_udf(decontaminate.contaminated(held), "boolean")(F.coalesce("text", F.lit(""))))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes <kind>; n_chars follows the text. All rows stay."""
    clean = docs.withColumn("text", F.arrow_udf(pii.redact(pii.fit(docs)), "string")("text"))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    vocabulary = pieces.Vocabulary.load()
    out = docs.withColumn("p", pieces.encoded(spark, F.col("text"), vocabulary))
    return out.select("doc_id", "lang", "source", "n_chars", F.size("p.ids").cast("long").alias("n_ids"), "p.ids", "p.exact")


STAGES: list[tuple[str, Stage]] = [
    (name, _tidy(step))
    for name, step in (
        ("quality classifier", quality_stage),
        ("n-gram Jaccard join", near_duplicate_stage),
        ("benchmark decontamination", decontamination_stage),
        ("personal data", personal_data_stage),
        ("piece ids", encoding_stage),
    )
]

#: Models, alignments and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, step) in enumerate(STAGES):
        old, docs = docs, step(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = lineage.stage(docs)
            lineage.unstage(old)
    return docs
