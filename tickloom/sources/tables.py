"""Tables at rest: feature files, partitioned history, idempotent read models."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import normalize_ts
from tickloom.schemas import require_columns

PARTITION = ("kind", "source", "product", "date", "hour")


def read_features(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Only the wanted columns of a feature table; missing ones are named."""
    df = spark.read.parquet(path)
    return require_columns(df, columns, path).select(*columns)


def read_by_extension(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """Parquet, CSV or TSV by suffix."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".parquet", ".pq"):
        df = spark.read.parquet(path)
    elif suffix in (".csv", ".tsv"):
        sep = "\t" if suffix == ".tsv" else ","
        df = spark.read.options(header=True, inferSchema=True, sep=sep).csv(path)
    else:
        raise ValueError(f"unsupported file type: {path}")
    return require_columns(df, required, path)


def write_hourly(df: DataFrame, root: str, kind: str, time: str, mode: str = "append") -> None:
    """Append rows under kind/source/product/date/hour; one file group per hour and task."""
    placed = df.withColumns(
        {
            "kind": F.lit(kind), "product": F.col("product_id"),
            "date": F.date_format(time, "yyyy-MM-dd"), "hour": F.date_format(time, "HH"),
        }
    )
    # an hour of one product is bounded; spread each over a few tasks rather than one
    spread = placed.repartition("date", "hour", "product", F.pmod(F.hash(time), F.lit(4)))
    spread.write.mode(mode).partitionBy(*PARTITION).parquet(f"{root}/raw")


def read_history(spark: SparkSession, root: str, kind: str, days: Sequence[str] | None = None) -> DataFrame:
    """Rows of one kind; day filters prune directories."""
    df = spark.read.option("basePath", f"{root}/raw").parquet(f"{root}/raw/kind={kind}")
    dated = df.withColumn("date", F.col("date").cast("string"))
    return dated.where(F.col("date").isin(*days)) if days else dated


def incomplete_days(*kinds: DataFrame, day: str = "source_date") -> DataFrame:
    """Days that some kind has and another lacks."""
    tagged = None
    for i, df in enumerate(kinds):
        part = df.select(F.col(day).cast("string").alias("day"), F.lit(i).alias("kind")).distinct()
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.groupBy("day").agg(F.count_distinct("kind").alias("n")).where(F.col("n") < len(kinds)).select("day")


def hourly_manifest(df: DataFrame, time: str, keys: Sequence[str] = ("kind", "product_id")) -> DataFrame:
    """Row counts for all 24 hours of every day present, empty hours included."""
    counts = df.groupBy(
        *keys, F.to_date(time).alias("date"), F.hour(time).alias("hour")
    ).agg(F.count(F.lit(1)).alias("rows"))
    grid = counts.select(*keys, "date").distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return grid.join(counts, [*keys, "date", "hour"], "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    target, fs = _place(spark, path)
    fs.delete(target, True)


def move(spark: SparkSession, old: str, new: str) -> None:
    target, fs = _place(spark, old)
    if not fs.rename(target, _place(spark, new)[0]):
        raise OSError(f"{old} could not become {new}")


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders directly below `path`."""
    target, fs = _place(spark, path)
    return [f"{path}/{s.getPath().getName()}" for s in fs.listStatus(target) if s.isDirectory()] if fs.exists(target) else []


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not have been written yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def first_of_each(batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key in `order`, its time normalised; rows without a key are left out.

    `order` names the log position (partition and offset, say); it must tell the rows of a key apart.
    """
    if not order:
        raise ValueError("the log position that decides between equal keys is needed")
    rows = batch.withColumn("feature_ts", normalize_ts("feature_ts")) if "feature_ts" in batch.columns else batch
    first = F.min_by(F.struct(*rows.columns), F.struct(*[F.col(c) for c in order])).alias("__first")
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(first).select("__first.*")


def stamped(rows: DataFrame, stamp: str | None) -> DataFrame:
    """With a column `stamp`, if it is named and missing: one write time for the whole batch."""
    if not stamp or stamp in rows.columns:
        return rows
    return rows.withColumn(stamp, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"))


def insert_or_ignore(
    existing: DataFrame, batch: DataFrame, key: str, order: Sequence[str], stamp: str | None = None
) -> DataFrame:
    """Rows of `batch` that are new: the first of each key in `order`, absent from `existing`."""
    fresh = first_of_each(batch, key, order)
    return stamped(fresh.join(existing.select(key), key, "left_anti").select(*fresh.columns), stamp)
