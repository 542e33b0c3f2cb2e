"""Cutting a long plan at a written intermediate table.

A two-level scan reads its input twice, so chained scans would recompute their
common input 2^k times. Writing the intermediate once keeps the cost linear and
survives the loss of executors: the table lives in the shared folder the cluster
names in `spark.checkpoint.dir`, not on any worker. A table that no later plan
reads is removed with `unstage`, or at the end of a `scope`.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folder: str | None = None
#: Paths of staged tables that still exist, in order of writing.
_staged: list[str] = []


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; a scratch folder only in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    global _local_folder
    if _local_folder is None:
        _local_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _local_folder


def stage(df: DataFrame) -> DataFrame:
    """Write `df` once and continue from the written table (columnar, prunable)."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def _remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    if path in _staged:
        _staged.remove(path)


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables; nothing that still has to run may read them."""
    for table in tables:
        path = table.__dict__.get("_staged_at")
        if path is not None:
            _remove(table.sparkSession, path)


def staged() -> list[str]:
    """Paths of the staged tables that exist now."""
    return list(_staged)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove staged tables by path."""
    for path in paths:
        _remove(spark, path)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Remove at its end every table staged inside; results must be written or read before."""
    before = set(_staged)
    try:
        yield
    finally:
        remove(spark, [p for p in _staged if p not in before])
