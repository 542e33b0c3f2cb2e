"""Helpers shared by the operators: tables, bounded batches inside tasks, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.lineage import stage, unstage

#: Bytes of text that a task turns into arrays at once; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Rows and bytes that pass between the JVM and Python at once: texts may be long, and both sides hold a batch.
ARROW_ROWS, ARROW_BYTES = 1_000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound what a batch of whole texts takes in an executor; a smaller setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= ARROW_ROWS:
        spark.conf.set(name, str(ARROW_ROWS))
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(name).rstrip("b")) <= ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole given table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a text column; null counts as empty. No copy is made of a plain column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return held[first:last], offsets - first


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with at most `most` bytes of text, one row at least."""
    if not batch.num_rows:
        return
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(text)))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + most, side="right")) - 1
        end = min(max(end, start + 1), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def components(edges: DataFrame) -> DataFrame:
    """Connected components of `edges` (a long, b long): (node, component), the smallest node of each component.

    Alternating large and small stars: every step replaces edges by edges to the smallest neighbour, which keeps
    connectivity and ends with stars. Each step is an aggregate and an equi-join, written to the shared folder, so
    no component is ever gathered in one task. Nodes without edges are not returned.
    """

    def smallest(sym: DataFrame) -> DataFrame:
        return sym.groupBy("a").agg(F.min("b").alias("m"))

    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        sym = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = smallest(sym).select("a", F.least("a", "m").alias("m"))
        large = sym.join(m, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: larger end a, its smaller neighbours b; all of them point to the smallest of them
        low = smallest(large)
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
        old, edges = edges, stage(small.where("a <> b").distinct())
        unstage(old)
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == (state["n"], state["x"]):
            break
        before = (state["n"], state["x"])
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()).distinct()


def may_hold(df: DataFrame, column: str, keys: DataFrame, how: str = "left_semi", most_bits: int = 1 << 26) -> DataFrame:
    """Rows of `df` whose `column` may be among `keys` (one column of that name); `left_anti`: the rows whose is surely not.

    A bitmap of at most 8 MB is broadcast in words, so a later equi-join moves fewer rows: every row with a key may hold
    it, some others may too; null is a value like others. It runs without Python, beside which a task may need its own.
    """
    n = max(1, keys.count())
    bits = min(most_bits, 1 << max(10, (16 * n - 1).bit_length()))
    place = F.pmod(F.xxhash64(column), F.lit(bits))
    words = keys.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("_bits")
    )
    there = (F.shiftright(place, 6) == F.col("_word")) & (F.getbit(F.col("_bits"), (place % 64).cast("int")) == 1)
    return df.join(F.broadcast(words), there, how)
