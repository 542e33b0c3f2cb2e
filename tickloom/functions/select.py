"""Exact selection of the first k rows in an order, without a sort of all rows and without gathering k rows of every task.

The k-th position is found by a histogram that is refined: counts per range of one 64-bit key combine map-side, the range
the position falls in is cut further, until its bound is one value (four rounds of at most 65 536 ranges, whose counts are all that is
collected). Rows before the
bound are chosen by a filter; only rows that share the bound value are put in order by the other columns.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ColumnLike, col

BITS = 16


def kth_smallest(df: DataFrame, key: ColumnLike, k: int) -> tuple[int | None, int]:
    """The k-th smallest non-null value of a long column (k from 1) and how many values are smaller; (None, number of
    values) when there are fewer than k."""
    if k < 1:
        raise ValueError("k counts from 1")
    shifted = col(key).cast("bigint")
    low, width, before = -(1 << 63), 64, 0
    rows = df.select(shifted.alias("__v")).where("__v IS NOT NULL")
    while width:
        step = min(BITS, width)
        width -= step
        inside = rows if width + step == 64 else rows.where(
            (F.col("__v") >= F.lit(low)) & (F.col("__v") <= F.lit(low + (1 << (width + step)) - 1))
        )
        # unsigned order of the leading bits: the sign bit is turned
        flipped = F.col("__v").bitwiseXOR(F.lit(-(1 << 63)))
        place = F.shiftrightunsigned(flipped, width).bitwiseAND(F.lit((1 << step) - 1))
        counts = inside.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"))
        found = counts.toPandas().sort_values("b")
        running = found["n"].cumsum().to_numpy(np.int64)
        at = int(np.searchsorted(running, k - before))
        if at == len(running):
            return None, before + (int(running[-1]) if at else 0)
        before += int(running[at] - found["n"].iloc[at])
        low += int(found["b"].iloc[at]) << width
    return low, before


def first_rows(df: DataFrame, key: ColumnLike, k: int, ties: list[Column]) -> DataFrame:
    """The first `k` rows by (`key` ascending with nulls last, `ties`), exactly k if there are as many.

    `key` is a long. Rows beyond the k-th key never leave their task. Rows that share the k-th key are ranked by `ties`
    with a rank limit that Spark applies in every task before its shuffle.
    """
    bound, before = kth_smallest(df, key, k)
    number = col(key).cast("bigint")
    if bound is None:
        chosen, at, left = df.where(number.isNotNull()), number.isNull(), k - before
    else:
        chosen, at, left = df.where(number < F.lit(bound)), number == F.lit(bound), k - before
    if left <= 0:
        return chosen
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*ties))
    last = df.where(at).withColumn("__rank", rank).where(F.col("__rank") <= left).drop("__rank")
    return chosen.unionByName(last)


def hashed_sample(df: DataFrame, by: Column, n: int, buckets: int = 1 << 16) -> DataFrame:
    """About `n` rows (at most `n` and the rows that share one hash bucket), chosen by a hash of `by`: all rows if there
    are no more. Counts per bucket come first, so the choice is a filter and nothing beyond it is gathered.

    The same rows are chosen however they are dealt out. Repeated values of `by` go together.
    """
    place = F.pmod(F.xxhash64(by), F.lit(buckets))
    counts = df.groupBy(place.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    found = counts.toPandas().sort_values("b")
    over = np.flatnonzero(found["n"].cumsum().to_numpy(np.int64) > n)
    if not len(over):
        return df
    return df.where(place < F.lit(int(found["b"].iloc[max(int(over[0]), 1)] if len(found) > 1 else buckets)))
