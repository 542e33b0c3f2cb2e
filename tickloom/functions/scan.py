"""Ordered scans that stay parallel when one key holds most of the rows.

A window function needs its whole partition in one task.  For a running total or
a look-back to the previous row that is not necessary: cut every key into ordered
chunks, reduce each chunk to one summary row (with map-side combine), scan the
summaries, and start every chunk from what precedes it.  A hot key is then as
parallel as its number of chunks; only the summaries meet in one task.

All helpers take a `chunk` column that must be non-decreasing in the scan order
(for example a time slice, or `arrival DIV n`).  The rows are shuffled once, on
(keys, chunk): the summary join and the window share that partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import ColumnLike, col

#: A ladder is cut into as many value ranges as the session has shuffle partitions, within these limits.
MIN_LADDER_CHUNKS = 16
MAX_LADDER_CHUNKS = 4096


def join_null_safe(df: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on the keys where null keys meet each other, as they do in a window."""
    renamed = summary.select(
        *[F.col(key).alias(f"__k{i}") for i, key in enumerate(keys)],
        *[F.col(name) for name in summary.columns if name not in keys],
    )
    condition = [F.col(key).eqNullSafe(F.col(f"__k{i}")) for i, key in enumerate(keys)]
    return df.join(renamed, condition, "left").drop(*[f"__k{i}" for i in range(len(keys))])


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    values: Mapping[str, ColumnLike],
) -> DataFrame:
    """Add the `values` of the preceding row of the same key, of whatever age."""
    packed = F.struct(*[col(value).alias(name) for name, value in values.items()])
    position = F.struct(*[F.col(name) for name in order])
    tails = df.groupBy(*keys, chunk).agg(F.max_by(packed, position).alias("__tail"))
    over_chunks = Window.partitionBy(*keys).orderBy(chunk)
    carried = tails.select(*keys, chunk, F.lag("__tail").over(over_chunks).alias("__carry"))
    within = Window.partitionBy(*keys, chunk).orderBy(*order)
    joined = join_null_safe(df, carried, [*keys, chunk])
    previous = joined.withColumn("__prev", F.coalesce(F.lag(packed).over(within), F.col("__carry")))
    return previous.withColumns({name: F.col(f"__prev.{name}") for name in values}).drop(
        "__prev", "__carry"
    )


def next_row(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    values: Mapping[str, ColumnLike],
) -> DataFrame:
    """Add the `values` of the following row of the same key."""
    packed = F.struct(*[col(value).alias(name) for name, value in values.items()])
    position = F.struct(*[F.col(name) for name in order])
    heads = df.groupBy(*keys, chunk).agg(F.min_by(packed, position).alias("__head"))
    over_chunks = Window.partitionBy(*keys).orderBy(chunk)
    carried = heads.select(*keys, chunk, F.lead("__head").over(over_chunks).alias("__carry"))
    within = Window.partitionBy(*keys, chunk).orderBy(*order)
    joined = join_null_safe(df, carried, [*keys, chunk])
    following = joined.withColumn("__next", F.coalesce(F.lead(packed).over(within), F.col("__carry")))
    return following.withColumns({name: F.col(f"__next.{name}") for name in values}).drop(
        "__next", "__carry"
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    totals: Mapping[str, ColumnLike],
    descending: bool = False,
    totals_from: DataFrame | None = None,
) -> DataFrame:
    """Add inclusive running sums; `descending` scans the order from its end.

    `totals_from` may name a cheaper frame with the same rows for the chunk sums.
    """
    direction = (lambda name: F.col(name).desc()) if descending else (lambda name: F.col(name).asc())
    source = df if totals_from is None else totals_from
    parts = source.groupBy(*keys, chunk).agg(
        *[F.sum(col(value)).alias(f"__sum_{name}") for name, value in totals.items()]
    )
    before = (
        Window.partitionBy(*keys)
        .orderBy(direction(chunk))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.select(
        *keys, chunk, *[F.sum(f"__sum_{name}").over(before).alias(f"__off_{name}") for name in totals]
    )
    within = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*[direction(name) for name in order])
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = join_null_safe(df, offsets, [*keys, chunk])
    return joined.withColumns(
        {
            name: F.sum(col(value)).over(within) + F.coalesce(F.col(f"__off_{name}"), F.lit(0))
            for name, value in totals.items()
        }
    ).drop(*[f"__off_{name}" for name in totals])


def running_max(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    name: str,
    value: ColumnLike,
) -> DataFrame:
    """Add the maximum of `value` over all *earlier* rows of the key (null for the first)."""
    parts = df.groupBy(*keys, chunk).agg(F.max(col(value)).alias("__max"))
    earlier_chunks = (
        Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = parts.select(*keys, chunk, F.max("__max").over(earlier_chunks).alias("__off"))
    earlier_rows = (
        Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = join_null_safe(df, offsets, [*keys, chunk])
    # greatest() skips nulls, so a chunk without predecessors is fine on either side
    return joined.withColumn(name, F.greatest(F.max(col(value)).over(earlier_rows), F.col("__off"))).drop(
        "__off"
    )


def row_index(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], name: str = "row_index"
) -> DataFrame:
    """Add the zero-based position of each row within its key."""
    indexed = running_totals(df, keys, chunk, order, {name: F.lit(1).cast("bigint")})
    return indexed.withColumn(name, F.col(name) - 1)


def ladder_chunks(df: DataFrame) -> int:
    """As many value ranges as the session shuffles into, within sensible limits."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(MIN_LADDER_CHUNKS, min(partitions, MAX_LADDER_CHUNKS))


def edges_below(edges: Column, value: Column, most: int) -> Column:
    """How many of at most `most` sorted edges are smaller than the value, by bisection."""
    state = F.struct(F.lit(0).alias("low"), F.size(edges).alias("high"))

    def halve(span: Column, _: Column) -> Column:
        middle = F.floor((span["low"] + span["high"]) / F.lit(2)).cast("int")
        open_ = span["low"] < span["high"]
        right = open_ & (F.get(edges, middle) < value)
        return F.struct(
            F.when(right, middle + 1).otherwise(span["low"]).alias("low"),
            F.when(open_ & ~right, middle).otherwise(span["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.lit(most.bit_length()))
    return F.aggregate(steps, state, halve, lambda span: span["low"])


def with_value_chunk(
    df: DataFrame, source: DataFrame, value: str, name: str = "__chunk", chunks: int | None = None
) -> DataFrame:
    """Add the range number of `value`, ranges being equally filled by the `source` rows.

    For a scan of distinct values `source` holds every value once: a value that most rows share must not draw the
    edges to itself.

    The edges come from an approximate-quantile sketch of bounded size, combined
    map-side, and reach the rows as one scalar array: nothing that grows with the
    data is collected or broadcast.
    """
    chunks = chunks or ladder_chunks(df)
    shares = [i / chunks for i in range(1, chunks)]
    sketch = F.percentile_approx(F.col(value), shares, max(1000, 10 * chunks))
    edges = source.agg(F.array_sort(F.array_distinct(sketch)).alias("edges")).scalar()
    ranged = df.withColumn("__edges", edges)
    below = edges_below(F.col("__edges"), F.col(value), chunks)
    return ranged.withColumn(name, F.coalesce(below, F.lit(0))).drop("__edges")


def order_chunk(df: DataFrame, column: str, width: int | None = None, name: str = "__chunk") -> DataFrame:
    """Add the chunk of an ordered scan over `column`: ranges that hold equally many rows, however dense the rows lie in
    places (a quantile sketch of bounded size), or, with `width`, slices of the column of that width."""
    if width is not None:
        return df.withColumn(name, F.floor(F.col(column) / F.lit(width)))
    return with_value_chunk(df, df, column, name)


def value_ladder(
    df: DataFrame,
    value: str,
    weights: Mapping[str, ColumnLike],
    keys: Sequence[str] = (),
    descending: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """One row per distinct (keys, value) with weight sums and `cum_*` running totals.

    Equal values are combined before the shuffle, so a value that holds a third of
    all rows costs one row per task, and ties form one step by construction.
    """
    present = df.where(F.col(value).isNotNull())
    steps = present.groupBy(*keys, value).agg(
        *[F.sum(col(weight)).alias(name) for name, weight in weights.items()]
    )
    # per key the same value is one step, so the steps themselves are what the ranges must share evenly; their
    # exchange serves the sketch and the scan
    chunked = with_value_chunk(steps, steps, value, "__chunk", chunks)
    return running_totals(
        chunked,
        list(keys),
        "__chunk",
        [value],
        {f"cum_{name}": F.col(name) for name in weights},
        descending=descending,
    )


def exact_quantiles(
    df: DataFrame,
    value: str,
    shares: Mapping[str, float],
    keys: Sequence[str] = (),
    nearest_rank: bool = False,
    chunks: int | None = None,
) -> DataFrame:
    """Exact quantiles per key from the distributed ladder; no task holds all values.

    Linear interpolation between closest ranks by default; `nearest_rank` returns
    the ceil(p * n)-th value instead.
    """
    number = df.withColumn(value, F.col(value).cast("double"))
    ladder = value_ladder(number, value, {"n": F.lit(1).cast("bigint")}, keys, chunks=chunks)
    sizes = number.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    if keys:
        sized = join_null_safe(ladder, sizes, list(keys))
    else:
        sized = ladder.withColumn("__total", sizes.scalar())
    first, last = F.col("cum_n") - F.col("n"), F.col("cum_n") - 1
    aggregates = []
    for name, share in shares.items():
        if nearest_rank:
            wanted = F.greatest(F.ceil(F.lit(share) * F.col("__total")) - 1, F.lit(0))
            hit = (wanted >= first) & (wanted <= last)
            aggregates.append(F.max(F.when(hit, F.col(value))).alias(name))
            continue
        position = F.lit(share) * (F.col("__total") - 1)
        low, high = F.floor(position), F.ceil(position)
        low_value = F.max(F.when((low >= first) & (low <= last), F.col(value)))
        high_value = F.max(F.when((high >= first) & (high <= last), F.col(value)))
        weight = F.max(position - low)
        aggregates.append((low_value + (high_value - low_value) * weight).alias(name))
    return sized.groupBy(*keys).agg(*aggregates)


def last_known(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    value: str,
    inclusive: bool = True,
) -> DataFrame:
    """Replace `value` by the latest non-null one up to (or before) each row of the key."""
    position = F.struct(*[F.col(name) for name in order])
    present = F.col(value).isNotNull()
    tails = df.groupBy(*keys, chunk).agg(
        F.max_by(F.when(present, F.col(value)), F.when(present, position)).alias("__tail")
    )
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, chunk, F.last("__tail", ignorenulls=True).over(earlier).alias("__carry"))
    within = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    joined = join_null_safe(df, carried, [*keys, chunk])
    return joined.withColumn(
        value, F.coalesce(F.last(value, ignorenulls=True).over(within), F.col("__carry"))
    ).drop("__carry")


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: ColumnLike,
    right_time: ColumnLike,
    values: Mapping[str, ColumnLike],
    chunk_width: int,
    allow_exact: bool = True,
    right_tie: ColumnLike | None = None,
) -> DataFrame:
    """Left rows with the `values` of the latest right row at or before their time.

    Times are numbers (epoch microseconds). Both sides are interleaved and the
    right values carried forward, so the cost is one sort whatever the distance to
    the match. Unmatched left rows keep nulls; right ties resolve to the largest
    `right_tie`.
    """
    tie = F.lit(0).cast("bigint") if right_tie is None else col(right_tie).cast("bigint")
    packed = F.struct(*[col(value).alias(name) for name, value in values.items()])
    right_side, left_side = (0, 1) if allow_exact else (1, 0)
    book = right.select(
        *keys, col(right_time).cast("bigint").alias("__t"), F.lit(right_side).alias("__side"),
        tie.alias("__tie"), packed.alias("__value"),
    )
    probe = left.select(
        *keys, col(left_time).cast("bigint").alias("__t"), F.lit(left_side).alias("__side"),
        F.lit(0).cast("bigint").alias("__tie"),
        F.struct(*[F.col(name) for name in left.columns]).alias("__row"),
    )
    both = probe.unionByName(book, allowMissingColumns=True).withColumn(
        "__chunk", F.floor(F.col("__t") / F.lit(chunk_width))
    )
    matched = last_known(both, keys, "__chunk", ["__t", "__side", "__tie"], "__value")
    return matched.where(F.col("__row").isNotNull()).select(
        "__row.*", *[F.col(f"__value.{name}").alias(name) for name in values]
    )
