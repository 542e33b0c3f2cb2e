"""Algebra on half-open intervals `[start, end)`; times are numbers (epoch microseconds).

Overlap questions are answered by sorting, never by pairing rows: gaps are first
merged into disjoint intervals, after which the only candidate for a row is the
last gap that starts before the row ends.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import MICROS, ColumnLike, col
from tickloom.plans.lineage import stage

DAY_US = 86_400 * MICROS
CHUNK_US = 3_600 * MICROS


def _chunk(name: str, width: int) -> Column:
    return F.floor(F.col(name) / F.lit(width))


def interval_union(
    df: DataFrame, keys: Sequence[str] = (), start: str = "start", end: str = "end", chunk_us: int = CHUNK_US
) -> DataFrame:
    """Disjoint intervals covering the same time; overlapping or touching ones are merged."""
    rows = stage(
        df.select(*keys, F.col(start).alias("__s"), F.col(end).alias("__e"))
        # intervals with equal starts collapse map-side to the longest
        .groupBy(*keys, "__s")
        .agg(F.max("__e").alias("__e"))
        .withColumn("__chunk", _chunk("__s", chunk_us))
    )
    reach = scan.running_max(rows, keys, "__chunk", ["__s"], "__reach", "__e")
    opens = F.when(F.col("__reach").isNull() | (F.col("__s") > F.col("__reach")), 1).otherwise(0)
    # an island ends where the next one finds the reach of everything before it
    firsts = reach.withColumn("__opens", opens).where(F.col("__opens") == 1)
    ends = rows.groupBy(*keys).agg(F.max("__e").alias("__final"))
    islands = scan.next_row(firsts, keys, "__chunk", ["__s"], {"__end": F.col("__reach")})
    if keys:
        islands = scan.join_null_safe(islands, ends, list(keys))
    else:
        islands = islands.withColumn("__final", ends.scalar())
    return stage(
        islands.select(*keys, F.col("__s").alias(start), F.coalesce("__end", "__final").alias(end))
    )


def interval_subtract(
    base: DataFrame,
    cuts: DataFrame,
    keys: Sequence[str] = (),
    start: str = "start",
    end: str = "end",
    chunk_us: int = CHUNK_US,
    merged: bool = False,
) -> DataFrame:
    """The parts of `base` no cut covers, by a sweep over the boundaries of both. `merged`: the cuts are disjoint already."""

    def edges(df: DataFrame, name: str) -> DataFrame:
        other = "__cut" if name == "__base" else "__base"
        both = F.array(
            F.struct(F.col(start).alias("__t"), F.lit(1).alias(name)),
            F.struct(F.col(end).alias("__t"), F.lit(-1).alias(name)),
        )
        return df.select(*keys, F.explode(both).alias("__edge")).select(
            *keys, "__edge.*", F.lit(0).alias(other)
        )

    merged_base = interval_union(base, keys, start, end, chunk_us)
    merged_cuts = cuts if merged else interval_union(cuts, keys, start, end, chunk_us)
    moves = (
        edges(merged_base, "__base")
        .unionByName(edges(merged_cuts, "__cut"))
        .groupBy(*keys, "__t")
        .agg(F.sum("__base").alias("__base"), F.sum("__cut").alias("__cut"))
        .withColumn("__chunk", _chunk("__t", chunk_us))
    )
    moves = stage(moves)
    closed = scan.next_row(moves, keys, "__chunk", ["__t"], {"__until": F.col("__t")})
    closed = scan.running_totals(
        closed, keys, "__chunk", ["__t"], {"__in": F.col("__base"), "__out": F.col("__cut")}, totals_from=moves
    )
    return closed.where((F.col("__in") > 0) & (F.col("__out") == 0) & F.col("__until").isNotNull()).select(
        *keys, F.col("__t").alias(start), F.col("__until").alias(end)
    )


def covered_seconds(start: ColumnLike = "start", end: ColumnLike = "end") -> Column:
    """Sum of whole seconds, each interval truncated on its own."""
    return F.sum(F.floor((col(end) - col(start)) / F.lit(MICROS)))


def split_by_day(df: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """One row per UTC day an interval touches, clipped to the day; `day` is a date."""
    first = F.floor(F.col(start) / F.lit(DAY_US))
    last = F.floor((F.col(end) - 1) / F.lit(DAY_US))
    days = df.where(F.col(start) < F.col(end)).withColumn("__day", F.explode(F.sequence(first, last)))
    return days.withColumns(
        {
            start: F.greatest(F.col(start), F.col("__day") * DAY_US),
            end: F.least(F.col(end), (F.col("__day") + 1) * DAY_US),
            "day": F.date_from_unix_date(F.col("__day").cast("int")),
        }
    ).drop("__day")


def flag_overlap(
    rows: DataFrame,
    gaps: DataFrame,
    keys: Sequence[str] = (),
    row_start: ColumnLike = "start",
    row_end: ColumnLike = "end",
    gap_start: str = "start",
    gap_end: str = "end",
    name: str = "overlaps",
    chunk_us: int = CHUNK_US,
    merged: bool = False,
) -> DataFrame:
    """Add whether some gap satisfies `row.start < gap.end and gap.start < row.end`. `merged`: the gaps are disjoint already."""
    if not merged:
        gaps = interval_union(gaps.select(*keys, gap_start, gap_end), keys, gap_start, gap_end, chunk_us)
    matched = scan.asof_backward(
        rows, gaps, keys, row_end, gap_start, {"__gap_end": F.col(gap_end)}, chunk_us, allow_exact=False
    )
    return matched.withColumn(name, F.coalesce(F.col("__gap_end") > col(row_start), F.lit(False))).drop(
        "__gap_end"
    )


def flag_inside(
    rows: DataFrame,
    gaps: DataFrame,
    keys: Sequence[str] = (),
    at: ColumnLike = "ts_us",
    gap_start: str = "start",
    gap_end: str = "end",
    name: str = "inside",
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Add whether the instant lies in some `[gap.start, gap.end)`."""
    merged = interval_union(gaps.select(*keys, gap_start, gap_end), keys, gap_start, gap_end, chunk_us)
    matched = scan.asof_backward(rows, merged, keys, at, gap_start, {"__gap_end": F.col(gap_end)}, chunk_us)
    return matched.withColumn(name, F.coalesce(F.col("__gap_end") > col(at), F.lit(False))).drop("__gap_end")


def continuity_islands(
    df: DataFrame,
    keys: Sequence[str],
    at: str = "ts_us",
    step_us: int = MICROS,
    chunk_us: int = CHUNK_US,
) -> DataFrame:
    """Runs of instants exactly one step apart, as `[first, last + step)`."""
    rows = df.select(*keys, F.col(at).alias("__t")).distinct().withColumn("__chunk", _chunk("__t", chunk_us))
    seen = stage(scan.previous_row(rows, keys, "__chunk", ["__t"], {"__before": F.col("__t")}))
    opens = F.when(F.col("__before").isNull() | (F.col("__t") != F.col("__before") + step_us), 1).otherwise(0)
    runs = scan.running_totals(seen, keys, "__chunk", ["__t"], {"__island": opens})
    return (
        runs.groupBy(*keys, "__island")
        .agg(F.min("__t").alias("start"), (F.max("__t") + step_us).alias("end"))
        .drop("__island")
    )


def true_bands(
    df: DataFrame,
    flag: str,
    at: str = "ts_us",
    keys: Sequence[str] = (),
    order: Sequence[str] | None = None,
    chunk_us: int = CHUNK_US,
    default_gap_us: int = MICROS,
) -> DataFrame:
    """Spans `[x1, x2]` of consecutive rows whose flag is true.

    A span of a single instant is widened by half the (upper) median positive gap
    between rows on either side.
    """
    order = list(order or [at])
    rows = df.withColumn("__chunk", _chunk(at, chunk_us)).withColumn(
        "__on", F.coalesce(F.col(flag), F.lit(False))
    )
    seen = stage(
        scan.previous_row(
            rows.select(*keys, *dict.fromkeys([at, *order]), "__chunk", "__on"),
            keys, "__chunk", order, {"__before": F.col(at), "__was": F.col("__on")},
        )
    )
    gaps = seen.where(F.col(at) > F.col("__before")).select(
        *keys, (F.col(at) - F.col("__before")).alias("__gap")
    )
    half = _upper_median(gaps, "__gap", keys, "__half")
    opens = F.when(F.col("__on") & ~F.coalesce(F.col("__was"), F.lit(False)), 1).otherwise(0)
    runs = scan.running_totals(seen, keys, "__chunk", order, {"__band": opens}).where(F.col("__on"))
    spans = runs.groupBy(*keys, "__band").agg(F.min(at).alias("x1"), F.max(at).alias("x2")).drop("__band")
    widened = scan.join_null_safe(spans, half, list(keys)) if keys else spans.withColumn("__half", half.scalar())
    pad = F.when(F.col("x1") == F.col("x2"), F.coalesce(F.col("__half"), F.lit(default_gap_us)) / 2).otherwise(0)
    return widened.select(*keys, (F.col("x1") - pad).alias("x1"), (F.col("x2") + pad).alias("x2"))


def _upper_median(df: DataFrame, value: str, keys: Sequence[str], name: str) -> DataFrame:
    """The element at position floor(n / 2) of the sorted values."""
    ladder = scan.value_ladder(df, value, {"n": F.lit(1).cast("bigint")}, keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__total"))
    sized = (
        scan.join_null_safe(ladder, sizes, list(keys)) if keys else ladder.withColumn("__total", sizes.scalar())
    )
    wanted = F.floor(F.col("__total") / F.lit(2))
    hit = (wanted >= F.col("cum_n") - F.col("n")) & (wanted < F.col("cum_n"))
    return sized.groupBy(*keys).agg(F.max(F.when(hit, F.col(value))).alias(name))
