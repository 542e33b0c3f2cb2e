"""Column expressions shared by the operators.

Everything here is a plain Catalyst expression, so it stays inside whole-stage
code generation and can be pushed, pruned and folded by the optimizer.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000

ColumnLike = Column | str


def col(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def micros(seconds: float) -> int:
    """Seconds as whole microseconds, the resolution of a Spark timestamp."""
    return int(round(seconds * MICROS))


def ratio(numerator: ColumnLike, denominator: ColumnLike, default: float | None = 0.0) -> Column:
    """Division that yields `default` for a zero denominator (ANSI mode would raise)."""
    quotient = F.try_divide(col(numerator).cast("double"), col(denominator).cast("double"))
    return quotient if default is None else F.coalesce(quotient, F.lit(default))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda left, right: left & right, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(lambda left, right: left | right, conditions)


# -- time ---------------------------------------------------------------------


def event_time(value: ColumnLike) -> Column:
    """Timestamp of an ISO-8601 string (nanoseconds cut to microseconds), null if malformed."""
    return F.try_to_timestamp(col(value))


def ts_micros(value: ColumnLike) -> Column:
    """Epoch microseconds of a timestamp of either flavour, read as UTC."""
    return F.unix_micros(col(value).cast("timestamp"))


def from_micros(value: ColumnLike) -> Column:
    return F.timestamp_micros(col(value))


def normalize_ts(value: ColumnLike) -> Column:
    """Canonical UTC text with six digits and `+00:00`; malformed text passes through."""
    raw = col(value)
    return F.coalesce(
        F.date_format(F.try_to_timestamp(raw), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'"), raw
    )


# -- prices -------------------------------------------------------------------


def midprice(bid: ColumnLike, ask: ColumnLike) -> Column:
    return (col(bid) + col(ask)) / F.lit(2.0)


def spread_abs(bid: ColumnLike, ask: ColumnLike) -> Column:
    return col(ask) - col(bid)


def spread_bps(bid: ColumnLike, ask: ColumnLike) -> Column:
    mid = midprice(bid, ask)
    return F.when(mid > 0, F.try_divide(spread_abs(bid, ask), mid) * 1e4).otherwise(F.lit(0.0))


def book_imbalance(bid_size: ColumnLike, ask_size: ColumnLike) -> Column:
    total = col(bid_size) + col(ask_size)
    return F.when(total > 0, F.try_divide(col(bid_size) - col(ask_size), total)).otherwise(F.lit(0.0))


def log_return(current: ColumnLike, previous: ColumnLike) -> Column:
    """ln(current / previous); 0 without a positive previous price."""
    usable = col(previous) > 0
    return F.when(usable, F.ln(F.try_divide(col(current), col(previous)))).otherwise(F.lit(0.0))


# -- numbers ------------------------------------------------------------------


def is_finite(value: ColumnLike) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    number = col(value).cast("double")
    return F.coalesce(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), F.lit(False))


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Array of the codes whose condition holds, in the given order."""
    return F.filter(
        F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in pairs]),
        lambda code: code.isNotNull(),
    )
