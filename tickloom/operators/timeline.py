"""The prediction timeline: one of six states per row, raw or bucketed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import event_time, micros

CLASSES = ("correct_call", "false_alarm", "missed_spike", "correct_quiet", "pending", "unavailable")
MAX_POINTS = 1000
HORIZON_SECONDS = 60

# fixed values: bucket widths in seconds that give readable boundaries
RESOLUTIONS = (
    1, 2, 5, 10, 15, 30, 60, 120, 300, 600, 900, 1800, 3600, 7200, 14400, 21600, 43200, 86400,
)


def auto_resolution(range_seconds: float, max_points: int = MAX_POINTS) -> int:
    """Smallest readable bucket that keeps the range within `max_points`."""
    day = RESOLUTIONS[-1]  # beyond the ladder: whole days
    whole = -(-range_seconds // (max_points * day)) * day
    return next((step for step in RESOLUTIONS if range_seconds / step <= max_points), int(whole))


def row_class(anchor: Column, horizon_seconds: float = HORIZON_SECONDS) -> Column:
    """State of a joined row; `anchor` is the newest event time of the segment."""
    seen, api, written = event_time("feature_ts"), event_time("api_ts"), event_time("written_at")
    age = F.unix_micros(anchor) - F.unix_micros(seen)
    waiting = (age >= 0) & (age < micros(horizon_seconds))
    in_time = F.coalesce(api < written, F.lit(False))
    usable = F.col("score").isNotNull() & F.col("tau").isNotNull() & F.col("vol_spike").isNotNull()
    called, spiked = F.col("score") >= F.col("tau"), F.col("vol_spike") != 0
    return (
        F.when(
            F.col("written_at").isNull(),
            F.when(F.coalesce(waiting, F.lit(False)), "pending").otherwise("unavailable"),
        )
        .when(~in_time | ~usable, "unavailable")
        .when(called & spiked, "correct_call")
        .when(called, "false_alarm")
        .when(spiked, "missed_spike")
        .otherwise("correct_quiet")
    )


def classify(joined: DataFrame, anchor: Column, horizon_seconds: float = HORIZON_SECONDS) -> DataFrame:
    rows = joined.withColumn("__anchor", anchor)
    return rows.withColumn("class", row_class(F.col("__anchor"), horizon_seconds)).drop("__anchor")


def raw_points(classified: DataFrame) -> DataFrame:
    return classified.select(
        "feature_ts", "api_ts", "feature_id", "market_price", "score", "tau", "class"
    )


def bucket_points(classified: DataFrame, start: Column, resolution_seconds: int) -> DataFrame:
    """Per bucket: highest score (earliest row on ties) with its tau, last price, counts per class.

    Only aggregates with map-side combine, so a busy bucket does not matter.
    """
    width = micros(resolution_seconds)
    seen = F.unix_micros(event_time("feature_ts"))
    origin = F.unix_micros(start)
    rows = classified.where(event_time("feature_ts").isNotNull()).withColumns(
        {"__at": seen, "bucket": F.floor((seen - origin) / F.lit(width))}
    )
    top = F.struct(F.col("score"), -F.col("__at"), F.col("event_id"))
    best = F.max_by(F.struct("score", "tau"), F.when(F.col("score").isNotNull(), top))
    price = F.max_by(
        "market_price", F.when(F.col("market_price").isNotNull(), F.struct("__at", "event_id"))
    )
    points = rows.groupBy("bucket").agg(
        price.alias("market_price"),
        best.alias("best"),
        *[F.count_if(F.col("class") == name).alias(name) for name in CLASSES],
    )
    return points.select(
        "bucket",
        F.timestamp_micros(origin + F.col("bucket") * width).alias("feature_ts"),
        "market_price",
        F.col("best.score").alias("score"),
        F.col("best.tau").alias("tau"),
        *CLASSES,
    )


def timeline(
    joined: DataFrame,
    start: Column,
    end: Column,
    anchor: Column,
    range_seconds: float,
    resolution_seconds: int | str | None = None,
    horizon_seconds: float = HORIZON_SECONDS,
) -> tuple[DataFrame, bool, int | None]:
    """Points of `[start, end)`: raw without a resolution, else in buckets of so many seconds ("auto": by the range).

    The caller decides; how many rows there are never changes the form.
    """
    seen = event_time("feature_ts")
    classified = classify(joined.where((seen >= start) & (seen < end)), anchor, horizon_seconds)
    if resolution_seconds is None:
        return raw_points(classified), False, None
    used = auto_resolution(max(range_seconds, 1.0)) if resolution_seconds == "auto" else int(resolution_seconds)
    return bucket_points(classified, start, used), True, used


def point_flags(points: DataFrame) -> DataFrame:
    """Boolean chart flags, from the class of a raw point or the counts of a bucket."""
    if "class" in points.columns:
        has = lambda *names: F.col("class").isin(*names)
    else:
        has = lambda *names: sum((F.coalesce(F.col(n), F.lit(0)) for n in names), F.lit(0)) > 0
    return points.withColumns(
        {
            "predicted": has("correct_call", "false_alarm"),
            "confirmed_spike": has("correct_call", "missed_spike"),
            "is_false_alarm": has("false_alarm"),
            "is_missed_spike": has("missed_spike"),
            "is_pending": has("pending"),
            "is_unavailable": has("unavailable"),
        }
    )
