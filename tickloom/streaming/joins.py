"""Streaming dedupe, prediction/outcome join, and windowed roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import event_time
from tickloom.operators.identity import DEDUPE_KEY
from tickloom.operators.profile import service_rollup


def drop_redelivered_stream(ticks: DataFrame, delay: str = "10 minutes", ts: str = "ts", key: Sequence[str] = DEDUPE_KEY) -> DataFrame:
    """Bounded redelivery guard; the watermark only bounds the state."""
    return ticks.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(key))


def join_outcome_stream(
    predictions: DataFrame,
    outcomes: DataFrame,
    horizon: str = "60 seconds",
    slack: str = "60 seconds",
    delay: str = "2 minutes",
) -> DataFrame:
    """Predictions with the outcome of their tick, which follows about a horizon later.

    A prediction whose outcome never comes is emitted without one when the
    watermark has passed. Both sides carry `feature_ts`; `outcome_at` of an outcome
    is when it became known.
    """
    left = predictions.withColumn("prediction_at", event_time("feature_ts")).withWatermark("prediction_at", delay)
    right = outcomes.select(
        F.col("feature_id").alias("outcome_feature_id"),
        (event_time("feature_ts") + F.expr(f"INTERVAL {horizon}")).alias("outcome_at"),
        "future_vol_60s", "vol_spike", "label_schema", *[c for c in ("written_at",) if c in outcomes.columns],
    ).withWatermark("outcome_at", delay)
    near = (F.col("outcome_at") >= F.col("prediction_at")) & (
        F.col("outcome_at") <= F.col("prediction_at") + F.expr(f"INTERVAL {horizon}") + F.expr(f"INTERVAL {slack}")
    )
    return left.join(right, (F.col("feature_id") == F.col("outcome_feature_id")) & near, "leftOuter").drop(
        "outcome_feature_id"
    )


def service_rollup_stream(log: DataFrame, delay: str = "5 minutes", **options) -> DataFrame:
    """Sliding service metrics of a request log."""
    return service_rollup(log.withWatermark("ts", delay), **options)


def timeline_stream(classified: DataFrame, width: str = "1 minute", delay: str = "5 minutes") -> DataFrame:
    """Tumbling counts per class; `classified` has `at` and `class`."""
    return (
        classified.withWatermark("at", delay)
        .groupBy(F.window("at", width).alias("w"), "class")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("bucket"), "class", "n")
    )
