"""Dataset profile: coverage, prevalence, arrival gaps, autocorrelation, correlations."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions import scan
from tickloom.functions.exprs import MICROS, from_micros, is_finite
from tickloom.plans.lineage import stage

GAP_SECONDS = 60.0
LAG_SECONDS = (1, 5, 60, 300)
CHUNK_US = 3_600 * MICROS


def _chunked(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("__chunk", F.floor(F.col(ts) / F.lit(CHUNK_US)))


def profile(df: DataFrame, target: str = "vol_spike", ts: str = "ts_us") -> DataFrame:
    """One row of dataset-level facts and the gates that depend on the data only."""
    per_instant = df.groupBy(ts).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("bigint")).alias("pos"),
        F.count(target).alias("known"),
    )
    day = lambda name: F.to_date(from_micros(name))
    row = per_instant.agg(
        F.sum("n").alias("rows"),
        F.min(ts).alias("__start"),
        F.max(ts).alias("__end"),
        F.sum(F.col("n") - 1).alias("duplicate_timestamps"),
        F.sum("pos").alias("positives"),
        F.try_divide(F.sum("pos"), F.sum("known")).alias("positive_rate"),
    )
    days = F.date_diff(day("__end"), day("__start")) + 1
    return row.select(
        "rows",
        from_micros("__start").alias("start_time"),
        from_micros("__end").alias("end_time"),
        "duplicate_timestamps",
        "positives",
        "positive_rate",
        days.alias("coverage_days"),
        (days >= 30).alias("qualification_data"),
        ((F.col("rows") >= 100_000) & (F.col("positives") >= 500)).alias("neural_data_eligible"),
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def non_finite(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: null values and values that are not finite numbers, from one pass."""
    columns = list(columns or numeric_columns(df))
    row = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.count_if(F.col(c).isNull()).alias("nulls"),
                F.count_if(~is_finite(c)).alias("non_finite"),
            ).alias(f"c{i}")
            for i, c in enumerate(columns)
        ]
    )
    return row.select(F.explode(F.array(*[f"c{i}" for i in range(len(columns))])).alias("c")).select("c.*")


def daily_means(df: DataFrame, columns: Sequence[str], ts: str = "ts_us") -> DataFrame:
    """Mean of each column per UTC day (prevalence, when the column is the target)."""
    return df.groupBy(F.to_date(from_micros(ts)).alias("day")).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in columns]
    )


def inter_arrival(df: DataFrame, ts: str = "ts_us", order: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """Add `gap_us` to the previous row."""
    seen = scan.previous_row(
        _chunked(df, ts), keys, "__chunk", [ts, *[o for o in order if o != ts]], {"__before": F.col(ts)}
    )
    return seen.withColumn("gap_us", F.col(ts) - F.col("__before")).drop("__chunk")


def arrival_percentiles(
    df: DataFrame, ts: str = "ts_us", order: Sequence[str] = (), keys: Sequence[str] = (), approximate: bool = False
) -> DataFrame:
    """Median, p95 and p99 gap in milliseconds; 0 with fewer than two rows."""
    gaps = inter_arrival(df.select(*keys, *dict.fromkeys([ts, *order])), ts, order, keys)
    ms = gaps.where(F.col("gap_us").isNotNull()).select(*keys, (F.col("gap_us") / F.lit(1000.0)).alias("ms"))
    shares = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    if approximate:
        out = ms.groupBy(*keys).agg(*[F.percentile_approx("ms", p).alias(n) for n, p in shares.items()])
    else:
        out = scan.exact_quantiles(stage(ms), "ms", shares, keys)
    return out.withColumns({name: F.coalesce(name, F.lit(0.0)) for name in shares})


def gap_summary(
    df: DataFrame, ts: str = "ts_us", order: Sequence[str] = (), keys: Sequence[str] = (),
    threshold_seconds: float = GAP_SECONDS,
) -> DataFrame:
    """Gaps over the threshold, and the longest gap with its start (the first of equals)."""
    gaps = inter_arrival(df.select(*keys, *dict.fromkeys([ts, *order])), ts, order, keys)
    limit = int(threshold_seconds * MICROS)
    return gaps.groupBy(*keys).agg(
        F.count_if(F.col("gap_us") > limit).alias("count_over_threshold"),
        F.coalesce(F.max("gap_us") / F.lit(float(MICROS)), F.lit(0.0)).alias("longest_gap_seconds"),
        F.max_by(
            from_micros("__before"), F.when(F.col("gap_us").isNotNull(), F.struct(F.col("gap_us"), -F.col(ts)))
        ).alias("longest_gap_start"),
    )


def autocorrelation(
    df: DataFrame,
    columns: Sequence[str],
    ts: str = "ts_us",
    lags_seconds: Sequence[int] = LAG_SECONDS,
    bin_seconds: int = 1,
) -> DataFrame:
    """Pearson correlation of each column's binned mean with itself `lag` later.

    Bins without rows pair with nothing. Null when fewer than two pairs exist, a
    side is constant, or the series is not longer than the lag.
    """
    width = bin_seconds * MICROS
    binned = stage(
        df.groupBy(F.floor(F.col(ts) / F.lit(width)).alias("bin")).agg(
            *[F.avg(F.col(c).cast("double")).alias(c) for c in columns]
        )
    )
    steps = {lag: lag // bin_seconds for lag in lags_seconds}
    lagged = F.explode(
        F.array(*[F.struct(F.lit(lag).alias("lag_seconds"), F.lit(k).cast("bigint").alias("k")) for lag, k in steps.items()])
    )
    later = binned.withColumn("__lag", lagged).select(
        (F.col("bin") + F.col("__lag.k")).alias("bin"), F.col("__lag.lag_seconds").alias("lag_seconds"),
        *[F.col(c).alias(f"__{c}") for c in columns],
    )
    pairs = later.join(binned, "bin")
    row = []
    for c in columns:
        both = F.col(c).isNotNull() & F.col(f"__{c}").isNotNull()
        x, y = F.when(both, F.col(c)), F.when(both, F.col(f"__{c}"))
        varied = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
        row.append(F.when(varied, F.corr(x, y)).alias(c))
    return pairs.groupBy("lag_seconds").agg(*row)


def _gram(columns: Sequence[str], shift: Sequence[float]):
    """Per task the sums of every column pair, over rows where both are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - np.array(shift)
            known = np.stack([~np.asarray(c.is_null()) for c in batch.columns], axis=1).astype(float)
            x = np.where(known > 0, x, 0.0)
            parts = np.stack([known.T @ known, x.T @ known, known.T @ x, (x * x).T @ known, known.T @ (x * x), x.T @ x])
            total = parts if total is None else total + parts
        if total is not None:
            i, j = np.triu_indices(len(columns), 1)
            arrays = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *(pa.array(t[i, j]) for t in total)]
            yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "n", "x", "y", "xx", "yy", "xy"])

    return run


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, nulls dropped per pair; null where one of the two does not vary.

    One pass builds the blocked product of the columns with themselves, six sums a pair, by matrix products inside tasks; tasks
    send pairs, not rows. Columns are shifted near their mean first, so that nothing cancels.
    """
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    centre = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c))
    shift = numbers.agg(*[F.coalesce(centre(c), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    sums = numbers.mapInArrow(_gram(columns, list(shift)), "i int, j int, n double, x double, y double, xx double, yy double, xy double")
    pair = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")])
    n = F.col("n")
    vary = (n * F.col("xx") - F.col("x") * F.col("x")) * (n * F.col("yy") - F.col("y") * F.col("y"))
    name = lambda at: F.element_at(F.array(*[F.lit(c) for c in columns]), F.col(at) + 1)
    return pair.select(
        name("i").alias("a"), name("j").alias("b"),
        F.try_divide(n * F.col("xy") - F.col("x") * F.col("y"), F.sqrt(F.when(vary > 0, vary).when(F.isnan(vary), vary))).alias("r"),
    )


def high_correlations(pairs: DataFrame, limit: float = 0.85) -> DataFrame:
    return pairs.where(F.abs("r") > limit)


def percentile_table(
    df: DataFrame, value: str = "future_vol_60s", percents: Sequence[int] = (50, 75, 80, 85, 90, 95, 99),
    notional: float = 60_000,
) -> DataFrame:
    """Candidate label thresholds: value, share of rows above it, move at one deviation."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    wide = scan.exact_quantiles(known, value, {f"p{p}": p / 100 for p in percents})
    cuts = wide.select(
        F.array(*[F.struct(F.lit(p).alias("percentile"), F.col(f"p{p}").alias("threshold")) for p in percents]).alias("t")
    ).scalar()
    return threshold_sweep(known.withColumn("__t", cuts), value).withColumn(
        "move", F.col("threshold") * notional
    )


def threshold_sweep(df: DataFrame, value: str, thresholds: Mapping[int, float] | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Share of rows strictly above each candidate threshold, per `keys` (for example a split)."""
    if thresholds is not None:
        df = df.withColumn(
            "__t",
            F.array(*[F.struct(F.lit(p).alias("percentile"), F.lit(t).alias("threshold")) for p, t in thresholds.items()]),
        )
    return (
        df.select(*keys, value, F.explode("__t").alias("t"))
        .groupBy(*keys, F.col("t.percentile").alias("percentile"), F.col("t.threshold").alias("threshold"))
        .agg(F.avg((F.col(value) > F.col("t.threshold")).cast("double")).alias("spike_rate"))
    )


def class_counts(df: DataFrame, target: str, minimum: int = 10) -> DataFrame:
    """Rows per class and whether the class is too small to split."""
    return df.groupBy(target).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) < minimum).alias("undersized")
    )


def staleness(
    df: DataFrame, clock: str, event: str = "event_ts", write: str = "write_ts", limit_seconds: float = 60
) -> DataFrame:
    """Freshness of events and of writes against a reference clock column."""
    old = lambda c: (F.max(F.unix_micros(clock)) - F.max(F.unix_micros(c))) / F.lit(float(MICROS))
    ages = df.agg(old(event).alias("event_age_seconds"), old(write).alias("write_age_seconds"))
    fresh = F.coalesce(F.col("event_age_seconds") <= limit_seconds, F.lit(False))
    return ages.withColumns(
        {
            "fresh": fresh,
            "degraded": fresh & ~F.coalesce(F.col("write_age_seconds") <= limit_seconds, F.lit(False)),
        }
    )


def service_rollup(
    log: DataFrame, ts: str = "ts", window: str = "5 minutes", slide: str = "1 minute", keys: Sequence[str] = ("variant",),
    window_seconds: float = 300.0,
) -> DataFrame:
    """Request rate, error ratio, latency and lag of a request log over sliding windows.

    `log` has `latency_ms`, `ok` (boolean), `lag` and `zscore` columns. Latencies are the ceil(p * n)-th values: exact
    ones, from the distributed ladder of each window. A stream cannot be sorted, so there they come from a sketch of
    bounded size (exact up to 10 000 requests a window).
    """
    shares = {"latency_p50_ms": 0.5, "latency_p95_ms": 0.95}
    names = ["window_start", *keys, "request_rate", "error_ratio", *shares, "max_lag", "mean_abs_zscore"]
    plain = [
        (F.count(F.lit(1)) / F.lit(window_seconds)).alias("request_rate"),
        (
            F.count_if(~F.col("ok")) / F.greatest(F.count(F.lit(1)).cast("double"), F.lit(0.001))
        ).alias("error_ratio"),
        F.max("lag").alias("max_lag"),
        F.avg(F.abs("zscore")).alias("mean_abs_zscore"),
    ]
    if log.isStreaming:
        sketches = [F.percentile_approx("latency_ms", share).alias(name) for name, share in shares.items()]
        out = log.groupBy(F.window(ts, window, slide).alias("w"), *keys).agg(*plain, *sketches)
        return out.withColumn("window_start", F.col("w.start")).select(*names)
    placed = log.withColumn("window_start", F.window(ts, window, slide)["start"])
    unit = ["window_start", *keys]
    exact = scan.exact_quantiles(placed.select(*unit, "latency_ms"), "latency_ms", shares, unit, nearest_rank=True)
    # exact_quantiles works on doubles
    exact = exact.withColumns({name: F.col(name).cast(log.schema["latency_ms"].dataType) for name in shares})
    return scan.join_null_safe(placed.groupBy(*unit).agg(*plain), exact, unit).select(*names)


def slo_status(
    rollup: DataFrame, p95_ms: float = 800, p50_ms: float = 100, success: float = 0.99, lag: float = 200
) -> DataFrame:
    """Add whether each window meets the service objectives."""
    return rollup.withColumn(
        "slo_met",
        (F.col("latency_p95_ms") <= p95_ms)
        & (F.col("latency_p50_ms") <= p50_ms)
        & (1 - F.col("error_ratio") >= success)
        & (F.col("max_lag") <= lag),
    )
