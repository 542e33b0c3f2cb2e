"""Causal rolling features and the delayed forward label, in linear time.

Shape of the job
----------------
* Rows are cut into time slices and copied into the neighbouring slices they can
  influence (`lookback` before, `horizon + retention` after), so a single hot
  product is spread over as many tasks as there are slices. One shuffle serves
  every window of every feature set.
* No sliding frame is used. Sliding frames are recomputed per row, which is
  quadratic in tick density. Each quantity is a running total instead, and a
  window's start is found with a frame that is unbounded on the left and ends
  just before the window (`UNBOUNDED PRECEDING .. w + 1us PRECEDING`): Spark
  advances such a frame once over the partition.
* Sliding extremes use fixed blocks of the window's own length: a window spans
  the tail of one block and the head of the next, so its maximum is that of a
  suffix maximum and a prefix maximum.

Arrival order is respected throughout: a tick never sees a later arrival, even
one with the same timestamp, while the forward window holds every tick of its
first instant and ends with the tick that completes the horizon.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.exprs import (
    book_imbalance,
    log_return,
    micros,
    midprice,
    ratio,
    spread_abs,
    spread_bps,
)
from tickloom.operators.identity import with_log_return
from tickloom.schemas import require_columns

RETENTION_SECONDS = 600.0
LABEL_SLACK_SECONDS = 2.0
HORIZON_SECONDS = 60
SPIKE_THRESHOLD = 4.8e-5
SLICE_SECONDS = 3600

BASE_COLUMNS = ("product_id", "ts_us", "arrival", "price", "best_bid", "best_ask")
DEPTH_COLUMNS = ("bid_size", "ask_size")


@dataclass(frozen=True)
class FeatureSet:
    """What a feature set computes; every duration is in seconds."""

    feature_set_id: str
    schema_version: str
    kind: str
    windows: tuple[int, ...]
    required_sources: tuple[str, ...]
    deployable: bool = True
    required_columns: tuple[str, ...] = BASE_COLUMNS
    options: dict = field(default_factory=dict)

    @property
    def max_lookback(self) -> int:
        return max(self.windows)

    @property
    def columns(self) -> tuple[str, ...]:
        """Model columns, in contract order."""
        return _COLUMNS[self.kind](self)


def _core_columns(spec: FeatureSet) -> tuple[str, ...]:
    (w,) = spec.windows
    return (
        "log_return", "spread_bps", f"vol_{w}s", f"mean_return_{w}s",
        f"trade_intensity_{w}s", f"n_ticks_{w}s", f"spread_mean_{w}s",
    )


def _multi_columns(spec: FeatureSet) -> tuple[str, ...]:
    names = (
        "return_{}s", "vol_{}s", "mean_return_{}s", "price_range_bps_{}s", "spread_mean_bps_{}s",
        "trade_intensity_{}s", "interarrival_mean_ms_{}s", "interarrival_std_ms_{}s",
    )
    return ("log_return", "spread_bps", *[n.format(w) for w in spec.windows for n in names])


def _micro_columns(spec: FeatureSet) -> tuple[str, ...]:
    o = spec.options
    accel = o["acceleration"]
    return (
        "log_return", "spread_bps",
        *[n.format(w) for w in spec.windows for n in ("return_{}s", "vol_{}s")],
        "book_imbalance", *[f"book_imbalance_mean_{w}s" for w in o["imbalance"]],
        *[f"spread_change_{w}s" for w in o["spread_change"]],
        *[f"intensity_change_{w}s" for w in o["intensity_change"]],
        "ewma_vol_fast", "ewma_vol_slow", f"vol_of_vol_{o['vol_of_vol']}s",
        *[f"momentum_{w}s" for w in o["momentum"]], f"acceleration_{accel}s",
    )


_COLUMNS = {"core": _core_columns, "multi_window": _multi_columns, "microstructure": _micro_columns}


def core_v1(window: int = 60) -> FeatureSet:
    return FeatureSet("core_v1", "1", "core", (window,), ("ticker",))


def multi_window_v1(windows: Sequence[int] = (5, 15, 30, 60, 120, 300)) -> FeatureSet:
    return FeatureSet("multi_window_v1", "2", "multi_window", tuple(windows), ("ticker",))


def microstructure_v1(
    windows: Sequence[int] = (5, 15, 30, 60, 120, 300),
    imbalance: Sequence[int] = (5, 15, 60),
    spread_change: Sequence[int] = (5, 60),
    intensity_change: Sequence[int] = (15, 60),
    momentum: Sequence[int] = (15, 60),
    vol_of_vol: int = 60,
    acceleration: int = 60,
    ewma_alphas: tuple[float, float] = (0.3, 0.1),
) -> FeatureSet:
    return FeatureSet(
        "microstructure_v1", "3", "microstructure", tuple(windows),
        ("ticker", "level2"),
        required_columns=BASE_COLUMNS + DEPTH_COLUMNS,
        options={
            "imbalance": tuple(imbalance), "spread_change": tuple(spread_change),
            "intensity_change": tuple(intensity_change), "momentum": tuple(momentum),
            "vol_of_vol": vol_of_vol, "acceleration": acceleration, "ewma": ewma_alphas,
        },
    )


#: Registry of the feature sets with their default windows.
FEATURE_SETS = {spec.feature_set_id: spec for spec in (core_v1(), multi_window_v1(), microstructure_v1())}


def feature_set(feature_set_id: str) -> FeatureSet:
    if feature_set_id not in FEATURE_SETS:
        raise ValueError(f"unknown feature set: {feature_set_id}")
    return FEATURE_SETS[feature_set_id]


# -- time slices --------------------------------------------------------------


def slice_rows(df: DataFrame, ts: str, width: int, before: int, after: int) -> DataFrame:
    """Copy each row into every time slice whose own rows may need it (all in microseconds).

    Slice k owns [k*width, (k+1)*width) and also receives the `before` preceding
    and the `after` following microseconds. `__slice` is the slice of the copy and
    `__own` marks the copy that is kept in the end.
    """
    home = F.floor(F.col(ts) / F.lit(width))
    first = F.floor((F.col(ts) - F.lit(after)) / F.lit(width))
    last = F.floor((F.col(ts) + F.lit(before)) / F.lit(width))
    return df.withColumn("__slice", F.explode(F.sequence(first, last))).withColumn(
        "__own", F.col("__slice") == home
    )


# -- window machinery ---------------------------------------------------------


class _Window:
    """Totals between a window's first tick and the current row."""

    def __init__(self, start: Column, w: int):
        self.w = w
        self.before = F.coalesce(start["rn"], F.lit(0))
        self.n = F.col("__rn") - self.before
        self.m = self.n - 1
        self.start = start

    def excluding_first(self, total: str) -> Column:
        return F.col(f"__{total}") - F.coalesce(self.start[f"{total}_first"], F.lit(0.0))

    def including_first(self, total: str) -> Column:
        return F.col(f"__{total}") - F.coalesce(self.start[total], F.lit(0.0))

    def first(self, name: str, whole: str) -> Column:
        """A column of the window's first tick (the slice's first tick if nothing precedes)."""
        return F.when(self.start.isNull(), F.col(whole)).otherwise(self.start[f"{name}_first"])


def population_std(
    total: Column, squares: Column, count: Column, changes: Column
) -> Column:
    """Population deviation from running totals; exactly 0 when all values are equal."""
    mean = F.try_divide(total, count)
    variance = F.greatest(F.try_divide(squares, count) - mean * mean, F.lit(0.0))
    return F.when((count > 1) & (changes > 0), F.sqrt(variance)).otherwise(F.lit(0.0))


def _order(keys: Sequence[str], arrival: str):
    part = Window.partitionBy(*keys, "__slice")
    forward = part.orderBy("ts_us", arrival)
    return {
        "forward": forward,
        "running": forward.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        "earlier": forward.rowsBetween(Window.unboundedPreceding, -1),
        "backward": part.orderBy(F.col("ts_us").desc(), F.col(arrival).desc()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        ),
        "by_time": part.orderBy("ts_us"),
    }


#: Scaled sums stay within exp(+-EWMA_RANGE), far inside double precision's range.
EWMA_RANGE = 230.0


def _ewma_block(alpha: float) -> int:
    """Rows whose scaled sum cannot overflow; after two blocks a return's weight is below exp(-EWMA_RANGE)."""
    beta = 1.0 - alpha
    return max(1, min(int(EWMA_RANGE / -math.log(beta)), 1 << 30)) if beta > 0 else 1


def _with_ewma(df: DataFrame, keys: Sequence[str], arrival: str, alphas: Sequence[float]) -> DataFrame:
    """Exponential averages of |return| since the start of the slice's copy, for any alpha in (0, 1].

    Within a block of rows the recurrence is a running sum of `|r| / beta^pos`; the blocks before are carried in. The
    block length follows alpha, so no power overflows and nothing that counts is cut off.
    """
    wins = _order(keys, arrival)
    out = df
    for i, alpha in enumerate(alphas):
        if not 0.0 < alpha <= 1.0:
            raise ValueError(f"alpha {alpha} is not in (0, 1]")
        size, beta = _ewma_block(alpha), 1.0 - alpha
        pos, ends = (F.col("__rn") - 1) % size, F.col("__rn") % size == 0
        in_block = (
            Window.partitionBy(*keys, "__slice", "__blk").orderBy("ts_us", arrival).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )

        def carried(name: str, ends=ends) -> Column:
            last = F.last(F.when(ends, F.col(name)), ignorenulls=True).over(wins["earlier"])
            return F.coalesce(last, F.lit(0.0))

        power = lambda n, beta=beta: F.pow(F.lit(beta), n) if beta > 0 else (n == 0).cast("double")
        scaled = F.sum(F.abs("__r") / power(pos)).over(in_block)
        out = out.withColumn("__blk", F.floor((F.col("__rn") - 1) / F.lit(size))).withColumn("__loc", F.lit(alpha) * power(pos) * scaled)
        out = out.withColumn("__pre", carried("__loc")).withColumn("__end", F.col("__loc") + F.lit(beta**size) * F.col("__pre"))
        out = out.withColumn(f"__ewma{i}", F.col("__loc") + power(pos + 1) * carried("__end")).drop("__blk", "__loc", "__pre", "__end")
    return out


def rolling_features(
    ticks: DataFrame,
    spec: FeatureSet,
    keys: Sequence[str] = ("product_id",),
    arrival: str = "arrival",
    label: bool = True,
    horizon_seconds: float = HORIZON_SECONDS,
    slack_seconds: float = LABEL_SLACK_SECONDS,
    threshold: float = SPIKE_THRESHOLD,
    retention_seconds: float | None = None,
    slice_seconds: float = SLICE_SECONDS,
    drain_tail: bool = False,
    labelled_only: bool = False,
    closed_by: bool = False,
) -> DataFrame:
    """Feature row per tick, and with `label` the realised volatility that follows it.

    `keys` delimit independent streams: product, plus epoch for a live capture, or
    segment and source date for history. Ticks must not go back in time within a
    stream (see `identity.with_epoch`). Needs `ts_us` and `arrival`; `log_return`
    is added from the preceding tick when it is not there yet. With `closed_by` the
    arrival of the tick that completed the label is added.
    """
    require_columns(ticks, spec.required_columns, f"feature set {spec.feature_set_id} unavailable")
    require_columns(ticks, keys, "feature stream keys")
    if "log_return" not in ticks.columns:
        ticks = with_log_return(ticks, keys, ("ts_us", arrival), micros(slice_seconds))
    horizon = micros(horizon_seconds)
    retention = micros(
        max(RETENTION_SECONDS, spec.max_lookback + horizon_seconds)
        if retention_seconds is None
        else retention_seconds
    )
    payload = ticks.columns
    micro = spec.kind == "microstructure"
    starts = _window_starts(spec)
    lookback = retention if (micro or label) else micros(max(starts, default=0))
    ahead = horizon + retention if label else 0
    after_slack = max(ahead, micros(slack_seconds) + retention) if label else 0

    if drain_tail and label:
        ends = ticks.groupBy(*keys).agg(F.max("ts_us").alias("__stream_end"))
        ticks = ticks.join(ends, list(keys), "left")

    rows = ticks.withColumns(
        {
            "midprice": midprice("best_bid", "best_ask"),
            "spread_abs": spread_abs("best_bid", "best_ask"),
            "spread_bps": spread_bps("best_bid", "best_ask"),
            **({"book_imbalance": book_imbalance("bid_size", "ask_size")} if micro else {}),
        }
    )
    rows = slice_rows(rows, "ts_us", micros(slice_seconds), lookback, after_slack)
    wins = _order(keys, arrival)
    extremes = spec.windows if spec.kind != "microstructure" else ()

    if extremes:  # suffix extremes of every block, scanned from the end
        rows = rows.withColumns(
            {
                name: expr.over(wins["backward"])
                for w in extremes
                for name, expr in (
                    (f"__smax{w}", F.max(F.struct((-_block(w)).alias("b"), F.col("price").alias("v")))),
                    (f"__smin{w}", F.max(F.struct((-_block(w)).alias("b"), (-F.col("price")).alias("v")))),
                )
            }
        )

    # position, and the return to the preceding tick of the same slice
    rows = rows.withColumns(
        {
            "__rn": F.row_number().over(wins["forward"]).cast("bigint"),
            "__gap": F.col("ts_us") - F.lag("ts_us").over(wins["forward"]),
        }
    )
    linked = F.col("__gap").isNotNull() & (F.col("__gap") <= retention)
    rows = rows.withColumn("__r", F.when(linked, F.col("log_return")).otherwise(F.lit(0.0)))
    if micro:
        rows = _with_ewma(rows, keys, arrival, spec.options["ewma"])
    rows = rows.withColumn(
        "__d",
        F.when(
            (F.col("__rn") > 2) & (F.col("__r") != F.lag("__r").over(wins["forward"])), F.lit(1)
        ).otherwise(F.lit(0)),
    )

    # running totals; `*_next` belong to the following tick, which opens a window
    # whose last excluded tick is this one
    totals = {"s1": F.col("__r"), "s2": F.col("__r") * F.col("__r"), "d": F.col("__d")}
    if spec.kind == "core":
        totals["sp"] = F.col("spread_abs")
    if spec.kind == "multi_window":
        gap_ms = F.when(
            F.col("__gap") <= micros(spec.max_lookback), F.col("__gap") / F.lit(1000.0)
        ).otherwise(F.lit(0.0))
        totals |= {"sp": F.col("spread_bps"), "g2": gap_ms * gap_ms}
        # equal gaps must give a deviation of exactly 0
        rows = rows.withColumn(
            "__gd",
            F.when(
                (F.col("__rn") > 2) & (F.col("__gap") != F.lag("__gap").over(wins["forward"])), F.lit(1)
            ).otherwise(F.lit(0)),
        )
        totals["gd"] = F.col("__gd")
    if micro:
        totals["im"] = F.col("book_imbalance")
    lead = lambda name, by=1: F.lead(name, by).over(wins["forward"])
    added = {f"__{name}": F.sum(value).over(wins["running"]) for name, value in totals.items()}
    # a total never replaces a column the other totals still read
    added["__dsum"] = added.pop("__d")
    nxt = {
        "__r_next": lead("__r"), "__d_next": lead("__d"), "__d_next2": lead("__d", 2),
        "__ts_next": lead("ts_us"), "__price_next": lead("price"),
        "__price_top": F.first("price").over(wins["running"]),
        "__ts_top": F.first("ts_us").over(wins["running"]),
    }
    if spec.kind == "multi_window":
        added["__gdsum"] = added.pop("__gd")
        nxt |= {"__gap_next": lead("__gap"), "__gd_next": lead("__gd"), "__gd_next2": lead("__gd", 2)}
    if micro:
        nxt |= {
            "__spread_next": lead("spread_bps"), "__spread_top": F.first("spread_bps").over(wins["running"]),
            **{f"__ewma{i}_next": lead(f"__ewma{i}") for i in range(2)},
        }
    for w in extremes:
        for side in ("smax", "smin"):
            nxt[f"__{side}{w}_next"] = lead(f"__{side}{w}")
            nxt[f"__{side}{w}_top"] = F.first(f"__{side}{w}").over(wins["running"])
        added[f"__pmax{w}"] = F.max(
            F.struct(_block(w).alias("b"), F.col("price").alias("v"))
        ).over(wins["running"])["v"]
        added[f"__pmin{w}"] = -F.max(
            F.struct(_block(w).alias("b"), (-F.col("price")).alias("v"))
        ).over(wins["running"])["v"]
    rows = rows.withColumns({**added, **nxt})
    zero = F.lit(0.0)
    rows = rows.withColumn(
        "__mark",
        F.struct(
            F.col("__rn").alias("rn"),
            F.col("__ts_next").alias("ts_first"),
            F.col("__price_next").alias("price_first"),
            F.col("__s1").alias("s1"),
            F.col("__s2").alias("s2"),
            (F.col("__s1") + F.coalesce("__r_next", zero)).alias("s1_first"),
            (F.col("__s2") + F.coalesce(F.col("__r_next") * F.col("__r_next"), zero)).alias("s2_first"),
            (F.col("__dsum") + F.coalesce("__d_next", F.lit(0))).alias("d1"),
            (F.col("__dsum") + F.coalesce("__d_next", F.lit(0)) + F.coalesce("__d_next2", F.lit(0))).alias(
                "d_first"
            ),
            *[F.col(f"__{name}").alias(name) for name in ("sp", "im") if name in totals],
            *(
                [
                    (F.col("__g2") + F.coalesce(_gap_square(spec, "__gap_next"), zero)).alias("g2_first"),
                    (
                        F.col("__gdsum")
                        + F.coalesce("__gd_next", F.lit(0))
                        + F.coalesce("__gd_next2", F.lit(0))
                    ).alias("gd_first"),
                ]
                if spec.kind == "multi_window"
                else []
            ),
            *(
                [
                    F.col("__spread_next").alias("spread_first"),
                    *[F.col(f"__ewma{i}_next").alias(f"ewma{i}_first") for i in range(2)],
                ]
                if micro
                else []
            ),
            *[
                F.col(f"__{side}{w}_next").alias(f"{side}{w}")
                for w in extremes
                for side in ("smax", "smin")
            ],
        ),
    )

    lookups = {f"__w{w}": _start_of(wins, micros(w)) for w in starts}
    if micro or label:
        lookups["__kept"] = _start_of(wins, retention)
    if label:
        lookups["__peers"] = _start_of(wins, 0)
    rows = rows.withColumns(lookups)
    window = {w: _Window(F.col(f"__w{w}"), w) for w in starts}

    if label:
        rows = _with_label(rows, wins, horizon, micros(slack_seconds), drain_tail, arrival)
    features = {
        "core": _core_features, "multi_window": _multi_features, "microstructure": _micro_features
    }[spec.kind](spec, window)
    derived = ["midprice", "spread_abs", "spread_bps", *(["book_imbalance"] if micro else [])]
    kept = rows.where(F.col("__own"))
    if labelled_only:
        kept = kept.where(F.col("__future_vol").isNotNull())
    label_columns = []
    if label:
        name = f"future_vol_{_seconds_name(horizon_seconds)}s"
        label_columns = [
            F.col("__future_vol").alias(name),
            (F.col("__future_vol") > F.lit(threshold)).cast("int").alias("vol_spike"),
        ]
        if closed_by:
            label_columns.append(F.col("__last.closer.here.arrival").alias("closed_by"))
    return kept.select(
        *payload,
        *derived,
        *[expr.alias(name) for name, expr in features.items()],
        F.lit(spec.feature_set_id).alias("feature_set_id"),
        F.lit(spec.schema_version).alias("feature_schema_version"),
        *label_columns,
    )


def _seconds_name(seconds: float) -> str:
    return str(int(seconds)) if float(seconds).is_integer() else str(seconds)


def _block(w: int) -> Column:
    return F.floor(F.col("ts_us") / F.lit(micros(w)))


def _gap_square(spec: FeatureSet, name: str) -> Column:
    ms = F.when(F.col(name) <= micros(spec.max_lookback), F.col(name) / F.lit(1000.0)).otherwise(F.lit(0.0))
    return ms * ms


def _start_of(wins, w: int) -> Column:
    """The last tick before the window that reaches `w` microseconds back (0: before this instant)."""
    outside = wins["by_time"].rangeBetween(Window.unboundedPreceding, -(w + 1))
    return F.max_by("__mark", "__rn").over(outside)


def _window_starts(spec: FeatureSet) -> list[int]:
    """Window lengths whose start has to be located."""
    wanted = set(spec.windows)
    if spec.kind == "microstructure":
        o = spec.options
        wanted |= {*o["imbalance"], *o["spread_change"], *o["momentum"], o["vol_of_vol"]}
        for w in o["intensity_change"]:
            wanted |= {w, 2 * w}
        wanted |= {o["acceleration"] * k for k in (1, 2, 3)}
    return sorted(wanted)


def _rolling_vol(win: _Window) -> Column:
    changes = F.col("__dsum") - F.coalesce(win.start["d_first"], F.lit(0))
    return population_std(win.excluding_first("s1"), win.excluding_first("s2"), win.m, changes)


def _price_range(win: _Window, w: int) -> Column:
    """Highest minus lowest price of the window."""
    previous_block = -(_block(w) - 1)  # suffix marks carry the negated block number

    def extreme(suffix: str, prefix: str, pick, sign: int) -> Column:
        # the slice's own first tick opens the window when nothing precedes it
        mark = F.when(win.start.isNull(), F.col(f"__{suffix}_top")).otherwise(win.start[suffix])
        return F.when(
            mark["b"] == previous_block, pick(F.lit(sign) * mark["v"], F.col(prefix))
        ).otherwise(F.col(prefix))

    high = extreme(f"smax{w}", f"__pmax{w}", F.greatest, 1)
    low = extreme(f"smin{w}", f"__pmin{w}", F.least, -1)
    return high - low


def _core_features(spec: FeatureSet, window: dict[int, _Window]) -> dict[str, Column]:
    (w,) = spec.windows
    win = window[w]
    return {
        f"vol_{w}s": _rolling_vol(win),
        f"mean_return_{w}s": ratio(win.excluding_first("s1"), win.m),
        f"n_ticks_{w}s": win.n,
        f"trade_intensity_{w}s": win.n / F.lit(float(w)),
        f"spread_mean_{w}s": ratio(win.including_first("sp"), win.n),
        f"price_range_{w}s": _price_range(win, w),
    }


def _multi_features(spec: FeatureSet, window: dict[int, _Window]) -> dict[str, Column]:
    out: dict[str, Column] = {}
    for w in spec.windows:
        win = window[w]
        elapsed_ms = (F.col("ts_us") - win.first("ts", "__ts_top")) / F.lit(1000.0)
        gap_changes = F.col("__gdsum") - F.coalesce(win.start["gd_first"], F.lit(0))
        out |= {
            f"return_{w}s": log_return(F.col("price"), win.first("price", "__price_top")),
            f"vol_{w}s": _rolling_vol(win),
            f"mean_return_{w}s": ratio(win.excluding_first("s1"), win.m),
            f"price_range_bps_{w}s": ratio(_price_range(win, w) * 10_000.0, F.col("price")),
            f"spread_mean_bps_{w}s": ratio(win.including_first("sp"), win.n),
            f"trade_intensity_{w}s": win.n / F.lit(float(w)),
            f"interarrival_mean_ms_{w}s": ratio(elapsed_ms, win.m),
            f"interarrival_std_ms_{w}s": population_std(
                elapsed_ms, win.excluding_first("g2"), win.m, gap_changes
            ),
        }
    return out


def _micro_features(spec: FeatureSet, window: dict[int, _Window]) -> dict[str, Column]:
    o = spec.options
    out: dict[str, Column] = {}

    def window_return(w: int) -> Column:
        return log_return(F.col("price"), window[w].first("price", "__price_top"))

    for w in spec.windows:
        out[f"return_{w}s"] = window_return(w)
        out[f"vol_{w}s"] = _rolling_vol(window[w])
    for w in o["imbalance"]:
        out[f"book_imbalance_mean_{w}s"] = ratio(window[w].including_first("im"), window[w].n)
    for w in o["spread_change"]:
        first = window[w].first("spread", "__spread_top")
        out[f"spread_change_{w}s"] = F.when(window[w].n > 1, F.col("spread_bps") - first).otherwise(0.0)
    for w in o["intensity_change"]:
        prior = window[2 * w].n - window[w].n
        out[f"intensity_change_{w}s"] = window[w].n / F.lit(float(w)) - prior / F.lit(float(w))
    kept = _Window(F.col("__kept"), 0)
    for i, (name, alpha) in enumerate(zip(("ewma_vol_fast", "ewma_vol_slow"), o["ewma"])):
        older = F.pow(F.lit(1.0 - alpha), kept.m) * F.coalesce(kept.start[f"ewma{i}_first"], F.lit(0.0))
        # a buffer that holds one tick has no return at all
        out[name] = F.when(kept.m < 1, F.lit(0.0)).otherwise(F.greatest(F.col(f"__ewma{i}") - older, F.lit(0.0)))
    # its own first return counts here, unless that tick opens the retained buffer
    w = o["vol_of_vol"]
    win = window[w]
    opens_buffer = win.before == kept.before
    count = F.when(opens_buffer, win.m).otherwise(win.n)
    total = F.when(opens_buffer, win.excluding_first("s1")).otherwise(win.including_first("s1"))
    squares = F.when(opens_buffer, win.excluding_first("s2")).otherwise(win.including_first("s2"))
    changes = F.col("__dsum") - F.coalesce(
        F.when(opens_buffer, win.start["d_first"]).otherwise(win.start["d1"]), F.lit(0)
    )
    out[f"vol_of_vol_{w}s"] = population_std(total, squares, count, changes)
    for w in o["momentum"]:
        out[f"momentum_{w}s"] = window_return(w)
    a = o["acceleration"]
    middle = window[2 * a].first("price", "__price_top")
    oldest = window[3 * a].first("price", "__price_top")
    out[f"acceleration_{a}s"] = window_return(a) - log_return(middle, oldest)
    return out


def _with_label(
    rows: DataFrame, wins, horizon: int, slack: int, drain_tail: bool, arrival: str
) -> DataFrame:
    """Add `__future_vol`: deviation of the returns over the horizon after each tick.

    The tick that completes the horizon closes the window. It has also pruned the
    buffer to the retention by then, so a late closer shortens the window from its
    start; the coverage rule is applied to what is left.
    """
    here = F.struct(
        F.col("__rn").alias("rn"), F.col("ts_us").alias("ts"), F.col("__s1").alias("s1"),
        F.col("__s2").alias("s2"), F.col("__dsum").alias("d"), F.col(arrival).alias("arrival"),
    )
    opening = lambda mark, ts: F.struct(
        (F.coalesce(mark["rn"], F.lit(0)) + 1).alias("rn"), ts.alias("ts"),
        F.coalesce(mark["s1_first"], F.lit(0.0)).alias("s1"),
        F.coalesce(mark["s2_first"], F.lit(0.0)).alias("s2"),
        F.coalesce(mark["d_first"], F.lit(0)).cast("bigint").alias("d"),
        F.col(arrival).alias("arrival"),
    )
    kept = F.col("__kept")
    kept_ts = F.when(kept.isNull(), F.col("__ts_top")).otherwise(kept["ts_first"])
    rows = rows.withColumns(
        {
            "__here": here,
            "__open": opening(F.col("__peers"), F.col("ts_us")),
            "__kept_open": opening(kept, kept_ts),
        }
    )
    following = F.lead(F.struct(F.col("__here").alias("here"), F.col("__kept_open").alias("kept"))).over(
        wins["forward"]
    )
    rows = rows.withColumn("__tail", F.struct(F.col("__here").alias("here"), following.alias("closer")))
    within = wins["by_time"].rangeBetween(Window.unboundedPreceding, horizon - 1)
    rows = rows.withColumn("__last", F.max_by("__tail", "__rn").over(within))
    closer = F.col("__last.closer")
    exact = closer["here"]["ts"] == F.col("ts_us") + horizon
    end = F.when(exact, closer["here"]).otherwise(F.col("__last.here"))
    pruned = closer["kept"]["rn"] > F.col("__open.rn")
    start = F.when(pruned, closer["kept"]).otherwise(F.col("__open"))
    closed = closer.isNotNull()
    if drain_tail:  # end of input also closes a window, once nothing can follow
        closed = closed | (F.col("__stream_end") < F.col("ts_us") + horizon)
    rows = rows.withColumns({"__s": start, "__e": end})
    returns = F.col("__e.rn") - F.col("__s.rn")
    covered = F.col("__e.ts") >= F.col("__s.ts") + (horizon - slack)
    vol = population_std(
        F.col("__e.s1") - F.col("__s.s1"),
        F.col("__e.s2") - F.col("__s.s2"),
        returns,
        F.col("__e.d") - F.col("__s.d"),
    )
    return rows.withColumn("__future_vol", F.when(closed & (returns >= 1) & covered, vol))
