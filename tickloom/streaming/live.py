"""Live features and delayed outcomes with Spark's own keyed state.

One stateful operator per product (`transformWithStateInPandas`, RocksDB state): the position (epoch, next sequence number,
last time and price) never expires, the tail of ticks that windows and open labels can still reach does if a product stays
silent. State is versioned with the query's checkpoint, so a lost executor or driver continues from the last committed batch,
and missing state fails the query instead of starting again at epoch 0.

Results equal the batch operators' (`features.rolling_features`): a tick sees only arrivals up to its own, a label is emitted
when the tick that completes its horizon arrives, or, with `drain_idle_seconds`, by a timer once the product has been silent.

A product's ticks of one trigger are worked on in one task; `maxFilesPerTrigger` or `maxOffsetsPerTrigger` bounds them.
Backfills of busy products belong to `FeatureStream`, which cuts a product into time slices.

Ticks need `arrival`, increasing over a product's life. Ticks without a product, time or price are left out. A redelivered
tick takes no sequence number. Output: one frame with `kind` feature or outcome; `features` and `outcomes` split it.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tickloom.functions.exprs import micros
from tickloom.operators import features as ft

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

TICK = (
    "timestamp string, ts_us bigint, arrival bigint, price double, best_bid double, best_ask double, "
    "bid_size double, ask_size double, ingest_mode string"
)
TAIL = f"{TICK}, seq bigint"
POSITION = "stream_epoch bigint, next_seq bigint, ts_us bigint, price double, drained_seq bigint"
_NAMES = [field.split()[0] for field in TICK.split(", ")]
_NUMBERS = ("price", "best_bid", "best_ask", "bid_size", "ask_size")


def _returns(price: np.ndarray) -> np.ndarray:
    """ln(price / previous price), 0 after a price that is not positive, NaN for a fall to 0; the first one is 0."""
    out = np.zeros(len(price))
    with np.errstate(divide="ignore", invalid="ignore"):
        step = np.log(price[1:] / price[:-1])
    out[1:] = np.where(price[:-1] > 0, np.where(np.isfinite(step), step, np.nan), 0.0)
    return out


class _Spread:
    """Sums and population deviations of values[low:high] for arrays of bounds, undefined values left out."""

    def __init__(self, values: np.ndarray) -> None:
        known = ~np.isnan(values)
        held = np.where(known, values, 0.0)
        self.shift = float(held.sum() / max(known.sum(), 1))
        moved = np.where(known, held - self.shift, 0.0)
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        self.n, self.s, self.q = total(known), total(moved), total(moved * moved)
        self.change = total(np.append(False, values[1:] != values[:-1]))

    def sum(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        low = np.minimum(low, high)
        return self.s[high] - self.s[low] + (self.n[high] - self.n[low]) * self.shift

    def std(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """As the batch operators: the count is that of the rows; exactly 0 when all values are equal."""
        low = np.minimum(low, high)
        count = np.maximum(high - low, 1)
        s = self.s[high] - self.s[low] - (count - (self.n[high] - self.n[low])) * self.shift
        q = self.q[high] - self.q[low] + (count - (self.n[high] - self.n[low])) * self.shift**2
        equal = self.change[high] - self.change[np.minimum(low + 1, high)] == 0
        variance = np.maximum(q / count - (s / count) ** 2, 0.0)
        return np.where((high - low > 1) & ~equal, np.sqrt(variance), 0.0)


def _extreme(values: np.ndarray, low: np.ndarray, high: np.ndarray, pick) -> np.ndarray:
    """pick over values[low:high] by a table of powers of two."""
    levels = [values]
    while 2 ** len(levels) <= int((high - low).max(initial=1)):
        step = 2 ** (len(levels) - 1)
        levels.append(pick(levels[-1][:-step], levels[-1][step:]))
    out = np.empty(len(low))
    k = np.frexp((high - low).astype(float))[1] - 1
    for level in np.unique(k):
        at = k == level
        held = levels[level]
        out[at] = pick(held[low[at]], held[high[at] - 2**level])
    return out


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(b != 0, a / b, 0.0)


@dataclass
class Series:
    """One product's ticks of one epoch in arrival order, with the features of the rows from `first` on."""

    ticks: pd.DataFrame
    first: int
    spec: ft.FeatureSet
    retention: int

    def __post_init__(self) -> None:
        t = self.ticks
        self.ts = t["ts_us"].to_numpy(np.int64)
        self.price, bid, ask, bid_size, ask_size = (t[c].to_numpy(float) for c in _NUMBERS)
        self.r = t["log_return"].to_numpy(float)
        self.mid = (bid + ask) / 2
        self.spread = ask - bid
        self.bps = np.where(self.mid > 0, _ratio(self.spread, self.mid) * 1e4, 0.0)
        depth = bid_size + ask_size
        self.imbalance = np.where(depth > 0, _ratio(bid_size - ask_size, depth), 0.0)
        self.returns = _Spread(self.r)
        self.now = np.arange(self.first, len(t))
        self.end = self.now + 1

    def start(self, w: float) -> np.ndarray:
        return np.searchsorted(self.ts, self.ts[self.now] - micros(w), side="left")

    def _return_since(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        old, new = self.price[low], self.price[high]
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.log(new / old)
        return np.where(old > 0, np.where(np.isfinite(step), step, np.nan), 0.0)

    def features(self) -> dict[str, np.ndarray]:
        make = {"core": self._core, "multi_window": self._multi, "microstructure": self._micro}[self.spec.kind]
        shown = {"log_return": self.r, "midprice": self.mid, "spread_abs": self.spread, "spread_bps": self.bps}
        if self.spec.kind == "microstructure":
            shown["book_imbalance"] = self.imbalance
        return {name: values[self.now] for name, values in shown.items()} | make()

    def _range(self, low: np.ndarray) -> np.ndarray:
        return _extreme(self.price, low, self.end, np.maximum) - _extreme(self.price, low, self.end, np.minimum)

    def _core(self) -> dict[str, np.ndarray]:
        (w,) = self.spec.windows
        low = self.start(w)
        n = self.end - low
        return {
            f"vol_{w}s": self.returns.std(low + 1, self.end), f"mean_return_{w}s": _ratio(self.returns.sum(low + 1, self.end), n - 1),
            f"n_ticks_{w}s": n, f"trade_intensity_{w}s": n / w, f"spread_mean_{w}s": _Spread(self.spread).sum(low, self.end) / n,
            f"price_range_{w}s": self._range(low),
        }

    def _multi(self) -> dict[str, np.ndarray]:
        gap = np.append(0, np.diff(self.ts)) / 1000.0
        gaps, bps = _Spread(np.where(gap <= self.spec.max_lookback * 1000.0, gap, 0.0)), _Spread(self.bps)
        out = {}
        for w in self.spec.windows:
            low = self.start(w)
            n = self.end - low
            out |= {
                f"return_{w}s": self._return_since(low, self.now), f"vol_{w}s": self.returns.std(low + 1, self.end),
                f"mean_return_{w}s": _ratio(self.returns.sum(low + 1, self.end), n - 1),
                f"price_range_bps_{w}s": _ratio(self._range(low) * 1e4, self.price[self.now]),
                f"spread_mean_bps_{w}s": bps.sum(low, self.end) / n, f"trade_intensity_{w}s": n / w,
                f"interarrival_mean_ms_{w}s": _ratio((self.ts[self.now] - self.ts[low]) / 1000.0, n - 1),
                f"interarrival_std_ms_{w}s": gaps.std(low + 1, self.end),
            }
        return out

    def _micro(self) -> dict[str, np.ndarray]:
        o, out = self.spec.options, {}
        kept = np.searchsorted(self.ts, self.ts[self.now] - self.retention, side="left")
        for w in self.spec.windows:
            low = self.start(w)
            out[f"return_{w}s"], out[f"vol_{w}s"] = self._return_since(low, self.now), self.returns.std(low + 1, self.end)
        level = _Spread(self.imbalance)
        for w in o["imbalance"]:
            low = self.start(w)
            out[f"book_imbalance_mean_{w}s"] = level.sum(low, self.end) / (self.end - low)
        for w in o["spread_change"]:
            low = self.start(w)
            out[f"spread_change_{w}s"] = np.where(self.end - low > 1, self.bps[self.now] - self.bps[low], 0.0)
        for w in o["intensity_change"]:
            recent, both = self.end - self.start(w), self.end - self.start(2 * w)
            out[f"intensity_change_{w}s"] = recent / w - (both - recent) / w
        size = np.abs(np.where(np.isnan(self.r), 0.0, self.r))
        size[0] = 0.0
        for name, alpha in zip(("ewma_vol_fast", "ewma_vol_slow"), o["ewma"], strict=True):
            run = np.array(list(accumulate(size, lambda a, x, k=alpha: k * x + (1 - k) * a, initial=0.0))[1:])
            older = (1 - alpha) ** (self.now - kept) * run[kept]
            out[name] = np.where(self.now > kept, np.maximum(run[self.now] - older, 0.0), 0.0)
        w = o["vol_of_vol"]
        out[f"vol_of_vol_{w}s"] = self.returns.std(np.maximum(self.start(w), kept + 1), self.end)
        for w in o["momentum"]:
            out[f"momentum_{w}s"] = self._return_since(self.start(w), self.now)
        a = o["acceleration"]
        out[f"acceleration_{a}s"] = self._return_since(self.start(a), self.now) - self._return_since(self.start(3 * a), self.start(2 * a))
        return out

    def labels(self, horizon: int, slack: int, drain: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(rows, volatility) of the labels that the ticks from `first` on complete, or, with `drain`, the end of input."""
        n = len(self.ts)
        closer = np.searchsorted(self.ts, self.ts + horizon, side="left")
        rows = np.flatnonzero(closer == n) if drain else np.flatnonzero((closer >= self.first) & (closer < n))
        ended = np.minimum(closer[rows], n - 1)
        low = np.searchsorted(self.ts, self.ts[rows], side="left")
        if not drain:
            low = np.maximum(low, np.searchsorted(self.ts, self.ts[ended] - self.retention, side="left"))
        high = np.minimum(ended, np.searchsorted(self.ts, self.ts[rows] + horizon, side="right") - 1)
        good = (high > low) & (self.ts[high] >= self.ts[np.minimum(low, n - 1)] + horizon - slack)
        rows, low, high = rows[good], low[good], high[good]
        return rows, self.returns.std(low + 1, high + 1)


class LiveProcessor(StatefulProcessor):
    """Position and tail of one product; emits feature and outcome rows."""

    def __init__(self, job: LiveFeatures) -> None:
        self.job = job

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", POSITION)
        ttl = self.job.tail_ttl_seconds
        self.tail = handle.getListState("tail", TAIL, None if ttl is None else int(ttl * 1000))

    def _state(self) -> tuple[tuple, pd.DataFrame]:
        held = self.position.get() if self.position.exists() else (0, 0, None, None, 0)
        return held, pd.DataFrame(list(self.tail.get()) if self.tail.exists() else [], columns=[*_NAMES, "seq"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows), ignore_index=True)[_NAMES].sort_values("arrival", kind="stable", ignore_index=True)
        (epoch, seq, last_ts, last_price, drained), tail = self._state()
        ts = got["ts_us"].to_numpy(np.int64)
        back = ts < np.append(ts[0] if last_ts is None else last_ts, ts[:-1])
        out = []
        for step in np.split(np.arange(len(got)), np.flatnonzero(back)):
            if not len(step):
                continue
            if back[step[0]]:  # time went back: a new epoch, in which nothing of the old one counts
                epoch, seq, last_price, drained, tail = epoch + 1, 0, None, 0, tail.iloc[:0]
            same = ["ts_us", "price", "best_bid", "best_ask"]
            new = got.iloc[step].drop_duplicates(same)
            known = set(map(tuple, tail[same].itertuples(index=False, name=None)))
            new = new[[row not in known for row in new[same].itertuples(index=False, name=None)]]
            new = new.assign(seq=np.arange(seq, seq + len(new)))
            if len(new):
                seq += len(new)
                joined = pd.concat([tail, new], ignore_index=True) if len(tail) else new.reset_index(drop=True)
                price = joined["price"].to_numpy(float)
                r = _returns(price)
                if not len(tail) and last_price is not None:  # the tail expired, the last price did not
                    r[0] = _returns(np.array([last_price, price[0]]))[1]
                elif len(tail):
                    r[0] = 0.0  # never inside a window: windows of new rows reach less far than the tail
                series = Series(joined.assign(log_return=r), len(tail), self.job.spec, self.job.retention)
                out.append(self.job.feature_rows(key[0], epoch, series))
                out.append(self.job.outcome_rows(key[0], epoch, series, drained))
                last_price = float(price[-1])
                reach = series.ts[-1] - self.job.retention - micros(self.job.horizon_seconds)
                tail = joined[series.ts >= reach]
            last_ts = int(ts[step[-1]])
        self.position.update((epoch, seq, last_ts, last_price, drained))
        self.tail.put([tuple(None if v is None or v != v else v for v in row) for row in tail.itertuples(index=False, name=None)])
        if self.job.drain_idle_seconds is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int(time.time() * 1000 + self.job.drain_idle_seconds * 1000))
        yield from (part for part in out if len(part))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (epoch, seq, last_ts, last_price, drained), tail = self._state()
        if len(tail):
            series = Series(tail.assign(log_return=_returns(tail["price"].to_numpy(float))), len(tail), self.job.spec, self.job.retention)
            rows = self.job.outcome_rows(key[0], epoch, series, drained, drain=True)
            self.position.update((epoch, seq, last_ts, last_price, int(tail["seq"].iloc[-1]) + 1))
            if len(rows):
                yield rows

    def close(self) -> None:
        pass


@dataclass
class LiveFeatures:
    """Turns a stream of typed ticks into feature rows and outcome events."""

    boot_id: str
    spec: ft.FeatureSet
    horizon_seconds: float = ft.HORIZON_SECONDS
    slack_seconds: float = ft.LABEL_SLACK_SECONDS
    threshold: float = ft.SPIKE_THRESHOLD
    retention_seconds: float | None = None
    tail_ttl_seconds: float | None = None
    drain_idle_seconds: float | None = None

    @property
    def retention(self) -> int:
        wanted = max(ft.RETENTION_SECONDS, self.spec.max_lookback + self.horizon_seconds)
        return micros(wanted if self.retention_seconds is None else self.retention_seconds)

    @property
    def _label(self) -> str:
        return f"future_vol_{ft._seconds_name(self.horizon_seconds)}s"

    def _feature_names(self) -> list[str]:
        one = pd.DataFrame([(None, 0, 0, 1.0, 1.0, 1.0, 1.0, 1.0, None, 0, 0.0)], columns=[*_NAMES, "seq", "log_return"])
        return list(Series(one, 0, self.spec, self.retention).features())

    def schema(self) -> str:
        numbers = [f"`{n}` {'bigint' if n.startswith('n_ticks_') else 'double'}" for n in self._feature_names()]
        return ", ".join([
            "kind string, product_id string, stream_epoch bigint, stream_id string, feature_id string", TICK, *numbers,
            "feature_set_id string, feature_schema_version string", f"`{self._label}` double, vol_spike int, label_schema string",
        ])

    def _identity(self, kind: str, product: str, epoch: int, ticks: pd.DataFrame) -> pd.DataFrame:
        stream = f"{self.boot_id}:{epoch}"
        out = ticks[_NAMES].copy()
        out.insert(0, "feature_id", [f"{product}:{stream}:{s}" for s in ticks["seq"]])
        for name, value in (("stream_id", stream), ("stream_epoch", epoch), ("product_id", product), ("kind", kind)):
            out.insert(0, name, value)
        return out

    def _complete(self, out: pd.DataFrame) -> pd.DataFrame:
        fields = [field.strip().split() for field in self.schema().split(", ")]
        out = out.reindex(columns=[name.strip("`") for name, _ in fields])
        texts = [name for name, kind in fields if kind == "string"]
        return out.astype({name: object for name in texts})

    def feature_rows(self, product: str, epoch: int, series: Series) -> pd.DataFrame:
        out = self._identity("feature", product, epoch, series.ticks.iloc[series.first :]).reset_index(drop=True)
        made = pd.DataFrame(series.features())
        out = pd.concat([out, made], axis=1)
        out["feature_set_id"], out["feature_schema_version"] = self.spec.feature_set_id, self.spec.schema_version
        return self._complete(out)

    def outcome_rows(self, product: str, epoch: int, series: Series, drained: int, drain: bool = False) -> pd.DataFrame:
        rows, vol = series.labels(micros(self.horizon_seconds), micros(self.slack_seconds), drain)
        keep = series.ticks["seq"].to_numpy(np.int64)[rows] >= drained
        rows, vol = rows[keep], vol[keep]
        out = self._identity("outcome", product, epoch, series.ticks.iloc[rows])
        out[self._label], out["vol_spike"] = vol, (vol > self.threshold).astype(np.int32)
        out["label_schema"] = f"p85-{int(self.horizon_seconds)}s-{self.threshold}-v1"
        return self._complete(out)

    def transform(self, ticks: DataFrame) -> DataFrame:
        """The stream of feature and outcome rows; needs the RocksDB state store (see `start`)."""
        kinds = dict(field.split() for field in TICK.split(", "))
        missing = {name: F.lit(None).cast(kind) for name, kind in kinds.items() if name not in ticks.columns}
        usable = ticks.withColumns(missing).select("product_id", *[F.col(n).cast(k) for n, k in kinds.items()]).dropna(
            subset=["product_id", "ts_us", "arrival", "price"]
        )
        # the clock only where something expires: with it, a query has a batch to run even when no data has come
        clock = self.tail_ttl_seconds is not None or self.drain_idle_seconds is not None
        return usable.groupBy("product_id").transformWithStateInPandas(
            LiveProcessor(self), outputStructType=self.schema(), outputMode="Append", timeMode="ProcessingTime" if clock else "None"
        )

    def features(self, rows: DataFrame) -> DataFrame:
        return rows.where("kind = 'feature'").drop("kind", self._label, "vol_spike", "label_schema")

    def outcomes(self, rows: DataFrame) -> DataFrame:
        return rows.where("kind = 'outcome'").select(
            "feature_id", "stream_epoch", "product_id", F.col("timestamp").alias("feature_ts"), self._label, "vol_spike",
            "label_schema", "stream_id",
        )

    def start(self, ticks: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Write both kinds below `path`, each row once; the state store setting holds for this query only."""
        spark = ticks.sparkSession
        before = spark.conf.get(PROVIDER)
        spark.conf.set(PROVIDER, ROCKS)
        try:
            writer = self.transform(ticks).writeStream.format("parquet").partitionBy("kind").option("path", path)
            return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
        finally:
            spark.conf.set(PROVIDER, before)
