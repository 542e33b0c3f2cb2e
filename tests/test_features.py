import math
import random

import pytest
from plain_engine import core, label, micro, multi

from tickloom.operators import features as ft
from tickloom.operators.identity import with_epoch

WINDOWS = (5, 15, 30, 60, 120, 300)


def make_ticks(seed, n, products=("A", "B"), gap_choices=(0, 0.25, 0.5, 1.0, 3.0, 20.0), jumps=True):
    rng = random.Random(seed)
    streams = {}
    rows = []
    clock = {p: 1_700_000_000.0 + rng.random() * 50 for p in products}
    price = {p: 100.0 for p in products}
    for arrival in range(n):
        p = rng.choice(products)
        gap = rng.choice(gap_choices)
        if jumps and rng.random() < 0.02:
            gap = rng.choice((59.0, 601.0, 650.0, 4000.0))
        clock[p] += gap
        if rng.random() < 0.7:
            price[p] = max(0.0, price[p] * math.exp(rng.gauss(0, 1e-3)))
        spread = rng.choice((0.01, 0.02, 0.05))
        shown = 0.0 if len(streams.get(p, ())) < 2 and seed % 2 else price[p]
        tick = {
            "ts": round(clock[p], 6), "price": shown, "bid": price[p] - spread, "ask": price[p] + spread,
            "bid_size": float(rng.randint(0, 4)), "ask_size": float(rng.randint(0, 4)),
        }
        streams.setdefault(p, []).append((arrival, tick))
        rows.append((p, int(round(tick["ts"] * 1e6)), arrival, shown, tick["bid"], tick["ask"],
                     tick["bid_size"], tick["ask_size"]))
    return streams, rows


COLUMNS = "product_id string, ts_us bigint, arrival bigint, price double, best_bid double, best_ask double, bid_size double, ask_size double"


def close(a, b, tol=1e-9):
    if a is None or b is None:
        return a is b
    return abs(a - b) <= tol * max(1.0, abs(b))


def compare(rows, streams, expected, names, tol=1e-9):
    got = {(r["product_id"], r["arrival"]): r for r in rows}
    assert len(got) == sum(len(s) for s in streams.values())
    for p, stream in streams.items():
        ticks = [t for _, t in stream]
        for i, (arrival, _) in enumerate(stream):
            row, want = got[p, arrival], expected(ticks, i)
            for name in names or want:
                assert close(row[name], want[name], tol), (p, i, name, row[name], want[name])


@pytest.mark.parametrize("slice_seconds", [300, 3600, 10**7])
def test_core_matches_brute_force_in_any_slicing(spark, slice_seconds):
    streams, rows = make_ticks(1, 500)
    df = spark.createDataFrame(rows, COLUMNS).repartition(3)
    for drain in (False, True):
        out = ft.rolling_features(df, ft.core_v1(), slice_seconds=slice_seconds, drain_tail=drain).collect()

        def expected(ticks, i):
            vol = label(ticks, i, 60, 2.0, 600, drain)
            return core(ticks, i, 60) | {"future_vol_60s": vol}

        compare(out, streams, expected, None)
        assert sum(r["future_vol_60s"] is not None for r in out) > 50
        for r in out:
            if r["future_vol_60s"] is not None and abs(r["future_vol_60s"] - 4.8e-5) > 1e-9:
                assert r["vol_spike"] == int(r["future_vol_60s"] > 4.8e-5)


def test_dense_ties_and_pruned_label_windows(spark):
    streams, rows = make_ticks(5, 600, ("A",), (0, 0, 0, 0.5, 1.0, 58.0, 60.0))
    df = spark.createDataFrame(rows, COLUMNS)
    out = ft.rolling_features(df, ft.core_v1(), slice_seconds=900, retention_seconds=600).collect()
    compare(out, streams, lambda t, i: core(t, i, 60) | {"future_vol_60s": label(t, i, 60, 2.0, 600, False)}, None)


def test_late_closer_prunes_the_window(spark):
    # horizon 60, a burst of ticks, then silence for a little more than the retention
    base = 1_700_000_000.0
    times = [0.0, 0.5, 1.0, 1.5, 30.0, 59.0, 60.5 - 0.6, 601.2, 602.0]
    ticks = [{"ts": base + t, "price": 100.0 + (i % 3), "bid": 99.0, "ask": 101.0, "bid_size": 1.0, "ask_size": 1.0}
             for i, t in enumerate(times)]
    rows = [("A", int(round(t["ts"] * 1e6)), i, t["price"], t["bid"], t["ask"], 1.0, 1.0) for i, t in enumerate(ticks)]
    df = spark.createDataFrame(rows, COLUMNS)
    for slice_seconds in (100, 3600):
        out = ft.rolling_features(df, ft.core_v1(), slice_seconds=slice_seconds).collect()
        compare(out, {"A": list(enumerate(ticks))},
                lambda t, i: {"future_vol_60s": label(t, i, 60, 2.0, 600, False)}, None)


@pytest.mark.parametrize("slice_seconds", [600, 10**7])
def test_multi_window_matches_brute_force(spark, slice_seconds):
    streams, rows = make_ticks(2, 400)
    df = spark.createDataFrame(rows, COLUMNS)
    out = ft.rolling_features(df, ft.multi_window_v1(), slice_seconds=slice_seconds, label=False).collect()
    compare(out, streams, lambda t, i: multi(t, i, WINDOWS), None, 1e-7)


@pytest.mark.parametrize("slice_seconds", [600, 10**7])
def test_microstructure_matches_brute_force(spark, slice_seconds):
    streams, rows = make_ticks(3, 700)
    df = spark.createDataFrame(rows, COLUMNS)
    out = ft.rolling_features(df, ft.microstructure_v1(), slice_seconds=slice_seconds, label=False).collect()
    compare(out, streams, lambda t, i: micro(t, i, WINDOWS, 600), None, 1e-8)


def test_long_dense_buffer_crosses_average_blocks(spark):
    streams, rows = make_ticks(4, 1200, ("A",), (0.05, 0.1, 0.3), jumps=False)
    df = spark.createDataFrame(rows, COLUMNS)
    out = ft.rolling_features(df, ft.microstructure_v1(), label=False).collect()
    compare(out, streams, lambda t, i: micro(t, i, WINDOWS, 600) if i % 37 == 0 else {}, None, 1e-9)


@pytest.mark.parametrize("alphas", [(0.99, 0.001), (0.95, 0.01), (1.0, 0.5)])
def test_averages_are_exact_for_any_alpha(spark, alphas):
    streams, rows = make_ticks(4, 1500, ("A",), (0.05, 0.1, 0.3), jumps=False)
    out = ft.rolling_features(spark.createDataFrame(rows, COLUMNS), ft.microstructure_v1(ewma_alphas=alphas), label=False)
    got = {r["arrival"]: r for r in out.select("arrival", "ewma_vol_fast", "ewma_vol_slow").collect()}
    ticks = [t for _, t in streams["A"]]
    for i in range(0, len(ticks), 53):
        kept = [t for t in ticks[: i + 1] if t["ts"] >= ticks[i]["ts"] - 600]
        for name, alpha in zip(("ewma_vol_fast", "ewma_vol_slow"), alphas):
            level = 0.0
            for a, b in zip(kept, kept[1:]):
                step = math.log(b["price"] / a["price"]) if a["price"] > 0 and b["price"] > 0 else 0.0
                level = alpha * abs(step) + (1 - alpha) * level
            assert close(got[i][name], level, 1e-10), (i, name, got[i][name], level)


def test_features_do_not_see_the_future(spark):
    _, rows = make_ticks(6, 200, ("A",))
    changed = rows[:120] + [(*r[:3], r[3] * 2 + 1, *r[4:]) for r in rows[120:]]
    spec = ft.multi_window_v1()
    first = {r["arrival"]: r for r in ft.rolling_features(spark.createDataFrame(rows, COLUMNS), spec, label=False).collect()}
    second = {r["arrival"]: r for r in ft.rolling_features(spark.createDataFrame(changed, COLUMNS), spec, label=False).collect()}
    for arrival in range(120):
        for name in spec.columns:
            assert first[arrival][name] == second[arrival][name]


def test_epochs_are_independent_streams(spark):
    streams, rows = make_ticks(7, 300, ("A",))
    again = [(p, ts - 500_000_000, arrival + 300, *rest) for p, ts, arrival, *rest in rows]
    df = with_epoch(spark.createDataFrame(rows + again, COLUMNS), chunk_rows=37)
    assert {r[0] for r in df.select("stream_epoch").distinct().collect()} == {0, 1}
    out = ft.rolling_features(df, ft.core_v1(), keys=("product_id", "stream_epoch")).collect()
    first = {r["arrival"]: r for r in out if r["stream_epoch"] == 0}
    for r in out:
        if r["stream_epoch"] == 1:
            twin = first[r["arrival"] - 300]
            assert close(r["vol_60s"], twin["vol_60s"], 1e-12) and r["n_ticks_60s"] == twin["n_ticks_60s"]


def test_registry_and_missing_columns(spark):
    assert ft.feature_set("core_v1").columns[:3] == ("log_return", "spread_bps", "vol_60s")
    assert len(ft.feature_set("multi_window_v1").columns) == 50
    assert len(ft.feature_set("microstructure_v1").columns) == 28
    with pytest.raises(ValueError, match="unknown feature set"):
        ft.feature_set("nope")
    df = spark.createDataFrame([("A", 1, 1, 1.0)], "product_id string, ts_us bigint, arrival bigint, price double")
    with pytest.raises(ValueError, match=r"\['best_ask', 'best_bid'\]"):
        ft.rolling_features(df, ft.core_v1())
