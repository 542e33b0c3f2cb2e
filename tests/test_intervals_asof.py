import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.operators import asof, intervals as iv

S = 1_000_000


def frame(spark, rows):
    return spark.createDataFrame([(k, s * S, e * S) for k, s, e in rows], "k string, start bigint, end bigint")


def rand_intervals(rng, n, keys="ab", top=400, most=15):
    return [(rng.choice(keys), s := rng.randint(0, top), s + rng.randint(1, most)) for _ in range(n)]


def seconds(rows, key):
    return {t for k, s, e in rows if k == key for t in range(s, e)}


def back(df):
    return sorted((r["k"], r["start"] // S, r["end"] // S) for r in df.collect())


def runs(key, points):
    out, start, prev = [], None, None
    for t in sorted(points):
        if start is None or t != prev + 1:
            if start is not None:
                out.append((key, start, prev + 1))
            start = t
        prev = t
    return out + ([(key, start, prev + 1)] if start is not None else [])


@pytest.mark.parametrize("chunk", [20 * S, 10**12])
def test_union_and_subtract(spark, chunk):
    rng = random.Random(3)
    base, cuts = rand_intervals(rng, 50), rand_intervals(rng, 20)
    union = back(iv.interval_union(frame(spark, base), ["k"], chunk_us=chunk))
    assert union == sorted(runs("a", seconds(base, "a")) + runs("b", seconds(base, "b")))
    left = back(iv.interval_subtract(frame(spark, base), frame(spark, cuts), ["k"], chunk_us=chunk))
    want = [r for k in "ab" for r in runs(k, seconds(base, k) - seconds(cuts, k))]
    assert left == sorted(want)


def test_overlap_inside_and_days(spark):
    rng = random.Random(4)
    rows, gaps = rand_intervals(rng, 60), rand_intervals(rng, 10)
    got = iv.flag_overlap(frame(spark, rows), frame(spark, gaps), ["k"], chunk_us=30 * S).collect()
    for r in got:
        want = any(g[0] == r["k"] and r["start"] < g[2] * S and g[1] * S < r["end"] for g in gaps)
        assert r["overlaps"] == want
    assert len(got) == 60
    got = iv.flag_inside(frame(spark, rows), frame(spark, gaps), ["k"], "start", chunk_us=30 * S).collect()
    for r in got:
        assert r["inside"] == any(g[0] == r["k"] and g[1] * S <= r["start"] < g[2] * S for g in gaps)
    day = iv.DAY_US
    df = spark.createDataFrame([(day - 5 * S, 2 * day)], "start bigint, end bigint")
    out = iv.split_by_day(df).orderBy("day").collect()
    assert [(str(r["day"]), (r["end"] - r["start"]) // S) for r in out] == [("1970-01-01", 5), ("1970-01-02", 86400)]


def test_islands_and_bands(spark):
    df = spark.createDataFrame([("a", t * S) for t in (1, 2, 3, 7, 8, 20)], "k string, ts_us bigint")
    got = sorted((r["start"] // S, r["end"] // S) for r in iv.continuity_islands(df, ["k"], chunk_us=2 * S).collect())
    assert got == [(1, 4), (7, 9), (20, 21)]
    flags = [True, True, False, None, True, False, True]
    df = spark.createDataFrame([(i * 10 * S, f) for i, f in enumerate(flags)], "ts_us bigint, on boolean")
    got = sorted((r["x1"] / S, r["x2"] / S) for r in iv.true_bands(df, "on", chunk_us=20 * S).collect())
    assert got == [(0, 10), (35, 45), (55, 65)]


def trades_frame(spark, rows, segments=True):
    schema = "product_id string, trade_id string, event_time timestamp, price double, size double, reported_side string"
    return spark.createDataFrame(rows, schema + (", segment_id bigint" if segments else ""))


def books_frame(spark, rows):
    return spark.createDataFrame(
        rows,
        "product_id string, observed_through timestamp, best_bid double, bid_size double, best_ask double, "
        "ask_size double, segment_id bigint",
    )


def test_asof_uses_last_fully_observed_second(spark):
    from datetime import datetime, timedelta

    t0 = datetime(2026, 4, 24)
    at = lambda s: t0 + timedelta(seconds=s)
    books = books_frame(
        spark,
        [("P", at(s), 100.0 + s, 1.0, 101.0 + s, 2.0, 0 if s < 10 else 1) for s in (0, 1, 2, 3, 10, 11)],
    )
    trades = trades_frame(
        spark,
        [("P", "t1", at(1.5), 1.0, 1.0, "buy", 0), ("P", "t2", at(2.0), 1.0, 1.0, "buy", 0),
         ("P", "t3", at(9.0), 1.0, 1.0, "buy", 0), ("P", "t4", at(10.5), 1.0, 1.0, "buy", 1),
         ("P", "t5", at(11.5), 1.0, 1.0, "buy", 1), ("P", "t6", at(0.5), 1.0, 1.0, "buy", 0)],
    )
    got = {r["trade_id"]: r["best_bid"] for r in asof.join_trades_to_books(trades, books, chunk_us=3 * S).collect()}
    # t4 trades in the second its segment's first book is still being observed
    assert got == {"t1": 100.0, "t2": 101.0, "t3": 103.0, "t5": 110.0}
    inferred = asof.join_trades_to_books(trades.drop("segment_id"), books).collect()
    assert {r["trade_id"]: r["segment_id"] for r in inferred} == {"t1": 0, "t2": 0, "t5": 1}
    with pytest.raises(ValueError, match="duplicate trade_id"):
        asof.join_trades_to_books(trades.unionByName(trades), books)
    clash = books.unionByName(books.withColumn("segment_id", F.lit(7).cast("bigint")))
    with pytest.raises(Exception, match="claim"):
        asof.infer_segments(trades.drop("segment_id"), clash).collect()


def test_scans_and_quantiles_match_plain_python(spark):
    rng = random.Random(9)
    rows = [(rng.choice("xy"), i, rng.randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("c", F.floor(F.col("i") / 17))
    totals = scan.running_totals(df, ["k"], "c", ["i"], {"t": F.col("v")})
    seen = scan.previous_row(totals, ["k"], "c", ["i"], {"p": F.col("v")})
    tops = scan.running_max(seen, ["k"], "c", ["i"], "m", F.col("v"))
    state = {}
    for r in sorted(tops.collect(), key=lambda r: r["i"]):
        before = state.get(r["k"], [])
        assert r["t"] == sum(before) + r["v"]
        assert r["p"] == (before[-1] if before else None)
        assert r["m"] == (max(before) if before else None)
        state[r["k"]] = before + [r["v"]]
    import numpy as np

    for share in (0.05, 0.5, 0.85, 0.99):
        got = {r["k"]: r["q"] for r in scan.exact_quantiles(df, "v", {"q": share}, ["k"], chunks=5).collect()}
        rank = {r["k"]: r["q"] for r in scan.exact_quantiles(df, "v", {"q": share}, ["k"], nearest_rank=True).collect()}
        for k in "xy":
            values = sorted(v for kk, _, v in rows if kk == k)
            assert abs(got[k] - np.quantile(values, share)) < 1e-9
            assert rank[k] == values[max(0, int(np.ceil(share * len(values))) - 1)]
