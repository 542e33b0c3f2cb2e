"""Correlations of many columns from one product, against numpy per pair."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import profile


def test_five_hundred_columns_in_one_pass(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((400, 500))
    x[:, 1] = x[:, 0] * 2 + 1e9  # a large mean must not cancel
    x[:, 2] = 7.25  # does not vary
    held = x.astype(object)
    held[rng.random(x.shape) < 0.1] = None
    names = [f"c{i}" for i in range(500)]
    df = spark.createDataFrame([tuple(r) for r in held.tolist()], ", ".join(f"{n} double" for n in names)).repartition(3)
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlations(df, names).collect()}
    assert len(got) == 500 * 499 // 2
    known = pd.DataFrame(held, columns=names).astype(float)
    for a, b in [(0, 1), (3, 4), (10, 499), (1, 250), *rng.integers(3, 500, (40, 2)).tolist()]:
        if a < b:
            want = known[names[a]].corr(known[names[b]])
            assert abs(got[names[a], names[b]] - want) < 1e-6
    assert all(r is None for (a, b), r in got.items() if "c2" in (a, b))


def test_nothing_and_nulls(spark):
    df = spark.createDataFrame([], "a double, b double")
    assert profile.correlations(df, ["a", "b"]).collect() == []
    df = spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double")
    assert [r["r"] for r in profile.correlations(df, ["a", "b"]).collect()] == [None]


def test_rollup_latencies_are_exact_in_large_windows(spark):
    n, minute = 40_000, 60_000_000
    latency = F.pmod(F.col("id") * 7_919, F.lit(n)) + 0.25  # every rank once
    log = spark.range(n).select(
        F.when(F.col("id") % 4 == 0, None).otherwise(F.lit("a")).alias("variant"), F.timestamp_micros(F.col("id") % minute).alias("ts"),
        F.when(F.col("id") % 8 != 1, latency).alias("latency_ms"), F.lit(True).alias("ok"), F.lit(0).alias("lag"), F.lit(-1.0).alias("zscore"),
    )
    log = log.unionByName(log.limit(1).select(F.lit("none").alias("variant"), "ts", F.lit(None).cast("double").alias("latency_ms"), "ok", "lag", "zscore"))
    out = profile.service_rollup(log, window="2 minutes", slide="1 minute").collect()
    assert len(out) == 6
    for key, held in (("a", [i for i in range(n) if i % 4 and i % 8 != 1]), (None, range(0, n, 4))):
        values = sorted(i * 7_919 % n + 0.25 for i in held)
        for row in (r for r in out if r["variant"] == key):
            for name, share in (("latency_p50_ms", 0.5), ("latency_p95_ms", 0.95)):
                assert row[name] == values[-(-int(share * 100) * len(values) // 100) - 1]
            assert row["request_rate"] * 300 == sum(1 for i in range(n) if (i % 4 > 0) == (key == "a"))
    assert [(r["latency_p50_ms"], r["latency_p95_ms"], r["mean_abs_zscore"]) for r in out if r["variant"] == "none"] == [(None, None, 1.0)] * 2
