import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import drift, quality as ql, search as se, splits as sp
from tickloom.plans import models as ml

S = 1_000_000


def corpus(spark, n=400, seed=3):
    rng = random.Random(seed)
    t = 0
    rows = []
    for i in range(n):
        t += rng.choice((0, 1, 5))
        rows.append((i, t * S, int(rng.random() < 0.4)))
    return rows, spark.createDataFrame(rows, "i int, ts_us bigint, y int")


def test_purged_folds_match_positions(spark):
    rows, df = corpus(spark)
    members, plan = sp.make_temporal_splits(df, 4, 0.2, 20, "y", order=["i"])
    got = {}
    for r in members.collect():
        got.setdefault((r["fold"], r["role"]), set()).add(r["i"])
    n = len(rows)
    ts = np.array([r[1] for r in rows])
    dev = n - int(np.ceil(n * 0.2))
    first = max(int(np.searchsorted(ts, ts[0] + 40 * S)), dev // 5)
    size = (dev - first) // 4
    for k in range(4):
        a, b = first + k * size, dev if k == 3 else first + (k + 1) * size
        assert got[k, "validation"] == set(range(a, b))
        assert got[k, "train"] == {i for i in range(a) if ts[i] <= ts[a] - 20 * S}
    assert got[-1, "holdout"] == set(range(dev, n))
    with pytest.raises(ValueError, match="one class is missing"):
        sp.make_temporal_splits(df.withColumn("y", F.lit(0)), 4, 0.2, 20, "y", order=["i"])
    with pytest.raises(ValueError, match="holdout share"):
        sp.make_temporal_splits(df, 0, 0.2, 20, "y")


def test_gates_at_their_boundaries(spark):
    good = dict(coverage_days=30.0, quote_trade_coverage=True, folds_won=4, bootstrap_lower=1e-9, brier_ratio=1.05,
                event_f1_delta=0.0, final_pr_auc_delta=1e-9, p95_latency_ms=800.0, deployable=True, parity_passed=True)
    bad = dict(coverage_days=29.9, quote_trade_coverage=False, folds_won=3, bootstrap_lower=0.0, brier_ratio=1.06,
               event_f1_delta=-0.1, final_pr_auc_delta=0.0, p95_latency_ms=801.0, deployable=False, parity_passed=False)
    rows = se.qualify(spark.createDataFrame([good, bad])).orderBy(F.col("passed").desc()).collect()
    assert rows[0]["passed"] and rows[0]["reasons"] == []
    assert rows[1]["reasons"] == [
        "coverage_under_thirty_days", "quote_trade_coverage_missing", "fewer_than_four_folds_won", "bootstrap_lower_not_positive",
        "brier_regression_over_five_percent", "event_f1_regressed", "final_pr_auc_not_improved", "p95_latency_over_800ms",
        "feature_set_not_deployable", "feature_parity_failed",
    ]


def test_leaderboard_and_plateau(spark):
    schema = "stage string, trial_id int, trial_order int, outcome string, aggregate_pr_auc double, development_brier_ratio double, development_folds_won double"
    rows = [("trees", i, i, "finished", 0.2 + (0.1 if i == 3 else 0), 1.0, 5.0) for i in range(12)]
    rows += [("trees", 90, 90, "finished", 0.9, 1.06, 5.0), ("trees", 91, 91, "finished", 0.9, 1.0, 3.0),
             ("baseline", 0, 0, "finished", 0.1, 9.0, 0.0), ("linear", 1, 1, "failed", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {r["stage"]: r["trial_id"] for r in se.leaderboard(df).collect()} == {"trees": 3, "baseline": 0}
    gates = {r["stage"]: r for r in se.stage_gates(df.where("trial_id < 50")).collect()}
    assert gates["trees"]["plateau"] and gates["linear"]["too_many_failures"]


def test_drift_of_equal_and_shifted_samples(spark):
    a = spark.createDataFrame([(float(i), i % 2) for i in range(200)], "x double, y int")
    b = a.withColumn("x", F.col("x") + 10)
    assert drift.wasserstein(a, a, ["x"]).first()["wasserstein"] == 0.0
    moved = drift.wasserstein(a, b, ["x"]).first()
    assert abs(moved["wasserstein"] - 10) < 1e-9
    assert abs(moved["drift_score"] - 10 / np.std(np.arange(200))) < 1e-9
    assert drift.jensen_shannon(a, a, "y").first()[0] == 0.0
    z = drift.feature_skew(b.withColumn("c", F.lit(3.0)), a.withColumn("c", F.lit(1.0)), ["c"], 2.0).first()
    assert z["mean_abs_z"] == 2.0 and z["skewed_rows"] == 200


def test_audit_passes_and_fails_closed(spark):
    day = "2026-04-24"
    span = lambda rows: spark.createDataFrame(rows, "a string, b string").select(
        F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    done = spark.createDataFrame([("P", day, 1776988800, 1777075200, True)],
                                 "product_id string, source_date string, day_start_epoch long, day_end_epoch long, trade_pages_complete boolean")
    books = span([(f"{day} 00:00:00", f"{day} 12:00:00"), (f"{day} 11:00:00", f"{day} 13:00:00")])
    report, days = ql.audit_dataset(spark, books, completions=done, minimum_seconds=46_800)
    r = report.first()
    assert (r["status"], r["qualified_seconds"], r["failures"]) == ("PASS", 46_800, [])
    report, _ = ql.audit_dataset(
        spark, books, incidents=span([(f"{day} 01:00:00", f"{day} 02:00:00"), (f"{day} 05:00:00", f"{day} 05:00:00")]),
        label_windows=span([(f"{day} 01:59:00", f"{day} 02:30:00")]), minimum_seconds=1)
    r = report.first()
    assert r["failures"] == ["label_window_crosses_excluded_interval", "malformed_interval_evidence",
                             "qualified_seconds_below_minimum", "trade_pages_complete"]


def test_calibrated_model_beats_noise(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i) * S, float(x), float(rng.normal()), int(x + rng.normal() * 0.5 > 0)) for i, x in enumerate(rng.normal(size=400))]
    rows[5] = (5 * S, float("inf"), None, 1)
    df = spark.createDataFrame(rows, "ts_us bigint, a double, b double, y int")
    scorer = ml.fit_candidate(df, ["a", "b"], "logistic", {"max_iter": 20}, label="y")
    scored = ml.score_ml(df, scorer)
    from tickloom.operators.metrics import ranking_metrics

    assert ranking_metrics(scored, label="y").first()["roc_auc"] > 0.85
    assert scored.where("score < 0 or score > 1").count() == 0
    with pytest.raises(ValueError, match="unknown model family"):
        ml.classifier("nope", {}, 1, 1, 1)
