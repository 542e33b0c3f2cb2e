"""Trial selection, stage gates and candidate qualification on a trials table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import MICROS, is_finite, reasons
from tickloom.plans.lineage import stage

MAX_BRIER_RATIO = 1.05
MIN_FOLDS_WON = 4
FAILURE_SHARE = 0.20
PLATEAU = 0.001

# limits of the qualification gates
MIN_COVERAGE_DAYS = 30.0
MAX_P95_LATENCY_MS = 800

CONTRACT = ("dataset_id", "feature_set_id", "target_version", "validation_version", "git_sha")


def pending_trials(planned: DataFrame, completed: DataFrame, keys: Sequence[str] = ("stage", "trial_id")) -> DataFrame:
    return planned.join(completed.select(*keys).distinct(), list(keys), "left_anti")


def eligible(max_brier: float = MAX_BRIER_RATIO, min_folds: int = MIN_FOLDS_WON) -> Column:
    """Whether a finished trial may win its stage; the baseline stage is exempt."""
    calm = F.coalesce(F.col("development_brier_ratio") <= max_brier, F.lit(True))
    won = F.coalesce(F.col("development_folds_won") >= min_folds, F.lit(True))
    return (F.col("stage") == "baseline") | (calm & won)


def leaderboard(trials: DataFrame, order: str = "trial_order", **limits) -> DataFrame:
    """Best eligible trial of every stage; the first of equals wins."""
    candidates = trials.where(
        (F.col("outcome") == "finished") & F.col("aggregate_pr_auc").isNotNull() & eligible(**limits)
    )
    best = F.max_by(
        F.struct(*[c for c in trials.columns if c != "stage"]),
        F.struct(F.col("aggregate_pr_auc"), -F.col(order)),
    )
    return candidates.groupBy("stage").agg(best.alias("best")).select("stage", "best.*")


def stage_gates(trials: DataFrame, order: str = "trial_order", min_trials: int = 10) -> DataFrame:
    """Per stage: share of failures, whether it stops the stage, and whether scores have levelled off.

    The plateau compares the best score of the second half of the scored trials
    with that of the first half.
    """
    failed = trials.groupBy("stage").agg(
        F.count(F.lit(1)).alias("trials"),
        F.count_if(F.col("outcome") == "failed").alias("failures"),
    )
    scored = trials.where((F.col("outcome") == "finished") & F.col("aggregate_pr_auc").isNotNull())
    chunked = scored.withColumn("__chunk", F.floor(F.col(order) / F.lit(100_000)))
    sizes = scored.groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    placed = scan.row_index(chunked, ["stage"], "__chunk", [order], "i").join(sizes, "stage")
    early = F.col("i") < F.floor(F.col("n") / F.lit(2))
    halves = placed.groupBy("stage").agg(
        F.max("n").alias("scored"),
        F.max(F.when(early, F.col("aggregate_pr_auc"))).alias("earlier_best"),
        F.max(F.when(~early, F.col("aggregate_pr_auc"))).alias("later_best"),
    )
    joined = failed.join(halves, "stage", "left")
    levelled = (F.col("scored") >= min_trials) & (F.col("later_best") - F.col("earlier_best") <= PLATEAU)
    return joined.select(
        "stage", "trials", "failures",
        (F.col("failures") / F.col("trials") > FAILURE_SHARE).alias("too_many_failures"),
        F.coalesce("scored", F.lit(0)).alias("scored"), "earlier_best", "later_best",
        F.coalesce(levelled, F.lit(False)).alias("plateau"),
    )


def neural_eligibility(
    gates: DataFrame, fold_positives: DataFrame, labelled_rows: int | Column, completed_stages: Sequence[str],
    min_rows: int = 100_000, min_positives: int = 100, min_trials: int = 10,
) -> DataFrame:
    """Reasons the neural stage may not start (empty: it may)."""
    trees = gates.where(F.col("stage") == "trees")
    fewest = fold_positives.agg(F.min("positives")).scalar()
    row = fold_positives.sparkSession.range(1).select(
        F.lit(labelled_rows).alias("rows") if isinstance(labelled_rows, int) else labelled_rows.alias("rows"),
        F.coalesce(fewest, F.lit(0)).alias("fewest"),
        F.coalesce(trees.agg(F.max("scored")).scalar(), F.lit(0)).alias("tree_trials"),
        F.coalesce(trees.agg(F.max("plateau")).scalar(), F.lit(False)).alias("plateau"),
    )
    missing = [s for s in ("trees", "ablation") if s not in completed_stages]
    return row.select(
        reasons(
            ("too_few_labelled_rows", F.col("rows") < min_rows),
            ("too_few_positives_in_a_fold", F.col("fewest") < min_positives),
            ("stages_incomplete", F.lit(bool(missing))),
            ("too_few_tree_trials", F.col("tree_trials") < min_trials),
            ("no_plateau", ~F.col("plateau")),
        ).alias("reasons")
    )


def contract_check(runs: DataFrame, fields: Sequence[str] = CONTRACT) -> DataFrame:
    """Per search: the contract fields on which its runs disagree."""
    spread = runs.groupBy("search_id").agg(
        *[F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("\u0000"))).alias(f) for f in fields]
    )
    return spread.select("search_id", reasons(*[(f, F.col(f) > 1) for f in fields]).alias("conflicts"))


def qualify(evidence: DataFrame) -> DataFrame:
    """Evidence rows with the failed gates in order, and whether all passed."""
    # a missing fact never passes a gate
    fails = lambda fact: ~F.coalesce(fact, F.lit(False))
    # fixed values: the codes, in reporting order
    failed = reasons(
        ("coverage_under_thirty_days", fails(F.col("coverage_days") >= MIN_COVERAGE_DAYS)),
        ("quote_trade_coverage_missing", fails(F.col("quote_trade_coverage"))),
        ("fewer_than_four_folds_won", fails(F.col("folds_won") >= MIN_FOLDS_WON)),
        ("bootstrap_lower_not_positive", fails(F.col("bootstrap_lower") > 0)),
        ("brier_regression_over_five_percent", fails(F.col("brier_ratio") <= MAX_BRIER_RATIO)),
        ("event_f1_regressed", fails(F.col("event_f1_delta") >= 0)),
        ("final_pr_auc_not_improved", fails(F.col("final_pr_auc_delta") > 0)),
        ("p95_latency_over_800ms", fails(F.col("p95_latency_ms") <= MAX_P95_LATENCY_MS)),
        ("feature_set_not_deployable", fails(F.col("deployable"))),
        ("feature_parity_failed", fails(F.col("parity_passed"))),
    )
    return evidence.withColumn("reasons", failed).withColumn("passed", F.size("reasons") == 0)


def coverage_evidence(df: DataFrame, columns: Sequence[str], ts: str = "ts_us") -> DataFrame:
    """Coverage in days and whether every quote and trade column is finite throughout."""
    present = all(c in df.columns for c in columns)
    finite = [F.count_if(~is_finite(c)) for c in columns] if present else []
    clean = F.lit(present)
    for count in finite:
        clean = clean & (count == 0)
    return df.agg(
        ((F.max(ts) - F.min(ts)) / F.lit(86_400.0 * MICROS)).alias("coverage_days"), clean.alias("quote_trade_coverage")
    )


def derive_evidence(
    holdout: DataFrame,
    corpus: DataFrame,
    folds_won: DataFrame,
    threshold: float,
    facts: Mapping[str, object],
    coverage_columns: Sequence[str] = ("spread_bps", "log_return"),
    block_minutes: int = 30,
    resamples: int = 2000,
    seed: int = 42,
) -> DataFrame:
    """Qualification evidence from a scored holdout.

    `holdout` has ts_us, label, candidate_score and baseline_score; `facts` brings
    what data cannot show (p95_latency_ms, deployable, parity_passed).
    """
    from tickloom.operators import metrics

    one = lambda df, name: df.select(name).scalar()
    # one-row tables; written, so that their own scalar subqueries do not nest
    candidate = stage(metrics.metric_bundle(holdout, threshold, "candidate_score"))
    baseline = stage(metrics.metric_bundle(holdout, threshold, "baseline_score"))
    interval = stage(
        metrics.paired_block_bootstrap(holdout, block_minutes=block_minutes, resamples=resamples, seed=seed)
    )
    row = coverage_evidence(corpus, coverage_columns).withColumns(
        {
            "folds_won": one(folds_won, "folds_won"),
            "bootstrap_lower": one(interval, "lower"),
            "brier_ratio": F.coalesce(
                F.try_divide(one(candidate, "brier"), one(baseline, "brier")), F.lit(float("inf"))
            ),
            "event_f1_delta": one(candidate, "event_f1") - one(baseline, "event_f1"),
            "final_pr_auc_delta": one(candidate, "pr_auc") - one(baseline, "pr_auc"),
        }
    )
    return row.withColumns({name: F.lit(value) for name, value in facts.items()})

