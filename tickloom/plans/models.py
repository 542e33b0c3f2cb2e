"""Scoring and walk-forward training with Spark ML.

Imputation medians, scaling and calibration are fitted on training rows only.
Families without a Spark estimator map to the nearest one: extra trees to random
forest, histogram boosting to gradient-boosted trees. Numbers therefore agree in
kind, not digit by digit, with other libraries.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.exprs import is_finite
from tickloom.operators import metrics, splits
from tickloom.plans.lineage import stage

FAMILIES = (
    "logistic", "sgd_logistic", "random_forest", "extra_trees", "hist_gradient_boosting", "neural",
    "soft_voting", "prevalence",
)


def finite_or_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-finite numbers become null, so that the imputer sees them."""
    return df.withColumns({c: F.when(is_finite(c), F.col(c).cast("double")) for c in columns})


def classifier(family: str, params: Mapping[str, object], seed: int, n_features: int, n_rows: int):
    """Unfitted estimator of a family."""
    p = dict(params)
    common = {"featuresCol": "features", "labelCol": "label"}
    if family in ("logistic", "sgd_logistic"):
        strength = 1.0 / (float(p.get("C", 1.0)) * max(n_rows, 1)) if family == "logistic" else float(p.get("alpha", 1e-4))
        return LogisticRegression(maxIter=int(p.get("max_iter", 1000)), regParam=strength, **common)
    if family in ("random_forest", "extra_trees"):
        return RandomForestClassifier(
            numTrees=int(p.get("n_estimators", 300)), minInstancesPerNode=int(p.get("min_samples_leaf", 5)),
            maxDepth=int(p.get("max_depth", 30)), seed=seed, **common,
        )
    if family == "hist_gradient_boosting":
        return GBTClassifier(
            maxIter=int(p.get("max_iter", 300)), stepSize=float(p.get("learning_rate", 0.05)),
            maxDepth=int(p.get("max_depth", 5)), minInstancesPerNode=int(p.get("min_samples_leaf", 5)), seed=seed, **common,
        )
    if family == "neural":
        width = int(p.get("hidden_width", 64))
        return MultilayerPerceptronClassifier(
            layers=[n_features, width, 2], maxIter=int(p.get("max_iter", 300)), seed=seed, **common
        )
    raise ValueError(f"unknown model family {family!r}; expected one of {', '.join(FAMILIES)}")


def pipeline(columns: Sequence[str], family: str, params: Mapping[str, object], seed: int, n_rows: int) -> Pipeline:
    imputed = [f"{c}__imputed" for c in columns]
    return Pipeline(
        stages=[
            Imputer(strategy="median", inputCols=list(columns), outputCols=imputed, relativeError=0.001),
            VectorAssembler(inputCols=imputed, outputCol="raw_features"),
            StandardScaler(withMean=True, inputCol="raw_features", outputCol="features"),
            classifier(family, params, seed, len(columns), n_rows),
        ]
    )


def positive_probability() -> Column:
    return vector_to_array("probability")[1]


class Scorer:
    """A fitted candidate: `score(df)` adds `prediction_score`."""

    def __init__(self, columns: Sequence[str], parts: Sequence[tuple[float, PipelineModel]], platt=None, constant=None):
        self.columns, self.parts, self.platt, self.constant = list(columns), list(parts), platt, constant

    def raw(self, df: DataFrame) -> DataFrame:
        if self.constant is not None:
            return df.withColumn("prediction_score", F.lit(self.constant))
        keep = df.columns
        out = df
        total = sum(w for w, _ in self.parts)
        names = []
        for i, (weight, model) in enumerate(self.parts):
            clean = finite_or_null(out, self.columns)
            out = model.transform(clean).withColumn(f"__p{i}", positive_probability() * (weight / total))
            names.append(f"__p{i}")
            out = out.select(*keep, *names)
        return out.withColumn("prediction_score", sum((F.col(n) for n in names), F.lit(0.0))).drop(*names)

    def score(self, df: DataFrame) -> DataFrame:
        raw = self.raw(df)
        if self.platt is None:
            return raw
        slope, offset = self.platt
        margin = F.ln(_inside(F.col("prediction_score")) / (1 - _inside(F.col("prediction_score"))))
        return raw.withColumn("prediction_score", 1 / (1 + F.exp(-(margin * slope + offset))))


def _inside(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))


def fit_platt(scored: DataFrame, label: str = "label") -> tuple[float, float]:
    """Sigmoid on the log-odds of the score, fitted by a one-column logistic regression."""
    p = _inside(F.col("prediction_score"))
    rows = VectorAssembler(inputCols=["margin"], outputCol="features").transform(
        scored.withColumn("margin", F.ln(p / (1 - p))).select("margin", F.col(label).cast("double").alias("label"))
    )
    model = LogisticRegression(maxIter=100, regParam=0.0).fit(rows)
    return float(model.coefficients[0]), float(model.intercept)


def fit_candidate(
    train: DataFrame,
    columns: Sequence[str],
    family: str,
    params: Mapping[str, object] | None = None,
    label: str = "label",
    ts: str = "ts_us",
    order: Sequence[str] = (),
    seed: int = 42,
    calibration_fraction: float = 0.25,
) -> Scorer:
    """Fit on the earlier rows and calibrate on the chronological tail."""
    params = dict(params or {})
    if family == "prevalence":
        return Scorer(columns, [], constant=float(train.agg(F.avg(F.col(label).cast("double"))).first()[0]))
    marked = stage(splits.calibration_tail(train, calibration_fraction, ts, order))
    rows = finite_or_null(marked, columns).withColumn("label", F.col(label).cast("double"))
    fit_rows = rows.where(~F.col("calibrates"))
    n = fit_rows.count()
    if family == "soft_voting":
        weight = float(params.get("tree_weight", 0.5))
        members = [(1.0 - weight, "logistic", {}), (weight, "hist_gradient_boosting", params.get("tree", {}))]
    else:
        members = [(1.0, family, params)]
    parts = [(w, pipeline(columns, name, p, seed, n).fit(fit_rows)) for w, name, p in members]
    scorer = Scorer(columns, parts)
    scorer.platt = fit_platt(scorer.raw(marked.where("calibrates")), label)
    return scorer


def walkforward_evaluate(
    df: DataFrame,
    columns: Sequence[str],
    family: str,
    params: Mapping[str, object] | None = None,
    label: str = "vol_spike",
    ts: str = "ts_us",
    order: Sequence[str] = (),
    folds: int = 5,
    holdout_fraction: float = 0.2,
    embargo_seconds: float = 360,
    removed_feature: str | None = None,
    seed: int = 42,
) -> dict[str, object]:
    """Out-of-fold predictions and development metrics; the holdout is never scored.

    Returns frames `oof`, `folds`, `metrics`, `tau`, and the plan.
    """
    used = [c for c in columns if c != removed_feature]
    if not used:
        raise ValueError("every feature column was removed")
    members, plan = splits.make_temporal_splits(df, folds, holdout_fraction, embargo_seconds, label, ts, order)
    members = stage(members.where(F.col("role") != "holdout"))
    parts = []
    for fold in plan.folds:
        rows = members.where(F.col("fold") == fold.number)
        train = rows.where(F.col("role") == "train")
        scorer = fit_candidate(train, used, family, params, label, ts, order, seed)
        prior = train.agg(F.avg(F.col(label).cast("double"))).first()[0]
        parts.append(
            scorer.score(rows.where(F.col("role") == "validation")).select(
                F.col("position").alias("row_index"), F.col(ts).alias("ts_us"), F.col(label).cast("int").alias("target"),
                F.col("prediction_score").alias("prediction"), F.lit(float(prior)).alias("baseline_prediction"), "fold",
            )
        )
    oof = parts[0]
    for part in parts[1:]:
        oof = oof.unionByName(part)
    oof = stage(oof)
    summary = stage(metrics.fold_summary(oof))
    boundaries = members.groupBy("fold").agg(
        *[
            agg.alias(f"{role}_{name}")
            for role in ("train", "validation")
            for name, agg in (
                ("rows", F.count_if(F.col("role") == role)),
                ("start_us", F.min(F.when(F.col("role") == role, F.col(ts)))),
                ("end_us", F.max(F.when(F.col("role") == role, F.col(ts)))),
            )
        ]
    )
    return {
        "oof": oof, "folds": summary, "metrics": metrics.development_metrics(summary), "boundaries": boundaries,
        "tau": metrics.best_f1_threshold(oof, "prediction", "target"), "plan": plan, "columns": used,
    }


def score_ml(df: DataFrame, scorer: Scorer) -> DataFrame:
    """Batch or streaming scoring: probability of the positive class, six digits."""
    return scorer.score(df).withColumn("score", F.round("prediction_score", 6)).drop("prediction_score")


def score_baseline(df: DataFrame, vol: str = "vol_60s", threshold: float = 4.8e-5) -> DataFrame:
    """1.0 when recent volatility exceeds the labelling threshold, else 0.0."""
    return df.withColumn("score", (F.col(vol) > F.lit(threshold)).cast("double"))


SCORERS = {"ml": score_ml, "baseline": score_baseline}
