"""Ranking, calibration and alert metrics from score ladders.

A ladder has one row per distinct score with its positives, negatives and running
totals. Ties are one step by construction, copies of a score collapse before the
shuffle, and every curve metric is a plain aggregate over the ladder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import MICROS, ColumnLike, col, is_finite, micros, ratio
from tickloom.plans.lineage import stage

SERIES_KEYS = ("model_variant", "model_version", "run_id")


def score_ladder(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Distinct scores with tp/fp and running totals from the highest score down."""
    positive = F.coalesce(F.col(label).cast("int"), F.lit(0)) != 0
    return scan.value_ladder(
        df.withColumn(score, F.col(score).cast("double")),
        score,
        {
            "tp": F.when(positive, 1).otherwise(0).cast("bigint"),
            "fp": F.when(positive, 0).otherwise(1).cast("bigint"),
        },
        keys,
        descending=True,
    )


def average_precision(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Tie-aware average precision; null without positives."""
    steps = score_ladder(df, score, label, keys)
    gained = F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    return steps.groupBy(*keys).agg(
        F.sum(F.col("tp") + F.col("fp")).alias("n"),
        F.sum("tp").alias("n_positives"),
        F.try_divide(F.sum(gained), F.sum("tp")).alias("average_precision"),
    )


def ranking_metrics(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Average precision and ROC-AUC (average ranks for ties) from one ladder."""
    steps = score_ladder(df, score, label, keys)
    gained = F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    ordered_pairs = F.col("fp") * (F.col("cum_tp") - F.col("tp") / 2)
    return steps.groupBy(*keys).agg(
        F.try_divide(F.sum(gained), F.sum("tp")).alias("pr_auc"),
        F.try_divide(F.sum(ordered_pairs), (F.sum("tp") * F.sum("fp")).cast("double")).alias("roc_auc"),
    )


def pr_curve(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Precision and recall of `score >= threshold` at every distinct score."""
    steps = score_ladder(df, score, label, keys)
    totals = df.groupBy(*keys).agg(F.sum(F.coalesce(F.col(label).cast("bigint"), F.lit(0))).alias("__p"))
    sized = (
        scan.join_null_safe(steps, totals, list(keys)) if keys else steps.withColumn("__p", totals.scalar())
    )
    return sized.select(
        *keys,
        F.col(score).alias("threshold"),
        (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"),
        F.try_divide(F.col("cum_tp"), F.col("__p")).alias("recall"),
    )


def best_f1_threshold(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Score with the highest F1 on the curve, the lowest one on ties; 0.5 without any."""
    curve = pr_curve(df, score, label, keys)
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    scored = curve.withColumn("f1", f1)
    best = scored.groupBy(*keys).agg(
        F.max_by(F.struct("threshold", "f1"), F.struct(F.col("f1"), -F.col("threshold"))).alias("best")
    )
    return best.select(
        *keys, F.coalesce("best.threshold", F.lit(0.5)).alias("threshold"), F.col("best.f1").alias("f1")
    )


# -- threshold rule -----------------------------------------------------------


def confusion_columns(
    score: ColumnLike, label: ColumnLike, threshold: ColumnLike | float, zero_division: bool = False
) -> dict[str, Column]:
    """Aggregates for `score >= threshold`.

    Precision is null when nothing was alerted and recall null without positives;
    with `zero_division` both are 0 instead.
    """
    limit = F.lit(threshold) if isinstance(threshold, (int, float)) else col(threshold)
    alerted = col(score) >= limit
    actual = F.coalesce(col(label).cast("int"), F.lit(0)) != 0
    tp, fp = F.count_if(alerted & actual), F.count_if(alerted & ~actual)
    fn, tn = F.count_if(~alerted & actual), F.count_if(~alerted & ~actual)
    precision, recall = F.try_divide(tp, tp + fp), F.try_divide(tp, tp + fn)
    if zero_division:
        precision, recall = F.coalesce(precision, F.lit(0.0)), F.coalesce(recall, F.lit(0.0))
    f1 = F.when(precision + recall == 0, F.lit(0.0)).otherwise(
        F.try_divide(2 * precision * recall, precision + recall)
    )
    return {"tp": tp, "fp": fp, "fn": fn, "tn": tn, "precision": precision, "recall": recall, "f1": f1}


def confusion(
    df: DataFrame,
    threshold: ColumnLike | float,
    score: str = "score",
    label: str = "label",
    keys: Sequence[str] = (),
    zero_division: bool = False,
) -> DataFrame:
    columns = confusion_columns(score, label, threshold, zero_division)
    return df.groupBy(*keys).agg(*[expr.alias(name) for name, expr in columns.items()])


# -- probability quality ------------------------------------------------------


def ece_bin(score: ColumnLike, bins: int = 10) -> Column:
    """Equal-width bin, right edge included."""
    edges = [i * (1.0 / bins) for i in range(1, bins)]
    return sum(((col(score) > F.lit(edge)).cast("int") for edge in edges), F.lit(0))


def expected_calibration_error(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = (), bins: int = 10
) -> DataFrame:
    """Share-weighted distance between mean score and mean label over equal-width bins."""
    per_bin = df.groupBy(*keys, ece_bin(score, bins).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"),
        F.abs(F.avg(score) - F.avg(F.col(label).cast("double"))).alias("__off"),
    )
    return per_bin.groupBy(*keys).agg(
        (F.sum(F.col("__n") * F.col("__off")) / F.sum("__n")).alias("ece")
    )


def calibration_curve(
    df: DataFrame, score: str = "score", label: str = "label", bins: int = 10
) -> DataFrame:
    """Mean score and share of positives in quantile bins of the score."""
    inner = {f"e{i}": i / bins for i in range(1, bins)}
    edges = scan.exact_quantiles(df, score, inner).select(F.array(*inner).alias("edges")).scalar()
    placed = df.withColumn("__edges", edges)
    below = F.size(F.filter("__edges", lambda edge: edge < F.col(score)))
    return (
        placed.groupBy(below.alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_predicted"),
            F.avg(F.col(label).cast("double")).alias("fraction_positive"),
        )
    )


def grouped_prevalence(
    df: DataFrame, keys: Sequence[str], score: str = "score", label: str = "label"
) -> DataFrame:
    """Prevalence and average precision per day or regime; no precision for one-class groups."""
    per_group = average_precision(df, score, label, keys)
    both = (F.col("n_positives") > 0) & (F.col("n_positives") < F.col("n"))
    return per_group.select(
        *keys,
        (F.col("n_positives") / F.col("n")).alias("prevalence"),
        F.when(both, F.col("average_precision")).alias("pr_auc"),
    )


def input_problems(
    df: DataFrame, score: str = "score", label: str = "label", keys: Sequence[str] = ()
) -> DataFrame:
    """Groups whose metrics are undefined: one class only, or scores outside [0, 1]."""
    bad = ~is_finite(score) | (F.col(score) < 0) | (F.col(score) > 1)
    checks = df.groupBy(*keys).agg(
        F.count_if(F.coalesce(bad, F.lit(True))).alias("bad_scores"),
        F.count_distinct(label).alias("classes"),
        F.count_if(~F.coalesce(F.col(label).cast("int").isin(0, 1), F.lit(False))).alias("bad_labels"),
    )
    return checks.where((F.col("bad_scores") > 0) | (F.col("classes") < 2) | (F.col("bad_labels") > 0))


def metric_bundle(
    df: DataFrame,
    threshold: float,
    score: str = "score",
    label: str = "label",
    ts: str = "ts_us",
    keys: Sequence[str] = (),
    cooldown_seconds: float = 60,
    order: Sequence[str] = (),
    with_events: bool = True,
) -> DataFrame:
    """All row-level and alert-level metrics of one scored frame, one row per key."""
    if not keys:
        whole = metric_bundle(
            df.withColumn("__all", F.lit(1)), threshold, score, label, ts, ["__all"], cooldown_seconds, order, with_events
        )
        return whole.drop("__all")
    y = F.col(label).cast("double")
    eps = float(np.finfo(float).eps)
    p = F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1.0 - eps))
    hours = F.greatest((F.max(ts) - F.min(ts)) / F.lit(3600.0 * MICROS), F.lit(1 / 3600))
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("prevalence"),
        F.avg(-(y * F.ln(p) + (1 - y) * F.ln(1 - p))).alias("log_loss"),
        F.avg((F.col(score) - y) * (F.col(score) - y)).alias("brier"),
        *[
            expr.alias(name)
            for name, expr in confusion_columns(score, label, threshold, zero_division=True).items()
            if name in ("precision", "recall", "f1")
        ],
        hours.alias("__hours"),
    )
    parts = [ranking_metrics(df, score, label, keys), expected_calibration_error(df, score, label, keys)]
    if with_events:
        parts.append(
            event_metrics(df, threshold, cooldown_seconds, score, label, ts, keys, order).select(
                *keys, F.col("f1").alias("event_f1"), "alerts"
            )
        )
    for part in parts:
        rows = scan.join_null_safe(rows, part, list(keys))
    rows = rows.withColumn("pr_auc_lift", F.try_divide("pr_auc", "prevalence"))
    if with_events:
        rows = rows.withColumn("alerts_per_hour", F.col("alerts") / F.col("__hours")).drop("alerts")
    return rows.drop("__hours")


# -- alerts with a cooldown ---------------------------------------------------

ALERT_CHUNK_SECONDS = 3600


#: Tables of neighbouring chunks that one task composes in a round.
COMPOSED = 32


def compose_tables(first: np.ndarray, then: np.ndarray, cooldown: int) -> np.ndarray:
    """The transition table of two neighbouring chunks. Columns upto (rising), alerts, hits, last: a series unmuted at u takes
    the first row with upto >= u, and no alert if there is none."""
    i = np.searchsorted(then[:, 0], first[:, 3] + cooldown, side="left")
    hit, j = i < len(then), np.minimum(i, len(then) - 1)
    out = first.copy()
    out[:, 1:3] += np.where(hit[:, None], then[j, 1:3], 0)
    out[:, 3] = np.where(hit, then[j, 3], first[:, 3])
    # who finds nothing in the first chunk goes on to the second, unmuted at its start: chunks are no shorter than a mute
    out = np.concatenate([out, then[:1]])
    change = np.ones(len(out), dtype=bool)
    change[:-1] = (out[1:, 1:] != out[:-1, 1:]).any(axis=1)
    return out[change]


def _table(rows: np.ndarray, chunk: int, of: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["upto", "alerts", "hits", "last"])
    out.insert(0, "__chunk", chunk)
    for name in reversed(names):
        out.insert(0, name, of[name].iloc[0])
    return out


def _compose(tables: DataFrame, names: Sequence[str], prefix: str, cooldown: int) -> DataFrame:
    """One row per series: what its composed tables give a series that starts unmuted."""
    ends = tables.agg(F.min("__chunk").alias("low"), F.max("__chunk").alias("high")).first()
    if ends["low"] is None:
        return tables
    schema = f"{prefix}__chunk bigint, upto bigint, alerts bigint, hits bigint, last bigint"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__chunk", "upto"])
        chunk, rows = pdf["__chunk"].to_numpy(), pdf[["upto", "alerts", "hits", "last"]].to_numpy()
        pieces = np.split(rows, np.flatnonzero(np.diff(chunk)) + 1)
        return _table(reduce(lambda a, b: compose_tables(a, b, cooldown), pieces), int(chunk[0]) // COMPOSED, pdf, names)

    tables = tables.withColumn("__chunk", F.col("__chunk") - F.lit(ends["low"]))
    span = ends["high"] - ends["low"]
    while span > 0:
        place = F.floor(F.col("__chunk") / F.lit(COMPOSED)).alias("__group")
        tables = tables.groupBy(*names, place).applyInPandas(fold, schema)
        span //= COMPOSED
    return tables.groupBy(*names).agg(F.min_by("alerts", "upto").alias("alerts"), F.min_by("hits", "upto").alias("hits"))


def event_metrics(
    df: DataFrame,
    threshold: float,
    cooldown_seconds: float = 60,
    score: str = "score",
    label: str = "label",
    ts: str = "ts_us",
    keys: Sequence[str] = (),
    order: Sequence[str] = (),
    chunk_seconds: float = ALERT_CHUNK_SECONDS,
) -> DataFrame:
    """Alert counts when an alert mutes its series for `cooldown_seconds`.

    Alerting is greedy and therefore sequential, but a time chunk only depends on
    its predecessor through the moment the mute ends. Every chunk is first reduced,
    a few neighbouring ones a task, to a short table "if unmuted at t: so many alerts, so many hits,
    last alert at u". Such tables are step functions and their composition is
    associative, so neighbouring ones are composed in rounds of `COMPOSED` tables
    until one is left per series: no task holds a series.

    `order` breaks equal timestamps the way the series lists its rows; without it
    the row with the smaller score, then label, comes first.
    """
    if cooldown_seconds < 0:
        raise ValueError(f"a cooldown of {cooldown_seconds} s is negative")
    if not keys:
        whole = event_metrics(
            df.withColumn("__all", F.lit(1)), threshold, cooldown_seconds, score, label, ts, ["__all"], order, chunk_seconds
        )
        return whole.drop("__all")
    cooldown = micros(cooldown_seconds)
    positives = df.groupBy(*keys).agg(F.sum(F.col(label).cast("bigint")).alias("positives"))
    candidates = df.where(F.col(score) >= threshold)
    if cooldown == 0:
        alerts = candidates.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("alerts"), F.sum(F.col(label).cast("bigint")).alias("true_positive_alerts")
        )
    else:
        width = max(micros(chunk_seconds), cooldown)
        key_fields = ", ".join(
            f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in keys
        )
        prefix = f"{key_fields}, "
        names = [f.name for f in df.schema.fields if f.name in keys]
        # a position breaks equal timestamps the way the series lists its rows
        rows = candidates.select(
            *names, F.col(ts).alias("__ts"), F.struct(*(order or [score, label])).alias("__order"),
            F.col(label).cast("bigint").alias("__y"),
        ).groupBy(*names, "__ts").agg(F.min_by("__y", "__order").alias("__y"))
        chunked = rows.withColumn("__chunk", F.floor(F.col("__ts") / F.lit(width)))

        def reduce_chunk(at: np.ndarray, hit: np.ndarray, chunk: int) -> np.ndarray:
            follow = np.searchsorted(at, at + cooldown, side="left")
            n_starts = int(np.searchsorted(at, chunk * width + cooldown, side="left")) + 1
            start = np.arange(min(n_starts, len(at)))
            current, alive = start.copy(), np.ones(len(start), dtype=bool)
            alerts, hits, last = (np.zeros(len(start), dtype=np.int64) for _ in range(3))
            while alive.any():
                here = current[alive]
                alerts[alive] += 1
                hits[alive] += hit[here]
                last[alive] = at[here]
                current[alive] = follow[here]
                alive = current < len(at)
            # neighbouring starts that end alike need only the latest start time
            change = np.ones(len(start), dtype=bool)
            change[:-1] = (
                (alerts[1:] != alerts[:-1]) | (hits[1:] != hits[:-1]) | (last[1:] != last[:-1])
            )
            return np.stack([at[start], alerts, hits, last], axis=1)[change]

        def reduce_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__ts")
            at, hit, chunk = (pdf[c].to_numpy(np.int64) for c in ("__ts", "__y", "__chunk"))
            edges = np.flatnonzero(np.diff(chunk)) + 1
            pieces = zip(np.split(at, edges), np.split(hit, edges), chunk[np.append(0, edges)], strict=True)
            table = reduce(lambda a, b: compose_tables(a, b, cooldown), (reduce_chunk(t, y, int(c)) for t, y, c in pieces))
            return _table(table, int(chunk[0]) // COMPOSED, pdf, names)

        grouped = chunked.groupBy(*names, F.floor(F.col("__chunk") / F.lit(COMPOSED)).alias("__group"))
        tables = grouped.applyInPandas(reduce_chunks, f"{prefix}__chunk bigint, upto bigint, alerts bigint, hits bigint, last bigint")

        alerts = _compose(tables, names, prefix, cooldown).select(
            *names, F.col("alerts"), F.col("hits").alias("true_positive_alerts")
        )
    joined = scan.join_null_safe(positives, alerts, list(keys))
    zero = F.lit(0).cast("bigint")
    joined = joined.withColumns(
        {
            "alerts": F.coalesce("alerts", zero),
            "true_positive_alerts": F.coalesce("true_positive_alerts", zero),
        }
    )
    joined = joined.withColumns(
        {
            "precision": ratio("true_positive_alerts", "alerts"),
            "recall": ratio("true_positive_alerts", "positives"),
        }
    )
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return joined.select(*keys, "alerts", "true_positive_alerts", "precision", "recall", f1.alias("f1"))


# -- bootstrap ----------------------------------------------------------------


def paired_block_bootstrap(
    df: DataFrame,
    candidate: str = "candidate_score",
    baseline: str = "baseline_score",
    label: str = "label",
    ts: str = "ts_us",
    block_minutes: int = 30,
    resamples: int = 2000,
    seed: int = 42,
    chunks: int | None = None,
) -> DataFrame:
    """Average-precision gain of the candidate under resampling of time blocks.

    Rows shrink to counts per (score, block) once. A draw is a function of (seed,
    resample, position), which every task works out for itself, so no resample is
    ever materialised: score ranges compute their share of each resample's average
    precision from the totals of the ranges above them. One output row: lower
    (2.5 %), estimate (mean), upper (97.5 %).
    """
    deltas = bootstrap_deltas(
        df, candidate, baseline, label, ts, block_minutes, resamples, seed, chunks
    )
    bounds = scan.exact_quantiles(deltas, "delta", {"lower": 0.025, "upper": 0.975})
    estimate = deltas.agg(F.avg("delta")).scalar()
    return bounds.withColumn("estimate", estimate).select("lower", "estimate", "upper")


#: Arithmetic of the draws: a prime whose products fit 63 bits, a stride between resamples, and constants of the rounds.
DRAW_PRIME, DRAW_STRIDE, DRAW_ROUNDS = (1 << 31) - 1, 1_000_003, (739_982_445, 1_362_437, 2_025_326_587)


def block_draws(resample: int, n_blocks: int, seed: int) -> np.ndarray:
    """The block numbers that one resample draws, `n_blocks` of them with replacement.

    Position and resample make one number; three rounds of x -> x**5 + c modulo a prime (a permutation) scatter it. Plain
    arithmetic on 63-bit numbers, so SQL repeats it.
    """
    z = (np.arange(n_blocks, dtype=np.int64) + resample * DRAW_STRIDE + seed) % DRAW_PRIME
    for c in DRAW_ROUNDS:
        square = z * z % DRAW_PRIME
        z = (square * square % DRAW_PRIME * z + c) % DRAW_PRIME
    return z % n_blocks


def bootstrap_deltas(
    df: DataFrame,
    candidate: str,
    baseline: str,
    label: str,
    ts: str,
    block_minutes: int,
    resamples: int,
    seed: int,
    chunks: int | None = None,
) -> DataFrame:
    """One row per resample with its average-precision difference."""
    if block_minutes <= 0 or resamples <= 0:
        raise ValueError(f"{block_minutes} minutes a block and {resamples} resamples: both must exceed 0")
    width = micros(block_minutes * 60)
    block = F.floor(F.col(ts) / F.lit(width))
    positive = F.coalesce(F.col(label).cast("int"), F.lit(0)) != 0
    long = df.select(
        block.alias("block"),
        positive.alias("positive"),
        F.explode(
            F.array(
                F.struct(F.lit("candidate").alias("side"), F.col(candidate).cast("double").alias("score")),
                F.struct(F.lit("baseline").alias("side"), F.col(baseline).cast("double").alias("score")),
            )
        ).alias("s"),
    ).select("block", "positive", "s.*")
    # block numbers follow the calendar: a handful of rows per day
    blocks = df.select(block.alias("block")).distinct()
    numbered = blocks.withColumn("number", F.row_number().over(Window.orderBy("block")) - 1)
    n_blocks = blocks.agg(F.count(F.lit(1))).scalar()
    counts = long.groupBy("side", "block", "score").agg(
        F.count_if("positive").alias("tp"), F.count_if(~F.col("positive")).alias("fp")
    )
    counts = counts.join(numbered, "block").withColumn("n_blocks", n_blocks)
    # every distinct score once: a score that most rows share must not draw the edges of the ranges to itself
    counts = scan.with_value_chunk(counts, counts.select("score").distinct(), "score", "chunk", chunks).select(
        "side", "chunk", "score", "number", "n_blocks", "tp", "fp"
    )

    def draws(n_blocks: int) -> Iterator[np.ndarray]:
        for resample in range(resamples):
            yield np.bincount(block_draws(resample, n_blocks, seed), minlength=n_blocks)

    def totals(pdf: pd.DataFrame) -> pd.DataFrame:
        number = pdf["number"].to_numpy()
        tp, fp = pdf["tp"].to_numpy(), pdf["fp"].to_numpy()
        sums = [((w := drawn[number]) @ tp, w @ fp) for drawn in draws(int(pdf["n_blocks"].iloc[0]))]
        out = pd.DataFrame(sums, columns=["tp", "fp"])
        out.insert(0, "resample", np.arange(resamples))
        out.insert(0, "chunk", pdf["chunk"].iloc[0])
        out.insert(0, "side", pdf["side"].iloc[0])
        return out

    per_range = counts.groupBy("side", "chunk").applyInPandas(
        totals, "side string, chunk int, resample int, tp bigint, fp bigint"
    )
    above = (
        Window.partitionBy("side", "resample")
        .orderBy(F.col("chunk").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    offsets = per_range.select(
        "side", "chunk", "resample",
        F.coalesce(F.sum("tp").over(above), zero).alias("tp_above"),
        F.coalesce(F.sum("fp").over(above), zero).alias("fp_above"),
    )

    def gains(pdf: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", ascending=False, kind="mergesort")
        over = over.sort_values("resample")
        number, score = pdf["number"].to_numpy(), pdf["score"].to_numpy()
        tp, fp = pdf["tp"].to_numpy(), pdf["fp"].to_numpy()
        first = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        out = []
        for r, (drawn, tp0, fp0) in enumerate(
            zip(draws(int(pdf["n_blocks"].iloc[0])), over["tp_above"].to_numpy(), over["fp_above"].to_numpy())
        ):
            w = drawn[number]
            step_tp = np.add.reduceat(tp * w, first)
            step_n = step_tp + np.add.reduceat(fp * w, first)
            cum_tp, cum_n = tp0 + np.cumsum(step_tp), tp0 + fp0 + np.cumsum(step_n)
            part = float(np.sum(step_tp * cum_tp / np.maximum(cum_n, 1)))
            out.append((r, part, int(step_tp.sum())))
        frame = pd.DataFrame(out, columns=["resample", "part", "tp"])
        frame.insert(0, "side", pdf["side"].iloc[0])
        return frame

    parts = (
        counts.groupBy("side", "chunk")
        .cogroup(offsets.groupBy("side", "chunk"))
        .applyInPandas(gains, "side string, resample int, part double, tp bigint")
    )
    ap = lambda side: F.coalesce(
        F.try_divide(
            F.sum(F.when(F.col("side") == side, F.col("part"))),
            F.sum(F.when(F.col("side") == side, F.col("tp"))).cast("double"),
        ),
        F.lit(0.0),
    )
    return parts.groupBy("resample").agg((ap("candidate") - ap("baseline")).alias("delta"))


# -- fold summaries and triggers ----------------------------------------------


def fold_summary(
    oof: DataFrame, score: str = "prediction", label: str = "target", fold: str = "fold",
    baseline: str = "baseline_prediction",
) -> DataFrame:
    """Per fold: average precision, prevalence, and summed squared errors of model and baseline."""
    y = F.col(label).cast("double")
    errors = oof.groupBy(fold).agg(
        F.sum((F.col(score) - y) * (F.col(score) - y)).alias("candidate_squared"),
        F.sum((F.col(baseline) - y) * (F.col(baseline) - y)).alias("baseline_squared"),
    )
    ranked = average_precision(oof, score, label, [fold]).select(
        fold, "n", (F.col("n_positives") / F.col("n")).alias("prevalence"),
        F.col("average_precision").alias("pr_auc"),
    )
    return scan.join_null_safe(ranked, errors, [fold])


def development_metrics(folds: DataFrame) -> DataFrame:
    """Mean fold score, folds that beat their prevalence, and the Brier ratio to the baseline."""
    return folds.agg(
        F.avg("pr_auc").alias("aggregate_pr_auc"),
        F.count_if(F.col("pr_auc") > F.col("prevalence")).alias("development_folds_won"),
        F.try_divide(F.sum("candidate_squared"), F.sum("baseline_squared")).alias("development_brier_ratio"),
    )


def paired_folds_won(
    candidate: DataFrame, baseline: DataFrame, folds: DataFrame, fold: str = "fold", metric: str = "pr_auc"
) -> DataFrame:
    """Folds where the candidate is strictly better; a missing side never wins for it."""
    paired = folds.select(fold).join(
        candidate.select(fold, F.col(metric).alias("__c")), fold, "left"
    ).join(baseline.select(fold, F.col(metric).alias("__b")), fold, "left")
    wins = F.coalesce("__c", F.lit(float("-inf"))) > F.coalesce("__b", F.lit(float("inf")))
    return paired.agg(F.count_if(wins).alias("folds_won"))


def retrain_triggers(
    drift: DataFrame, recent: DataFrame, js_limit: float = 0.15, ap_floor: float = 0.30
) -> DataFrame:
    """Reasons to retrain: target drift above the limit, or recent average precision below the floor."""
    worst = drift.agg(F.max("js_distance")).scalar()
    quality = recent.agg(F.max("average_precision")).scalar()
    spark = drift.sparkSession
    row = spark.range(1).select(worst.alias("js_distance"), quality.alias("average_precision"))
    from tickloom.functions.exprs import reasons

    return row.withColumn(
        "reasons",
        reasons(
            ("target_drift", F.col("js_distance") > js_limit),
            ("average_precision_below_floor", F.col("average_precision") < ap_floor),
        ),
    ).withColumn("retrain", F.size("reasons") > 0)


def rolling_triggers(
    recent: DataFrame, reference: DataFrame, score: str = "score", label: str = "label", day: str = "day", days: int = 7,
    js_limit: float = 0.15, ap_floor: float = 0.30,
) -> DataFrame:
    """Reasons to retrain after each observed day, judged on the `days` days that end with it: (day, n, average_precision,
    js_distance, reasons, retrain).

    A day's state is its ladder: positives and negatives per distinct score. States of several days add up, so every window
    is a sum of small tables; rows are read once. `reference` gives the label's usual distribution.
    """
    positive = F.coalesce(F.col(label).cast("int"), F.lit(0)) != 0
    state = stage(
        recent.where(F.col(day).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(day).cast("date").alias("__day"), F.col(score).cast("double").alias("score"))
        .agg(F.count_if(positive).alias("tp"), F.count_if(~positive).alias("fp"))
    )
    ends = state.select(F.col("__day").alias("day")).distinct()
    spread = state.withColumn("day", F.explode(F.transform(F.sequence(F.lit(0), F.lit(days - 1)), lambda k: F.date_add("__day", k))))
    steps = scan.value_ladder(
        spread.join(ends, "day"), "score", {"tp": F.col("tp"), "fp": F.col("fp")}, ["day"], descending=True
    )
    gained = F.col("tp") * F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    windows = steps.groupBy("day").agg(
        F.sum(F.col("tp") + F.col("fp")).alias("n"), F.sum("tp").alias("__tp"),
        F.try_divide(F.sum(gained), F.sum("tp")).alias("average_precision"),
    )
    usual = reference.agg(F.avg(positive.cast("double")).alias("p")).scalar()
    p, q = F.coalesce("__p", F.lit(0.0)), F.col("__tp") / F.col("n")
    part = lambda x, y: F.when(x > 0, x * F.ln(2 * x / (x + y))).otherwise(0.0)
    divergence = (part(p, q) + part(q, p) + part(1 - p, 1 - q) + part(1 - q, 1 - p)) / 2
    judged = windows.withColumn("__p", usual).withColumn("js_distance", F.sqrt(F.greatest(divergence, F.lit(0.0))))
    from tickloom.functions.exprs import reasons

    found = reasons(
        ("target_drift", F.col("js_distance") > js_limit), ("average_precision_below_floor", F.col("average_precision") < ap_floor)
    )
    out = judged.withColumn("reasons", found).withColumn("retrain", F.size("reasons") > 0)
    return out.select("day", "n", "average_precision", "js_distance", "reasons", "retrain")
