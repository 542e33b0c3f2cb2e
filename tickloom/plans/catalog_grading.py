"""Registered queries of grading, serving views, timeline and metrics, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.exprs import event_time
from tickloom.operators import grading as gr
from tickloom.operators import metrics as mt
from tickloom.operators import timeline as tl
from tickloom.plans.inputs import GRADED, SCORED, SCORED_BOTH, ladder_sql, outcomes, predictions, r, registrar, rs, scored, text
from tickloom.plans.lineage import stage

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

NEWEST = (
    "coalesce(api_ts, feature_ts) DESC, source_partition DESC, source_offset DESC, event_id ASC"
)
BASE = 4.8e-5
NO_LABELS = "CASE WHEN vol_spike <> 0 THEN 1 ELSE 0 END"


def joined(spark, sf):
    return gr.join_outcomes(predictions(spark, sf), outcomes(spark, sf))


def graded_rows(spark, sf):
    return gr.with_grade(joined(spark, sf)).where(F.col("grade") == "graded")


@query("recent_topk", f"WITH {GRADED} SELECT event_id, score, stream_id FROM p ORDER BY {NEWEST} LIMIT 200")
def recent_topk(spark, sf):
    return gr.recent(predictions(spark, sf), 200).select("event_id", "score", "stream_id")


@query("active_segment", f"WITH {GRADED} SELECT stream_id FROM p ORDER BY {NEWEST} LIMIT 1")
def active_segment(spark, sf):
    return gr.active_segment(predictions(spark, sf))


@query("retention", f"WITH {GRADED} SELECT event_id FROM (SELECT * FROM p ORDER BY {NEWEST} LIMIT 3000)")
def retention(spark, sf):
    return gr.retain_newest(predictions(spark, sf), 3000).select("event_id")


@query(
    "outcome_retention",
    f"WITH {GRADED} SELECT feature_id FROM (SELECT * FROM o ORDER BY feature_ts DESC, feature_id LIMIT 3000)",
)
def outcome_retention(spark, sf):
    return gr.retain_newest_outcomes(outcomes(spark, sf), 3000).select("feature_id")


@query(
    "segment_bounds",
    f"""WITH {GRADED} SELECT stream_id, epoch_us(min(feature_ts)) AS oldest_us, epoch_us(max(feature_ts)) AS newest_us,
        count(*) AS n FROM p GROUP BY stream_id""",
)
def segment_bounds(spark, sf):
    rows = predictions(spark, sf)
    bounds = gr.segment_bounds(rows).select(
        F.col("stream_id").alias("sid"),
        F.unix_micros(event_time("oldest_feature_ts")).alias("oldest_us"),
        F.unix_micros(event_time("newest_feature_ts")).alias("newest_us"),
    )
    sizes = rows.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(bounds, sizes["stream_id"].eqNullSafe(bounds["sid"])).drop("sid")


@query(
    "pred_outcome_left",
    f"WITH {GRADED} SELECT event_id, feature_id, score, vol_spike, {rs('future_vol_60s', 10)} AS future_vol FROM j",
)
def pred_outcome_left(spark, sf):
    return joined(spark, sf).select(
        "event_id", "feature_id", "score", "vol_spike", r("future_vol_60s", 10).alias("future_vol")
    )


@query(
    "outcomes_unmatched",
    f"""WITH {GRADED} SELECT stream_id, count(*) AS n FROM o
        WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.feature_id = o.feature_id) GROUP BY stream_id""",
)
def outcomes_unmatched(spark, sf):
    missing = gr.unmatched_outcomes(outcomes(spark, sf), predictions(spark, sf))
    return missing.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"))


@query("unknown_lineage", f"WITH {GRADED} SELECT count(*) AS n_unknown_lineage FROM p WHERE stream_id IS NULL")
def unknown_lineage(spark, sf):
    rows = predictions(spark, sf)
    return rows.where(F.col("stream_id").isNull()).agg(F.count(F.lit(1)).alias("n_unknown_lineage"))


@query(
    "grade_split",
    f"""WITH {GRADED} SELECT stream_id, count(*) AS n_joined, count(*) FILTER (WHERE grade = 'graded') AS n_graded,
        count(*) FILTER (WHERE grade = 'late') AS n_scored_late, count(*) FILTER (WHERE grade = 'unmatched') AS n_predictions_unmatched,
        {rs("median(CASE WHEN grade = 'graded' THEN epoch_us(written_at) - epoch_us(api_ts) END) / 1e6")} AS median_lead_seconds
        FROM j GROUP BY stream_id""",
)
def grade_split(spark, sf):
    out = gr.grade_counts(stage(gr.with_grade(joined(spark, sf))), ["stream_id"])
    return out.withColumn("median_lead_seconds", r("median_lead_seconds"))


def confusion_sql(source: str, alert: str, actual: str, keys: str = "") -> str:
    return f"""conf AS (
  SELECT {keys}count(*) FILTER (WHERE {alert} AND {actual}) AS tp, count(*) FILTER (WHERE {alert} AND NOT {actual}) AS fp,
         count(*) FILTER (WHERE NOT ({alert}) AND {actual}) AS fn, count(*) FILTER (WHERE NOT ({alert}) AND NOT {actual}) AS tn, count(*) AS n
  FROM {source} {'GROUP BY ' + keys.rstrip(', ') if keys else ''}),
rates AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS prec,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS rec FROM conf),
scores AS (
  SELECT *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM rates)"""


RATES = f"tp, fp, fn, tn, {rs('prec')} AS precision, {rs('rec')} AS recall, {rs('f1')} AS f1"


def rounded_rates(df, *columns):
    return df.select(
        *columns, "tp", "fp", "fn", "tn", r("precision").alias("precision"), r("recall").alias("recall"),
        r("f1").alias("f1"),
    )


@query(
    "confusion",
    f"WITH {SCORED}, {confusion_sql('s', 'score >= 0.7', 'label = 1', 'regime, ')} SELECT regime, {RATES} FROM scores",
)
def confusion(spark, sf):
    return rounded_rates(mt.confusion(scored(spark, sf), 0.7, keys=["regime"]), "regime")


@query(
    "avg_precision",
    f"""WITH {ladder_sql()} SELECT sum(tp + fp)::BIGINT AS n, sum(tp)::BIGINT AS n_positives,
        {rs('sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp)')} AS average_precision FROM steps""",
)
def avg_precision(spark, sf):
    out = mt.average_precision(scored(spark, sf))
    return out.withColumn("average_precision", r("average_precision"))


@query(
    "per_day_ap",
    f"""WITH {ladder_sql('day')} SELECT CAST(day AS VARCHAR) AS day, {rs('sum(tp) / sum(tp + fp)::DOUBLE')} AS prevalence,
        {rs('CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp) END')} AS pr_auc
        FROM steps GROUP BY steps.day""",
)
def per_day_ap(spark, sf):
    out = mt.grouped_prevalence(scored(spark, sf), ["day"])
    return out.select(text("day"), r("prevalence").alias("prevalence"), r("pr_auc").alias("pr_auc"))


@query(
    "per_regime_ap",
    f"""WITH {ladder_sql('regime')} SELECT regime, {rs('sum(tp) / sum(tp + fp)::DOUBLE')} AS prevalence,
        {rs('CASE WHEN sum(tp) > 0 AND sum(fp) > 0 THEN sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp) END')} AS pr_auc
        FROM steps GROUP BY regime""",
)
def per_regime_ap(spark, sf):
    out = mt.grouped_prevalence(scored(spark, sf), ["regime"])
    return out.select("regime", r("prevalence").alias("prevalence"), r("pr_auc").alias("pr_auc"))


@query(
    "adaptive_threshold",
    f"""WITH {GRADED} SELECT {rs("CASE WHEN count(future_vol_60s) >= 50 THEN quantile_disc(future_vol_60s, 0.85) END", 10)}
        AS adaptive_threshold FROM j WHERE grade = 'graded'""",
)
def adaptive_threshold(spark, sf):
    return gr.adaptive_threshold(stage(graded_rows(spark, sf))).select(
        r("adaptive_threshold", 10).alias("adaptive_threshold")
    )


def series_sql(mode: str, label: str) -> str:
    """Model and baseline series of one mode; expects g with a label column."""
    key = "model_variant, model_version, run_id"
    return f"""
votes_{mode} AS (
  SELECT {key}, tau, count(*) AS c, min(feature_ts) AS f FROM g WHERE model_variant = 'ml' AND tau IS NOT NULL GROUP BY ALL),
tau_{mode} AS (
  SELECT {key}, tau FROM votes_{mode} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY c DESC, f) = 1),
rows_{mode} AS (
  SELECT g.* EXCLUDE (tau), coalesce(t.tau, 0.7015) AS tau, CASE WHEN t.tau IS NULL THEN 'fallback' ELSE 'model' END AS tau_source,
         {label} AS y
  FROM g LEFT JOIN tau_{mode} t USING ({key.replace('model_variant, ', 'model_variant, ')}) WHERE g.model_variant = 'ml'),
lad_{mode} AS (SELECT {key}, score, sum(y) AS p, sum(1 - y) AS q FROM rows_{mode} GROUP BY ALL),
step_{mode} AS (SELECT *, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM lad_{mode}
  WINDOW w AS (PARTITION BY {key} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ap_{mode} AS (SELECT {key}, sum(p * cp / (cp + cq)::DOUBLE) / sum(p) AS ap FROM step_{mode} GROUP BY ALL),
conf_{mode} AS (
  SELECT {key}, tau, tau_source, count(*) AS n, sum(y)::BIGINT AS n_positives,
         count(*) FILTER (WHERE score >= tau AND y = 1) AS tp, count(*) FILTER (WHERE score >= tau AND y = 0) AS fp,
         count(*) FILTER (WHERE score < tau AND y = 1) AS fn, count(*) FILTER (WHERE score < tau AND y = 0) AS tn
  FROM rows_{mode} GROUP BY ALL),
base_{mode} AS (
  SELECT 'baseline' AS model_variant, NULL::VARCHAR AS model_version, NULL::VARCHAR AS run_id, NULL::DOUBLE AS tau,
         NULL::VARCHAR AS tau_source, count(*) AS n, sum({label})::BIGINT AS n_positives,
         count(*) FILTER (WHERE coalesce(vol_60s, 0) > {BASE} AND {label} = 1) AS tp, count(*) FILTER (WHERE coalesce(vol_60s, 0) > {BASE} AND {label} = 0) AS fp,
         count(*) FILTER (WHERE coalesce(vol_60s, 0) <= {BASE} AND {label} = 1) AS fn, count(*) FILTER (WHERE coalesce(vol_60s, 0) <= {BASE} AND {label} = 0) AS tn
  FROM g),
all_{mode} AS (
  SELECT c.*, CASE WHEN n_positives >= 10 THEN ap END AS pr_auc FROM conf_{mode} c
  JOIN ap_{mode} a USING (model_variant, model_version, run_id)
  UNION ALL SELECT *, NULL FROM base_{mode} WHERE n > 0),
rate_{mode} AS (
  SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS prec,
         CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS rec FROM all_{mode}),
series_{mode} AS (
  SELECT '{mode}' AS mode, *, CASE WHEN prec + rec = 0 THEN 0 ELSE 2 * prec * rec / (prec + rec) END AS f1 FROM rate_{mode})"""


OFFICIAL = "CASE WHEN coalesce(vol_spike, 0) <> 0 THEN 1 ELSE 0 END"
ADAPTIVE = (
    "CASE WHEN coalesce(future_vol_60s > (SELECT quantile_disc(future_vol_60s, 0.85) FROM g), FALSE) THEN 1 ELSE 0 END"
)
SERIES = f"""model_variant, model_version, run_id, tau, tau_source, n, n_positives, {RATES}, {rs('pr_auc')} AS pr_auc"""
G = f"{GRADED}, g AS (SELECT * FROM j WHERE grade = 'graded')"


def rounded_series(df, *columns):
    return df.select(
        *columns, "model_variant", "model_version", "run_id", "tau", "tau_source", "n", "n_positives", "tp", "fp",
        "fn", "tn", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"),
        r("pr_auc").alias("pr_auc"),
    )


@query(
    "model_series",
    f"WITH {G}, {series_sql('official', OFFICIAL)} SELECT {SERIES} FROM series_official WHERE model_variant = 'ml'",
)
def model_series(spark, sf):
    rows = gr.with_mode_labels(stage(graded_rows(spark, sf)), F.lit(None).cast("double"))
    return rounded_series(gr.ml_series(rows, "official_label"))


@query(
    "baseline_series",
    f"WITH {G}, {series_sql('official', OFFICIAL)} SELECT n, n_positives, {RATES} FROM series_official WHERE model_variant = 'baseline'",
)
def baseline_series(spark, sf):
    rows = gr.with_mode_labels(graded_rows(spark, sf), F.lit(None).cast("double"))
    return rounded_rates(gr.baseline_series(rows, "official_label"), "n", "n_positives")


@query(
    "performance_modes",
    f"""WITH {G}, {series_sql('official', OFFICIAL)}, {series_sql('adaptive', ADAPTIVE)}
        SELECT mode, {SERIES} FROM (SELECT * FROM series_official UNION ALL SELECT * FROM series_adaptive)""",
)
def performance_modes(spark, sf):
    return rounded_series(gr.performance_series(stage(graded_rows(spark, sf))), "mode")


@query(
    "mode_summary",
    f"""WITH {G}, {series_sql('official', OFFICIAL)}, {series_sql('adaptive', ADAPTIVE)},
a AS (SELECT * FROM series_official UNION ALL SELECT * FROM series_adaptive)
SELECT mode, {rs("max(CASE WHEN model_variant = 'baseline' THEN n_positives / n::DOUBLE END)")} AS base_rate,
       bool_or(model_variant = 'ml') AS ml_available FROM a GROUP BY mode""",
)
def mode_summary(spark, sf):
    out = gr.mode_summary(stage(gr.performance_series(stage(graded_rows(spark, sf)))))
    return out.withColumn("base_rate", r("base_rate"))


@query(
    "benchmark_note",
    f"""WITH {G}, {series_sql('official', OFFICIAL)},
firsts AS (SELECT model_version, min(feature_ts) AS f FROM g WHERE model_variant = 'ml' GROUP BY ALL),
prim AS (SELECT pr_auc, (SELECT max(n) FROM series_official WHERE model_variant = 'baseline') AS total
  FROM series_official s JOIN firsts USING (model_version) WHERE model_variant = 'ml' ORDER BY n DESC, f LIMIT 1)
SELECT coalesce(pr_auc IS NOT NULL AND total >= 1000 AND pr_auc < 0.1459 * 0.7, FALSE) AS triggered,
       CASE WHEN pr_auc IS NULL OR total < 1000 THEN 'not enough graded data yet'
            WHEN pr_auc < 0.1459 * 0.7 THEN 'well below the training benchmark' ELSE 'no drift detected' END AS detail
FROM prim""",
)
def benchmark_note(spark, sf):
    return gr.benchmark_note(stage(gr.performance_series(stage(graded_rows(spark, sf)))))


WINDOW_MINUTES = 5 * 1440
SNAPSHOT = f"""{GRADED},
seg AS (SELECT stream_id FROM p ORDER BY {NEWEST} LIMIT 1),
mine AS (SELECT p.* FROM p, seg WHERE p.stream_id IS NOT DISTINCT FROM seg.stream_id),
cut AS (SELECT max(feature_ts) - INTERVAL {WINDOW_MINUTES} MINUTE AS c, max(feature_ts) AS newest, min(feature_ts) AS oldest FROM mine),
w AS (SELECT j.* FROM j, seg, cut WHERE j.stream_id IS NOT DISTINCT FROM seg.stream_id AND j.feature_ts >= cut.c)"""


@query(
    "performance_snapshot",
    f"""WITH {SNAPSHOT}
SELECT seg.stream_id, oldest <= c AS complete, epoch_us(c) AS from_us, epoch_us(newest) AS to_us,
  (SELECT count(*) FROM o, seg, cut WHERE o.stream_id IS NOT DISTINCT FROM seg.stream_id AND o.feature_ts >= cut.c
     AND NOT EXISTS (SELECT 1 FROM p WHERE p.feature_id = o.feature_id)) AS n_outcomes_unmatched,
  (SELECT count(*) FROM p, cut WHERE p.stream_id IS NULL AND p.feature_ts >= cut.c) AS n_unknown_lineage,
  (SELECT count(*) FROM w) AS n_joined, (SELECT count(*) FILTER (WHERE grade = 'graded') FROM w) AS n_graded,
  (SELECT count(*) FILTER (WHERE grade = 'late') FROM w) AS n_scored_late,
  (SELECT count(*) FILTER (WHERE grade = 'unmatched') FROM w) AS n_predictions_unmatched
FROM seg, cut""",
)
def performance_snapshot(spark, sf):
    rows, window = gr.performance_window(predictions(spark, sf), outcomes(spark, sf), WINDOW_MINUTES)
    counts = gr.with_grade(rows).agg(
        F.count(F.lit(1)).alias("n_joined"),
        F.count_if(F.col("grade") == "graded").alias("n_graded"),
        F.count_if(F.col("grade") == "late").alias("n_scored_late"),
        F.count_if(F.col("grade") == "unmatched").alias("n_predictions_unmatched"),
    )
    packed = counts.select(F.struct(*counts.columns).alias("c")).scalar()
    return window.withColumn("c", packed).select(
        "stream_id", "complete", F.unix_micros("from_feature_ts").alias("from_us"),
        F.unix_micros("to_feature_ts").alias("to_us"), "n_outcomes_unmatched", "n_unknown_lineage", "c.*",
    )


@query(
    "chart_rows",
    f"""WITH {G},
t AS (SELECT quantile_disc(future_vol_60s, 0.85) AS thr FROM g), m AS (SELECT max(stream_epoch) AS e FROM j)
SELECT event_id, score, model_variant, CASE WHEN vol_60s > {BASE} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS baseline_score,
       CASE WHEN written_at IS NOT NULL THEN vol_spike <> 0 END AS outcome_official,
       CASE WHEN written_at IS NOT NULL THEN future_vol_60s > thr END AS outcome_adaptive
FROM j, t, m WHERE stream_epoch = e""",
)
def chart_rows(spark, sf):
    graded = stage(gr.with_grade(joined(spark, sf)))
    threshold = gr.adaptive_threshold(graded.where(F.col("grade") == "graded")).scalar()
    return gr.chart_rows(graded, threshold).drop("feature_ts")


@query(
    "thin_series",
    f"""WITH {GRADED},
n0 AS (SELECT event_id, feature_ts, coalesce(vol_spike, 0) <> 0 AND score > 0.9 AS hit, row_number() OVER (ORDER BY feature_ts) AS i, count(*) OVER () AS n FROM j),
k AS (SELECT *, hit IS TRUE OR i = 1 OR i = n AS must FROM n0),
f AS (SELECT *, sum(CASE WHEN must THEN 0 ELSE 1 END) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) - 1 AS fi,
             sum(CAST(must AS INT)) OVER () AS m FROM k),
b AS (SELECT *, 1500 - m AS budget, (n - m) / (1500 - m)::DOUBLE AS step FROM f)
SELECT event_id FROM b WHERE must OR (budget > 0 AND ceil(fi / step) < budget AND floor(ceil(fi / step) * step) = fi)""",
)
def thin_series(spark, sf):
    rows = joined(spark, sf).withColumn("ts_us", F.unix_micros(event_time("feature_ts")))
    keep = (F.coalesce(F.col("vol_spike"), F.lit(0)) != 0) & (F.col("score") > 0.9)
    return gr.thin_rows(rows, keep, max_points=1500).select("event_id")


CLASSED = f"""{GRADED},
c AS (SELECT j.*, CASE
  WHEN written_at IS NULL THEN CASE WHEN epoch_us((SELECT max(feature_ts) FROM j)) - epoch_us(feature_ts) < {86_400_000_000 * 3}
                                    THEN 'pending' ELSE 'unavailable' END
  WHEN NOT (api_ts < written_at) OR score IS NULL OR tau IS NULL OR vol_spike IS NULL THEN 'unavailable'
  WHEN score >= tau AND vol_spike <> 0 THEN 'correct_call' WHEN score >= tau THEN 'false_alarm'
  WHEN vol_spike <> 0 THEN 'missed_spike' ELSE 'correct_quiet' END AS class FROM j)"""


def classified(spark, sf):
    rows = joined(spark, sf)
    anchor = predictions(spark, sf).agg(F.max(event_time("feature_ts"))).scalar()
    return tl.classify(rows, anchor, horizon_seconds=3 * 86_400)


@query("timeline_classes", f"WITH {CLASSED} SELECT event_id, class FROM c")
def timeline_classes(spark, sf):
    return classified(spark, sf).select("event_id", "class")


@query(
    "timeline_buckets",
    f"""WITH {CLASSED},
b AS (SELECT *, CAST(floor((epoch_us(feature_ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000) AS BIGINT) AS bucket FROM c)
SELECT bucket, arg_max(market_price, feature_ts) AS market_price, max(score) AS score,
       max(CASE WHEN score = ms AND feature_ts = mt THEN tau END) AS tau,
       count(*) FILTER (WHERE class = 'correct_call') AS correct_call, count(*) FILTER (WHERE class = 'false_alarm') AS false_alarm,
       count(*) FILTER (WHERE class = 'missed_spike') AS missed_spike, count(*) FILTER (WHERE class = 'correct_quiet') AS correct_quiet,
       count(*) FILTER (WHERE class = 'pending') AS pending, count(*) FILTER (WHERE class = 'unavailable') AS unavailable
FROM (SELECT *, min(CASE WHEN score = ms THEN feature_ts END) OVER (PARTITION BY bucket) AS mt
      FROM (SELECT *, max(score) OVER (PARTITION BY bucket) AS ms FROM b))
GROUP BY bucket""",
)
def timeline_buckets(spark, sf):
    start = F.lit("2024-01-01").cast("timestamp")
    return tl.bucket_points(classified(spark, sf), start, 21_600).drop("feature_ts")


@query(
    "point_flags",
    f"""WITH {CLASSED} SELECT event_id, class IN ('correct_call', 'false_alarm') AS predicted,
        class IN ('correct_call', 'missed_spike') AS confirmed_spike, class = 'false_alarm' AS is_false_alarm,
        class = 'missed_spike' AS is_missed_spike, class = 'pending' AS is_pending, class = 'unavailable' AS is_unavailable
        FROM c""",
)
def point_flags(spark, sf):
    return tl.point_flags(classified(spark, sf)).select(
        "event_id", "predicted", "confirmed_spike", "is_false_alarm", "is_missed_spike", "is_pending", "is_unavailable"
    )


#: Range of the assembled timelines; it holds every event, and 31 days make buckets of 3600 seconds.
MONTH = ("2024-01-01", "2024-02-01")
MONTH_BUCKET = 3600

IN_MONTH = f"""{CLASSED},
r AS (SELECT * FROM c WHERE feature_ts >= TIMESTAMP '{MONTH[0]}' AND feature_ts < TIMESTAMP '{MONTH[1]}')"""


def month_timeline(spark, sf, resolution):
    start, end = (F.lit(day).cast("timestamp") for day in MONTH)
    anchor = predictions(spark, sf).agg(F.max(event_time("feature_ts"))).scalar()
    points, bucketed, used = tl.timeline(
        joined(spark, sf), start, end, anchor, 31 * 86_400, resolution, horizon_seconds=3 * 86_400
    )
    return tl.point_flags(points).withColumn("bucketed", F.lit(bucketed)).withColumn("used", F.lit(used).cast("long"))


@query(
    "timeline_raw",
    f"""WITH {IN_MONTH} SELECT epoch_us(feature_ts) AS feature_us, feature_id, market_price, score, tau, class,
        class IN ('correct_call', 'false_alarm') AS predicted, class IN ('correct_call', 'missed_spike') AS confirmed_spike,
        class = 'false_alarm' AS is_false_alarm, class = 'missed_spike' AS is_missed_spike, class = 'pending' AS is_pending,
        class = 'unavailable' AS is_unavailable, false AS bucketed, NULL::BIGINT AS used FROM r""",
)
def timeline_raw(spark, sf):
    out = month_timeline(spark, sf, None)
    return out.withColumn("feature_us", F.unix_micros(event_time("feature_ts"))).drop("feature_ts", "api_ts")


@query(
    "timeline_auto",
    f"""WITH {IN_MONTH},
b AS (SELECT *, CAST(floor((epoch_us(feature_ts) - epoch_us(TIMESTAMP '{MONTH[0]}')) / {MONTH_BUCKET * 1_000_000}) AS BIGINT) AS bucket FROM r),
n AS (SELECT bucket, arg_max(market_price, feature_ts) AS market_price, max(score) AS score,
       max(CASE WHEN score = ms AND feature_ts = mt THEN tau END) AS tau,
       count(*) FILTER (WHERE class = 'correct_call') AS correct_call, count(*) FILTER (WHERE class = 'false_alarm') AS false_alarm,
       count(*) FILTER (WHERE class = 'missed_spike') AS missed_spike, count(*) FILTER (WHERE class = 'correct_quiet') AS correct_quiet,
       count(*) FILTER (WHERE class = 'pending') AS pending, count(*) FILTER (WHERE class = 'unavailable') AS unavailable
  FROM (SELECT *, min(CASE WHEN score = ms THEN feature_ts END) OVER (PARTITION BY bucket) AS mt
        FROM (SELECT *, max(score) OVER (PARTITION BY bucket) AS ms FROM b)) GROUP BY bucket)
SELECT epoch_us(TIMESTAMP '{MONTH[0]}') + bucket * {MONTH_BUCKET * 1_000_000} AS feature_us, *,
       correct_call + false_alarm > 0 AS predicted, correct_call + missed_spike > 0 AS confirmed_spike, false_alarm > 0 AS is_false_alarm,
       missed_spike > 0 AS is_missed_spike, pending > 0 AS is_pending, unavailable > 0 AS is_unavailable,
       true AS bucketed, {MONTH_BUCKET}::BIGINT AS used FROM n""",
)
def timeline_auto(spark, sf):
    out = month_timeline(spark, sf, "auto")
    return out.withColumn("feature_us", F.unix_micros("feature_ts")).drop("feature_ts")


# -- metrics ------------------------------------------------------------------

EPS = 2.220446049250313e-16
ALERT_HOURS = 6


def alerts_sql(cooldown_us: int, threshold: float) -> str:
    """Greedy alerts by a recursive walk over each regime's candidates."""
    return f"""cand AS (SELECT regime, ts_us, label FROM s WHERE score >= {threshold}),
walk AS (
  SELECT regime, min(ts_us) AS ts_us FROM cand GROUP BY regime
  UNION ALL
  SELECT w.regime, (SELECT min(c.ts_us) FROM cand c WHERE c.regime = w.regime AND c.ts_us >= w.ts_us + {cooldown_us}) AS ts_us
  FROM walk w WHERE w.ts_us IS NOT NULL),
hits AS (
  SELECT w.regime, count(*) AS alerts, sum(c.label)::BIGINT AS true_positive_alerts
  FROM walk w JOIN cand c ON c.regime = w.regime AND c.ts_us = w.ts_us GROUP BY w.regime),
tot AS (SELECT regime, sum(label)::BIGINT AS positives FROM s GROUP BY regime)"""


@query(
    "event_alerts",
    f"""WITH RECURSIVE {SCORED}, {alerts_sql(ALERT_HOURS * 3_600_000_000, 0.6)}
SELECT regime, alerts, true_positive_alerts, {rs('true_positive_alerts / alerts::DOUBLE')} AS precision,
       {rs('true_positive_alerts / positives::DOUBLE')} AS recall FROM hits JOIN tot USING (regime)""",
)
def event_alerts(spark, sf):
    out = mt.event_metrics(
        scored(spark, sf), 0.6, ALERT_HOURS * 3600, keys=["regime"], order=["event_id"], chunk_seconds=2 * 86_400
    )
    return out.select(
        "regime", "alerts", "true_positive_alerts", r("precision").alias("precision"), r("recall").alias("recall")
    )


@query(
    "metric_bundle",
    f"""WITH {ladder_sql()},
ranked AS (SELECT sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp) AS ap,
                  sum(fp * (ctp - tp / 2.0::DOUBLE)) / (sum(tp)::DOUBLE * sum(fp)::DOUBLE) AS auc FROM steps),
bins AS (SELECT count(*) AS n, abs(avg(score) - avg(label)) AS off FROM s
         GROUP BY {' + '.join(f'CAST(score > {i * 0.1!r} AS INT)' for i in range(1, 10))}),
base AS (SELECT avg(label) AS prev, avg((score - label) * (score - label)) AS brier,
         avg(-(label * ln(greatest({EPS}, least(score, 1 - {EPS}))) + (1 - label) * ln(1 - greatest({EPS}, least(score, 1 - {EPS}))))) AS ll,
         count(*) FILTER (WHERE score >= 0.7 AND label = 1) AS tp, count(*) FILTER (WHERE score >= 0.7) AS al, sum(label) AS pos, count(*) AS n FROM s)
SELECT n, {rs('prev')} AS prevalence, {rs('ap')} AS pr_auc, {rs('ap / prev')} AS pr_auc_lift, {rs('auc')} AS roc_auc,
       {rs('ll')} AS log_loss, {rs('brier')} AS brier, {rs('(SELECT sum(bins.n * off) / sum(bins.n) FROM bins)')} AS ece,
       {rs('tp / al::DOUBLE')} AS precision, {rs('tp / pos::DOUBLE')} AS recall,
       {rs('2 * tp / (al + pos)::DOUBLE')} AS f1
FROM base, ranked""",
)
def metric_bundle(spark, sf):
    out = mt.metric_bundle(stage(scored(spark, sf)), 0.7, with_events=False)
    names = ("prevalence", "pr_auc", "pr_auc_lift", "roc_auc", "log_loss", "brier", "ece", "precision", "recall", "f1")
    return out.select("n", *[r(n).alias(n) for n in names])


@query(
    "ece",
    f"""WITH {SCORED}, bins AS (SELECT regime, count(*) AS n, abs(avg(score) - avg(label)) AS off FROM s
         GROUP BY regime, {' + '.join(f'CAST(score > {i * 0.1!r} AS INT)' for i in range(1, 10))})
SELECT regime, {rs('sum(n * off) / sum(n)')} AS ece FROM bins GROUP BY regime""",
)
def ece(spark, sf):
    out = mt.expected_calibration_error(scored(spark, sf), keys=["regime"])
    return out.select("regime", r("ece").alias("ece"))


@query(
    "pr_curve",
    f"""WITH {ladder_sql()} SELECT score AS threshold, {rs('ctp / (ctp + cfp)::DOUBLE')} AS precision,
        {rs('ctp / (SELECT sum(tp) FROM ladder)::DOUBLE')} AS recall FROM steps""",
)
def pr_curve(spark, sf):
    out = mt.pr_curve(scored(spark, sf))
    return out.select("threshold", r("precision").alias("precision"), r("recall").alias("recall"))


@query(
    "calibration_curve",
    f"""WITH {SCORED},
e AS (SELECT {', '.join(f'quantile_cont(score, {i / 10}) AS e{i}' for i in range(1, 10))} FROM s),
b AS (SELECT score, label, CAST({' + '.join(f'CAST(score > e{i} AS INT)' for i in range(1, 10))} AS INT) AS bin FROM s, e)
SELECT bin, count(*) AS n, {rs('avg(score)')} AS mean_predicted, {rs('avg(label)')} AS fraction_positive
FROM b GROUP BY bin""",
)
def calibration_curve(spark, sf):
    out = mt.calibration_curve(stage(scored(spark, sf)))
    return out.select(
        "bin", "n", r("mean_predicted").alias("mean_predicted"), r("fraction_positive").alias("fraction_positive")
    )


@query(
    "best_f1",
    f"""WITH {ladder_sql('regime')},
t AS (SELECT regime, sum(tp) AS pos FROM ladder GROUP BY regime),
f AS (SELECT regime, score, 2 * ctp / (ctp + cfp + pos)::DOUBLE AS f1 FROM steps JOIN t USING (regime))
SELECT regime, arg_max(score, f1) AS threshold, {rs('max(f1)')} AS f1 FROM f GROUP BY regime""",
)
def best_f1(spark, sf):
    out = mt.best_f1_threshold(scored(spark, sf), keys=["regime"])
    return out.select("regime", "threshold", r("f1").alias("f1"))


def bootstrap_sql(width_us: int, resamples: int = 2000, seed: int = 42) -> str:
    """Average-precision gains of resampled blocks, the draws by the operator's arithmetic."""
    power = lambda z: f"({z} * {z} % {mt.DRAW_PRIME}) * ({z} * {z} % {mt.DRAW_PRIME}) % {mt.DRAW_PRIME} * {z}"
    rounds = "".join(
        f", z{i + 1} AS (SELECT r, n, ({power('z')} + {c}) % {mt.DRAW_PRIME} AS z FROM z{i})" for i, c in enumerate(mt.DRAW_ROUNDS)
    )
    return f"""bl AS (SELECT block, row_number() OVER (ORDER BY block) - 1 AS number, count(*) OVER () AS n FROM (SELECT DISTINCT ts_us // {width_us} AS block FROM s)),
z0 AS (SELECT r, n, (p + r * {mt.DRAW_STRIDE} + {seed}) % {mt.DRAW_PRIME} AS z FROM range({resamples}) q(r), (SELECT number AS p, n FROM bl)){rounds},
wt AS (SELECT r, z % n AS number, count(*) AS w FROM z{len(mt.DRAW_ROUNDS)} GROUP BY ALL),
sd AS (SELECT 'c' AS side, ts_us // {width_us} AS block, score, label FROM s UNION ALL SELECT 'b', ts_us // {width_us}, baseline_score, label FROM s),
ct AS (SELECT side, number, score, sum(label) AS tp, sum(1 - label) AS fp FROM sd JOIN bl USING (block) GROUP BY ALL),
dr AS (SELECT r, side, score, sum(w * tp) AS tp, sum(w * fp) AS fp FROM wt JOIN ct USING (number) GROUP BY ALL),
cu AS (SELECT *, sum(tp) OVER q AS ctp, sum(tp + fp) OVER q AS cn FROM dr WINDOW q AS (PARTITION BY r, side ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
ga AS (SELECT r, side, CASE WHEN sum(tp) > 0 THEN sum(tp * ctp / greatest(cn, 1)::DOUBLE) / sum(tp) ELSE 0 END AS ap FROM cu GROUP BY ALL),
de AS (SELECT r, sum(CASE WHEN side = 'c' THEN ap ELSE -ap END) AS delta FROM ga GROUP BY r)"""


@query(
    "block_bootstrap",
    f"""WITH {SCORED_BOTH}, {bootstrap_sql(360 * 60_000_000)}
SELECT {rs('quantile_cont(delta, 0.025)')} AS lower, {rs('avg(delta)')} AS estimate, {rs('quantile_cont(delta, 0.975)')} AS upper FROM de""",
)
def block_bootstrap(spark, sf):
    out = mt.paired_block_bootstrap(
        stage(scored(spark, sf)), "score", "baseline_score", block_minutes=360, chunks=8
    )
    return out.select(*[r(n).alias(n) for n in ("lower", "estimate", "upper")])


FOLDS = f"""{SCORED},
f AS (SELECT *, CAST(event_id % 5 AS INT) AS fold FROM s),
lad AS (SELECT fold, score, sum(label) AS tp, sum(1 - label) AS fp FROM f GROUP BY fold, score),
st AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM lad WINDOW w AS (PARTITION BY fold ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
per AS (SELECT fold, sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp) AS pr_auc, sum(tp) / sum(tp + fp)::DOUBLE AS prevalence FROM st GROUP BY fold),
err AS (SELECT fold, sum((score - label) * (score - label)) AS c, sum((0.4 - label) * (0.4 - label)) AS b FROM f GROUP BY fold)"""


def folded(spark, sf):
    return scored(spark, sf).select(
        (F.col("event_id") % 5).cast("int").alias("fold"), F.col("score").alias("prediction"),
        F.col("label").alias("target"), F.lit(0.4).alias("baseline_prediction"),
    )


@query(
    "fold_metrics",
    f"""WITH {FOLDS} SELECT {rs('avg(pr_auc)')} AS aggregate_pr_auc, count(*) FILTER (WHERE pr_auc > prevalence) AS development_folds_won,
        {rs('sum(c) / sum(b)::DOUBLE')} AS development_brier_ratio FROM per JOIN err USING (fold)""",
)
def fold_metrics(spark, sf):
    out = mt.development_metrics(mt.fold_summary(folded(spark, sf)))
    return out.select(
        r("aggregate_pr_auc").alias("aggregate_pr_auc"), "development_folds_won",
        r("development_brier_ratio").alias("development_brier_ratio"),
    )


@query(
    "paired_folds",
    f"""WITH {FOLDS} SELECT count(*) FILTER (WHERE coalesce(CASE WHEN fold <> 1 THEN pr_auc END, '-inf'::DOUBLE)
        > coalesce(CASE WHEN fold <> 2 THEN prevalence END, 'inf'::DOUBLE)) AS folds_won FROM per""",
)
def paired_folds(spark, sf):
    summary = stage(mt.fold_summary(folded(spark, sf)))
    candidate = summary.where("fold <> 1")
    baseline = summary.where("fold <> 2").select("fold", F.col("prevalence").alias("pr_auc"))
    return mt.paired_folds_won(candidate, baseline, summary)
