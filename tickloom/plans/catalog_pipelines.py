"""Registered queries of composed jobs, manifests and message projections, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.exprs import event_time
from tickloom.operators import drift, grading as gr, metrics as mt, profile as pf, quality as ql, search as se
from tickloom.operators import features as ft
from tickloom.plans import pipelines
from tickloom.plans.catalog_features import W, us
from tickloom.plans.catalog_history import HALVES, SIDES, TRIALS, books, halves, trades, trials
from tickloom.plans.inputs import GRADED, SCORED, codes, ladder_sql, outcomes, predictions, r, registrar, rs, scored, table
from tickloom.plans.lineage import stage
from tickloom.schemas import OUTCOME, PREDICTION
from tickloom.sources import manifest as mf
from tickloom.sources import ticks as src

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


@query(
    "history_features",
    f"""WITH {SIDES},
q AS (SELECT t.trade_id, t.product_id, t.segment_id, epoch_us(t.ts) AS ts_us, t.price, b.best_bid
  FROM trades t ASOF JOIN books b ON t.product_id = b.product_id AND t.segment_id = b.segment_id AND t.ts >= b.safe_at),
z AS (SELECT *, CASE WHEN lag(price) OVER p > 0 THEN ln(price / lag(price) OVER p) ELSE 0 END AS ret FROM q
  WINDOW p AS (PARTITION BY product_id, segment_id ORDER BY ts_us, trade_id)),
w AS (SELECT *, list(ret) OVER f AS rl, list(ret) OVER n AS fl, max(ts_us) OVER n AS flast,
        max(ts_us) OVER (PARTITION BY product_id, segment_id) AS stream_end FROM z
  WINDOW f AS (PARTITION BY product_id, segment_id ORDER BY ts_us RANGE BETWEEN {us(W)} PRECEDING AND CURRENT ROW),
         n AS (PARTITION BY product_id, segment_id ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {us(W)} FOLLOWING))
SELECT trade_id, {rs('ret')} AS log_return, CAST(len(rl) AS BIGINT) AS n_ticks,
       {rs("coalesce(list_aggregate(rl[2:], 'stddev_pop'), 0)")} AS vol, {rs("list_aggregate(fl[2:], 'stddev_pop')")} AS future_vol
FROM w WHERE len(fl) >= 2 AND flast >= ts_us + {us(W - 3600)} AND stream_end >= ts_us + {us(W)}""",
)
def history_features(spark, sf):
    date = lambda c: F.date_format(c, "yyyy-MM-dd")
    sold = trades(spark, sf).withColumn("source_date", date("event_time"))
    seen = books(spark, sf).withColumn("source_date", date("observed_through"))
    out = pipelines.materialize_segmented_features(
        sold, seen, [ft.core_v1(W)], strict=False, horizon_seconds=W, slack_seconds=3600, threshold=1.5,
        slice_seconds=5 * 86_400,
    )["core_v1"]
    return out.select(
        "trade_id", r("log_return").alias("log_return"), F.col(f"n_ticks_{W}s").alias("n_ticks"), r(f"vol_{W}s").alias("vol"),
        r(f"future_vol_{W}s").alias("future_vol"),
    )


@query(
    "graded_timeline_by_product",
    f"""WITH {GRADED} SELECT product_id, grade, count(*) AS n, {rs('avg(score)')} AS mean_score FROM j GROUP BY ALL""",
)
def graded_timeline_by_product(spark, sf):
    joined = gr.with_grade(gr.join_outcomes(predictions(spark, sf), outcomes(spark, sf)))
    out = joined.groupBy("product_id", "grade").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return out.withColumn("mean_score", r("mean_score"))


# -- messages -----------------------------------------------------------------


@query(
    "prediction_events",
    """SELECT 'ticks.features:' || CAST(user_id % 4 AS VARCHAR) || ':' || CAST(event_id AS VARCHAR) AS event_id,
       CAST(user_id % 4 AS INT) AS source_partition, event_id AS source_offset,
       strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS feature_ts, value AS market_price FROM events""",
)
def prediction_events(spark, sf):
    rows = table(spark, sf, "events").select(
        (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("feature_ts"), F.col("value").alias("price"),
        *[F.lit(None).cast("string").alias(c) for c in ("api_ts", "model_variant", "model_version", "feature_id", "run_id",
                                                         "stream_id", "ingest_mode", "product_id")],
        *[F.lit(0.0).alias(c) for c in ("score", "vol_60s", "spread_bps", "log_return", "trade_intensity_60s", "tau")],
        F.lit(0).alias("stream_epoch"),
    )
    out = gr.prediction_events(rows, "ticks.features")
    return out.select("event_id", "source_partition", "source_offset", "feature_ts", "market_price")


@query(
    "outcome_events",
    """SELECT CAST(event_id AS VARCHAR) AS feature_id, CAST(value > 60 AS INT) AS vol_spike, 'p85-60s-4.8e-05-v1' AS label_schema
       FROM events WHERE event_id % 3 <> 0""",
)
def outcome_events(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("feature_id"), F.lit(0).alias("stream_epoch"), F.col("event_type").alias("product_id"),
        F.col("ts").cast("string").alias("timestamp"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("future_vol_60s"),
        (F.col("value") > 60).alias("vol_spike"), F.lit("b:0").alias("stream_id"),
    )
    return gr.outcome_events(rows).select("feature_id", "vol_spike", "label_schema")


def event_log(spark, sf):
    e = F.col("event_id")
    body = F.to_json(
        F.struct(
            F.when(e % 5 != 0, e.cast("string")).otherwise("").alias("event_id"), F.col("value").alias("score"),
            F.when(e % 2 == 0, e.cast("string")).alias("feature_id"),
        )
    )
    return table(spark, sf, "events").select(e.alias("offset"), F.when(e % 7 != 0, body).otherwise("not json").alias("value"))


@query("parse_predictions", "SELECT CAST(event_id AS VARCHAR) AS event_id, value AS score FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def parse_predictions(spark, sf):
    return src.parse_events(event_log(spark, sf), PREDICTION, "event_id")[0].select("event_id", "score")


@query("parse_rejects", "SELECT event_id AS \"offset\" FROM events WHERE event_id % 5 = 0 OR event_id % 7 = 0")
def parse_rejects(spark, sf):
    return src.parse_events(event_log(spark, sf), PREDICTION, "event_id")[1].select("offset")


@query("parse_outcomes", "SELECT CAST(event_id AS VARCHAR) AS feature_id FROM events WHERE event_id % 2 = 0 AND event_id % 7 <> 0")
def parse_outcomes(spark, sf):
    return src.parse_events(event_log(spark, sf), OUTCOME, "feature_id")[0].select("feature_id")


@query("finite_rows", "SELECT event_id FROM events WHERE event_id % 7 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0")
def finite_rows(spark, sf):
    e = F.col("event_id")
    x = F.when(e % 11 == 0, float("nan")).when(e % 13 == 0, float("-inf")).otherwise(F.col("value"))
    rows = table(spark, sf, "events").select(e, F.when(e % 7 != 0, x).alias("x"), F.col("value").alias("y"))
    return ql.finite_rows(rows, ["x", "y"]).select("event_id")


@query("feature_identity", "SELECT event_id FROM events WHERE event_type <> 'click' OR user_id % 3 = 0")
def feature_identity(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("feature_set_id"),
        F.when(F.col("user_id") % 3 != 0, "1").alias("feature_schema_version"),
    )
    return ql.feature_identity_problems(rows, "click", "1").select("event_id")


@query("usable_scores", "SELECT event_id FROM events WHERE event_id % 4 <> 0 AND user_id % 5 <> 0")
def usable_scores(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 4 != 0, F.col("value")).alias("score"),
        F.when(F.col("user_id") % 5 != 0, "v1").otherwise("").alias("model_version"),
    )
    return gr.usable_scores(rows).select("event_id")


@query("model_rows", "SELECT event_id, epoch_us(ts) AS ts_us FROM events")
def model_rows(spark, sf):
    rows = table(spark, sf, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), F.lit("x").alias("feature_id"),
    )
    return src.model_rows(rows).select("event_id", F.unix_micros("ts").alias("ts_us"))


# -- manifests ----------------------------------------------------------------

@query(
    "verify_manifest",
    """WITH e AS (SELECT event_id, sha256(CAST(event_id AS VARCHAR)) AS d FROM events)
SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 6 = 0 THEN 'source_mismatch' END, CASE WHEN event_id % 5 = 0 THEN 'hour_out_of_range' END,
  CASE WHEN event_id % 7 = 0 THEN 'digest_mismatch' END, CASE WHEN event_id % 4 = 0 THEN 'receipt_disagrees' END,
  CASE WHEN event_id % 8 = 3 THEN 'file_missing' END, CASE WHEN event_id % 8 <> 3 AND event_id % 9 = 0 THEN 'checksum_mismatch' END],
  lambda x: x IS NOT NULL), ',') AS problems FROM e""",
)
def verify_manifest(spark, sf):
    e = F.col("event_id")
    digest = F.sha2(e.cast("string"), 256)
    rows = table(spark, sf, "events").select(
        e, F.lit("trades").alias("kind"), digest.alias("sha256"),
        F.concat(
            F.lit("raw/kind=trades/source="), F.when(e % 6 == 0, "other").otherwise("feed"),
            F.lit("/product=P/date=2024-01-01/hour="), F.when(e % 5 == 0, "24").otherwise("07"), F.lit("/part-"),
            F.when(e % 7 == 0, F.sha2(F.lit("x"), 256)).otherwise(digest), F.lit(".parquet"),
        ).alias("remote_path"),
    )
    entries = rows.withColumn(
        "verified_receipt",
        F.struct((e % 4 != 0).alias("success"), F.col("remote_path").alias("remote_path"), F.col("sha256").alias("sha256")),
    )
    found = entries.where("event_id % 8 <> 3").select(
        "remote_path", F.when(e % 9 == 0, F.sha2(F.lit("y"), 256)).otherwise(F.col("sha256")).alias("sha256"), "event_id"
    )
    # paths of foreign content are shared; bytes are found by path and entry here
    stored = found.withColumn("remote_path", F.concat("remote_path", F.lit("#"), e.cast("string"))).drop("event_id")
    named = entries.withColumn("stored_path", F.concat("remote_path", F.lit("#"), e.cast("string")))
    out = mf.verify_entries(named, "P", {"trades": "feed"}, stored, stored_as="stored_path")
    return out.select("event_id", codes("problems"))


def merkle_sql(name: str, rows: str, depth: int) -> str:
    """Digest tree over the JSON texts that `rows` selects as j; the root is `<name>_0`."""
    levels = [f"""{name}_h AS (SELECT h, h || ':' || count(*) AS leaf FROM (SELECT sha256(j) AS h FROM ({rows})) GROUP BY h),
{name}_{depth} AS (SELECT left(h, {depth}) AS p, sha256(string_agg(leaf, ',' ORDER BY leaf)) AS g FROM {name}_h GROUP BY 1)"""]
    for d in range(depth - 1, -1, -1):
        levels.append(f"{name}_{d} AS (SELECT left(p, {d}) AS p, sha256(string_agg(g, ',' ORDER BY p)) AS g FROM {name}_{d + 1} GROUP BY 1)")
    return ",\n".join(levels)


@query(
    "content_digest",
    f"""WITH {merkle_sql('m', "SELECT CAST(to_json({'event_id': event_id, 'event_type': event_type, 'user_id': user_id}) AS VARCHAR) AS j FROM events", 3)}
SELECT 0 AS level, '' AS prefix, g AS digest FROM m_0 UNION ALL SELECT 1, p, g FROM m_1 UNION ALL SELECT 2, p, g FROM m_2 UNION ALL SELECT 3, p, g FROM m_3""",
)
def content_digest(spark, sf):
    return mf.merkle_levels(table(spark, sf, "events"), ["event_id", "event_type", "user_id"], depth=3)


@query(
    "receipt_reconcile",
    """WITH a AS (SELECT event_type AS kind, CAST(CASE WHEN hour(ts) = 3 THEN 4 ELSE hour(ts) END AS INT) AS hour, count(*) AS n, min(user_id) AS lo FROM events GROUP BY ALL),
b AS (SELECT kind, hour, lo FROM a WHERE hour <> 5),
g AS (SELECT k AS kind, CAST(h AS INT) AS hour FROM (VALUES ('click'), ('error')) v(k), range(24) r(h)),
j AS (SELECT coalesce(g.kind, a.kind) AS kind, coalesce(g.hour, a.hour) AS hour, g.kind IS NULL AS unexpected, a.kind IS NULL AS no_a,
        b.kind IS NULL AS no_b FROM g FULL JOIN a ON g.kind = a.kind AND g.hour = a.hour LEFT JOIN b ON b.kind = coalesce(g.kind, a.kind) AND b.hour = coalesce(g.hour, a.hour)),
p AS (SELECT kind, hour, array_to_string(list_filter([CASE WHEN unexpected THEN 'unexpected_partition' END, CASE WHEN no_a THEN 'artifact_missing' END,
        CASE WHEN no_b THEN 'receipt_missing' END], lambda x: x IS NOT NULL), ',') AS problems FROM j)
SELECT kind, hour, problems FROM p WHERE problems <> ''""",
)
def receipt_reconcile(spark, sf):
    # what belongs to hour 3 is filed under hour 4, so that hour's artifact is missing
    hour = F.when(F.hour("ts") == 3, 4).otherwise(F.hour("ts"))
    rows = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("kind"), hour.alias("hour")
    ).agg(F.sha2(F.min("user_id").cast("string"), 256).alias("sha256"))
    receipts = rows.where("hour <> 5").withColumn("revision", F.substring(F.sha2(F.lit("r"), 256), 1, 40))
    return mf.reconcile_receipts(rows, receipts, ("click", "error")).withColumn("problems", codes("problems"))


@query(
    "inventory_sets",
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'left' ELSE 'right' END AS only_in FROM events WHERE event_id % 10 = 0 OR event_id % 10 = 1",
)
def inventory_sets(spark, sf):
    ids = table(spark, sf, "events").select("event_id")
    return mf.same_set(ids.where("event_id % 10 <> 1"), ids.where("event_id % 10 <> 0"))


@query(
    "raw_manifest",
    f"""WITH {merkle_sql('c', """SELECT CAST(to_json({'day_end_epoch': d + 86400, 'day_start_epoch': d, 'product_id': event_type,
  'source_date': strftime(to_timestamp(d) AT TIME ZONE 'UTC', '%Y-%m-%d')}) AS VARCHAR) AS j FROM (SELECT DISTINCT event_type, epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // 1000000 AS d FROM events)""", 1)}
SELECT count(DISTINCT event_type) AS kinds, sum(CAST(floor(value) AS BIGINT))::BIGINT AS rows, 30 * 86400 - 1000 AS missing_seconds,
       count(*) AS n_partitions, count(*) FILTER (WHERE user_id % 9 = 0) AS n_sequence_incidents,
       (SELECT count(*) FROM c_h) AS n_trade_day_completions, (SELECT g FROM c_0) AS trade_day_completions_root,
       count(*) - count(DISTINCT user_id * 10 + strlen(event_type)) >= 0 AS ok,
       (SELECT string_agg(event_type || '=' || d, ',' ORDER BY event_type) FROM (SELECT event_type, sum(user_id % 3) AS d FROM events GROUP BY 1)) AS duplicates FROM events""",
)
def raw_manifest(spark, sf):
    events = table(spark, sf, "events")
    parts = events.select(
        F.col("event_type").alias("kind"), F.floor("value").alias("rows"), F.col("event_id").cast("string").alias("remote_path"),
        F.sha2(F.col("event_id").cast("string"), 256).alias("sha256"),
    )
    doubled = events.select(F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("duplicates"))
    incidents = events.where("user_id % 9 = 0").select("event_id", F.lit("sequence_regression").alias("incident"))
    day = F.unix_seconds(F.to_date("ts").cast("timestamp"))
    done = events.select(
        F.col("event_type").alias("product_id"), F.to_date("ts").alias("source_date"), day.alias("day_start_epoch"), (day + 86_400).alias("day_end_epoch")
    ).distinct()
    row = mf.raw_manifest(parts, 1000, 30, doubled, incidents, events.where("user_id % 10 = 3").select("event_id"), done)
    pairs = F.transform("duplicate_counts", lambda k: F.concat_ws("=", k["kind"], k["duplicates"].cast("string")))
    return row.select(
        F.size("kinds").cast("bigint").alias("kinds"),
        F.aggregate("kinds", F.lit(0).cast("bigint"), lambda a, k: a + k["rows"]).alias("rows"), "missing_seconds",
        "n_partitions", "n_sequence_incidents", "n_trade_day_completions", "trade_day_completions_root",
        (F.length("partitions_root") == 64).alias("ok"), F.array_join(pairs, ",").alias("duplicates"),
    )


# -- reports ------------------------------------------------------------------


@query(
    "combine_reports",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS q, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY 1)
SELECT sum(q)::BIGINT AS qualified_seconds, min(lo) AS sequence_min, max(hi) AS sequence_max,
       array_to_string(list_sort(['qualified_seconds_below_minimum', 'crossed_bbo']), ',') AS failures, 'FAIL' AS status FROM d""",
)
def combine_reports(spark, sf):
    daily = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("qualified_seconds"), F.lit(86_400).alias("calendar_span_seconds"),
        F.lit(0).alias("duplicate_count"), F.min("ts").alias("first_event"), F.max("ts").alias("last_event"),
        F.min("event_id").alias("sequence_min"), F.max("event_id").alias("sequence_max"),
        F.array(F.lit("crossed_bbo")).alias("failures"),
    )
    out = ql.combine_reports(daily, minimum_seconds=10**9)
    return out.select("qualified_seconds", "sequence_min", "sequence_max", codes("failures"), "status")


@query(
    "completion_days",
    """SELECT strftime(day, '%Y-%m-%d') AS source_date, day(day) % 3 <> 0 AND day(day) % 5 <> 0 AND n >= 0 AS valid
       FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)""",
)
def completion_days(spark, sf):
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("trade_count"))
    start = F.unix_seconds(F.col("d").cast("timestamp"))
    rows = days.select(
        F.lit("P").alias("product_id"), F.col("d").cast("string").alias("source_date"), start.alias("day_start_epoch"),
        (start + F.when(F.dayofmonth("d") % 5 == 0, 1).otherwise(86_400)).alias("day_end_epoch"),
        (F.dayofmonth("d") % 3 != 0).alias("trade_pages_complete"), "trade_count",
    )
    return ql.completion_evidence(rows).select("source_date", "valid")


@query(
    "partition_evidence",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 4 = 0 THEN 'partition_unverified' END AS problem FROM events""",
)
def partition_evidence(spark, sf):
    e = F.col("event_id")
    digest = F.when(e % 3 == 0, "zz").otherwise(F.sha2(e.cast("string"), 256))
    rows = table(spark, sf, "events").select(e, digest.alias("sha256"), e.cast("string").alias("remote_path"))
    receipt = F.struct(
        F.lit(True).alias("success"), F.col("remote_path").alias("remote_path"), F.col("sha256").alias("sha256"),
        F.when(e % 4 == 0, "short").otherwise(F.substring(F.sha2(F.lit("r"), 256), 1, 40)).alias("revision"),
    )
    return ql.partition_evidence(rows.withColumn("verified_receipt", receipt)).select("event_id", "problem")


@query(
    "drift_report",
    f"""WITH {HALVES},
l AS (SELECT 'value' AS feature, value AS v, ref FROM h UNION ALL SELECT 'user_id', user_id, ref FROM h),
t AS (SELECT feature, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS nc, stddev_pop(v) FILTER (ref) AS dev FROM l GROUP BY feature),
s AS (SELECT feature, v, count(*) FILTER (WHERE ref) AS a, count(*) FILTER (WHERE NOT ref) AS c FROM l GROUP BY feature, v),
w AS (SELECT *, sum(a) OVER p AS cr, sum(c) OVER p AS cc, lead(v) OVER (PARTITION BY feature ORDER BY v) - v AS step
  FROM s WINDOW p AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING)),
d AS (SELECT sum(abs(cr / nr::DOUBLE - cc / nc::DOUBLE) * step) / greatest(any_value(dev), 0.001) AS score FROM w JOIN t USING (feature) GROUP BY feature),
p AS (SELECT hit, count(*) FILTER (WHERE ref) / (SELECT count(*) FILTER (WHERE ref) FROM h)::DOUBLE AS p, count(*) FILTER (WHERE NOT ref) / (SELECT count(*) FILTER (WHERE NOT ref) FROM h)::DOUBLE AS q FROM h GROUP BY hit),
a AS (SELECT score FROM d UNION ALL SELECT sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) FROM p)
SELECT count(*) FILTER (WHERE score >= 0.01) AS drifted_columns, count(*) AS columns, {rs('count(*) FILTER (WHERE score >= 0.01) / count(*)::DOUBLE')} AS drift_share,
       count(*) FILTER (WHERE score >= 0.01) / count(*)::DOUBLE >= 0.5 AS dataset_drift FROM a""",
)
def drift_report(spark, sf):
    out = drift.drift_share(drift.drift_report(*halves(spark, sf), ["value", "user_id"], "hit", limit=0.01))
    return out.withColumn("drift_share", r("drift_share"))


@query(
    "retrain_triggers",
    f"""WITH {ladder_sql()}, {HALVES},
p AS (SELECT hit, count(*) FILTER (WHERE ref) / (SELECT count(*) FILTER (WHERE ref) FROM h)::DOUBLE AS p, count(*) FILTER (WHERE NOT ref) / (SELECT count(*) FILTER (WHERE NOT ref) FROM h)::DOUBLE AS q FROM h GROUP BY hit),
d AS (SELECT sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0)) AS js FROM p),
a AS (SELECT sum(tp * ctp / (ctp + cfp)::DOUBLE) / sum(tp) AS ap FROM steps)
SELECT array_to_string(list_filter([CASE WHEN js > 0.15 THEN 'target_drift' END, CASE WHEN ap < 0.9 THEN 'average_precision_below_floor' END], lambda x: x IS NOT NULL), ',') AS reasons,
       js > 0.15 OR ap < 0.9 AS retrain FROM d, a""",
)
def retrain_triggers(spark, sf):
    js = drift.jensen_shannon(*halves(spark, sf), "hit")
    out = mt.retrain_triggers(js, mt.average_precision(scored(spark, sf)), ap_floor=0.9)
    return out.select(codes("reasons"), "retrain")


@query(
    "rolling_triggers",
    f"""WITH {SCORED},
e AS (SELECT DISTINCT day AS de FROM s),
w AS (SELECT de, score, sum(label) AS tp, sum(1 - label) AS fp FROM s JOIN e ON s.day <= de AND s.day > de - INTERVAL 7 DAY GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER q AS ctp, sum(tp + fp) OVER q AS cn FROM w WINDOW q AS (PARTITION BY de ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT de, sum(tp + fp)::BIGINT AS n, sum(tp * ctp / cn::DOUBLE) / sum(tp) AS ap, sum(tp) / sum(tp + fp)::DOUBLE AS q,
             (SELECT avg(label) FROM s) AS p FROM c GROUP BY de),
j AS (SELECT *, sqrt(greatest((p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q)) + (1 - p) * ln(2 * (1 - p) / (2 - p - q)) + (1 - q) * ln(2 * (1 - q) / (2 - p - q))) / 2, 0)) AS js FROM a)
SELECT CAST(de AS VARCHAR) AS day, n, {rs('ap')} AS average_precision, {rs('js')} AS js_distance,
       array_to_string(list_filter([CASE WHEN js > 0.005 THEN 'target_drift' END, CASE WHEN ap < 0.62 THEN 'average_precision_below_floor' END], lambda x: x IS NOT NULL), ',') AS reasons,
       js > 0.005 OR ap < 0.62 AS retrain FROM j""",
)
def rolling_triggers(spark, sf):
    rows = scored(spark, sf)
    out = mt.rolling_triggers(rows, rows, js_limit=0.005, ap_floor=0.62)
    return out.select(
        F.col("day").cast("string").alias("day"), "n", r("average_precision").alias("average_precision"), r("js_distance").alias("js_distance"),
        codes("reasons"), "retrain",
    )


@query(
    "high_correlations",
    """WITH q AS (SELECT value AS x, value * 2 + user_id AS y, CAST(event_id % 7 AS DOUBLE) AS w FROM events),
c AS (SELECT 'x' AS a, 'y' AS b, corr(x, y) AS r FROM q UNION ALL SELECT 'x', 'w', corr(x, w) FROM q UNION ALL SELECT 'y', 'w', corr(y, w) FROM q)
SELECT a, b FROM c WHERE abs(r) > 0.85""",
)
def high_correlations(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("value").alias("x"), (F.col("value") * 2 + F.col("user_id")).alias("y"), (F.col("event_id") % 7).cast("double").alias("w")
    )
    return pf.high_correlations(pf.correlations(rows, ["x", "y", "w"])).select("a", "b")


@query(
    "neural_eligibility",
    f"""WITH {SCORED}, {TRIALS},
s1 AS (SELECT ap, row_number() OVER (ORDER BY trial_id) - 1 AS i, count(*) OVER () AS n FROM t WHERE stage = 'click' AND outcome = 'finished'),
h1 AS (SELECT count(*) AS scored, coalesce(max(CASE WHEN i >= n // 2 THEN ap END) - max(CASE WHEN i < n // 2 THEN ap END) <= 0.001, FALSE) AS level FROM s1),
p1 AS (SELECT min(positives) AS fewest FROM (SELECT sum(label) AS positives FROM s GROUP BY event_id % 2))
SELECT array_to_string(list_filter([CASE WHEN (SELECT count(*) FROM s) < 100000 THEN 'too_few_labelled_rows' END,
  CASE WHEN fewest < 100 THEN 'too_few_positives_in_a_fold' END, CASE WHEN scored < 10 THEN 'too_few_tree_trials' END,
  CASE WHEN NOT (scored >= 10 AND level) THEN 'no_plateau' END], lambda x: x IS NOT NULL), ',') AS reasons FROM h1, p1""",
)
def neural_eligibility(spark, sf):
    rows = scored(spark, sf)
    run = trials(spark, sf).withColumn("stage", F.when(F.col("stage") == "click", "trees").otherwise(F.col("stage")))
    positives = rows.groupBy((F.col("event_id") % 2).alias("fold")).agg(F.sum("label").alias("positives"))
    n = rows.agg(F.count(F.lit(1))).scalar()
    return se.neural_eligibility(se.stage_gates(run), positives, n, ["trees", "ablation"]).select(codes("reasons"))


@query("derive_evidence")
def derive_evidence(spark, sf):
    rows = stage(scored(spark, sf).withColumnRenamed("score", "candidate_score"))
    won = spark.range(1).select(F.lit(4).alias("folds_won"))
    out = se.derive_evidence(
        rows, rows, won, 0.6, {"p95_latency_ms": 5.0, "deployable": True, "parity_passed": True},
        ("candidate_score",), block_minutes=1440,
    )
    return se.qualify(out).select("folds_won", "quote_trade_coverage", "passed", codes("reasons"))


@query(
    "raw_timeline",
    f"""WITH {GRADED} SELECT feature_id, market_price, score, tau FROM p WHERE feature_ts >= TIMESTAMP '2024-01-10' AND feature_ts < TIMESTAMP '2024-01-11'""",
)
def raw_timeline(spark, sf):
    from tickloom.operators import timeline as tl

    joined = gr.join_outcomes(predictions(spark, sf), outcomes(spark, sf))
    at = lambda d: F.lit(d).cast("timestamp")
    seen = event_time("feature_ts")
    rows = joined.where((seen >= at("2024-01-10")) & (seen < at("2024-01-11")))
    return tl.raw_points(tl.classify(rows, at("2024-01-11"))).select("feature_id", "market_price", "score", "tau")

