"""Registered queries of the tick, identity and feature operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.exprs import book_imbalance, midprice, spread_abs, spread_bps
from tickloom.operators import features as ft
from tickloom.operators import identity as ident
from tickloom.plans.inputs import (
    REDELIVERED, REGRESSING, RETURNS, TICKS, r, redelivered_ticks, registrar, regressing_ticks, rs, ticks,
)

HOUR = 3600
W = 6 * HOUR
WINDOWS = (HOUR, W, 12 * HOUR)
THRESHOLD = 1.5
SLICE = 5 * 86400
LABEL = dict(horizon_seconds=W, slack_seconds=1800, threshold=THRESHOLD, slice_seconds=SLICE)

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)


def us(seconds: int) -> int:
    return seconds * 1_000_000


@query(
    "log_returns",
    f"WITH {RETURNS} SELECT arrival, product_id, {rs('ret', 9)} AS log_return FROM quotes",
)
def log_returns(spark, sf):
    out = ident.with_log_return(ticks(spark, sf), slice_us=us(86400))
    return out.select("arrival", "product_id", r("log_return", 9).alias("log_return"))


@query(
    "spread_features",
    f"""WITH {RETURNS} SELECT arrival, {rs('(best_bid + best_ask) / 2')} AS midprice,
        {rs('spread_abs')} AS spread_abs, {rs('spread_bps')} AS spread_bps, {rs('imb')} AS book_imbalance FROM quotes""",
)
def spread_features(spark, sf):
    return ticks(spark, sf).select(
        "arrival",
        r(midprice("best_bid", "best_ask")).alias("midprice"),
        r(spread_abs("best_bid", "best_ask")).alias("spread_abs"),
        r(spread_bps("best_bid", "best_ask")).alias("spread_bps"),
        r(book_imbalance("bid_size", "ask_size")).alias("book_imbalance"),
    )


def back(w: int, name: str) -> str:
    return f"{name} AS (PARTITION BY product_id ORDER BY ts_us RANGE BETWEEN {us(w)} PRECEDING AND CURRENT ROW)"


def core_cte(w: int = W) -> str:
    return f"""{RETURNS},
win AS (
  SELECT *, list(ret) OVER f AS rl, max(price) OVER f - min(price) OVER f AS rng, avg(spread_abs) OVER f AS sp
  FROM quotes WINDOW {back(w, 'f')}),
core AS (
  SELECT *, len(rl) AS n, coalesce(list_aggregate(rl[2:], 'stddev_pop'), 0) AS vol,
         coalesce(list_aggregate(rl[2:], 'avg'), 0) AS mean_ret
  FROM win)"""


def label_cte(h: int = W, slack: int = 1800) -> str:
    return f""",
fut AS (
  SELECT *, list(ret) OVER f AS fl, max(ts_us) OVER f AS flast, max(ts_us) OVER (PARTITION BY product_id) AS stream_end
  FROM core
  WINDOW f AS (PARTITION BY product_id ORDER BY ts_us RANGE BETWEEN CURRENT ROW AND {us(h)} FOLLOWING)),
lab AS (
  SELECT *, CASE WHEN len(fl) >= 2 AND flast >= ts_us + {us(h - slack)} AND stream_end >= ts_us + {us(h)}
                 THEN list_aggregate(fl[2:], 'stddev_pop') END AS future_vol
  FROM fut)"""


@query(
    "rolling_vol",
    f"""WITH {core_cte()} SELECT arrival, product_id, CAST(n AS BIGINT) AS n_ticks, {rs('vol')} AS vol,
        {rs('mean_ret')} AS mean_return, {rs('rng')} AS price_range FROM core""",
)
def rolling_vol(spark, sf):
    out = ft.rolling_features(ticks(spark, sf), ft.core_v1(W), label=False, slice_seconds=SLICE)
    return out.select(
        "arrival", "product_id", F.col(f"n_ticks_{W}s").alias("n_ticks"), r(f"vol_{W}s").alias("vol"),
        r(f"mean_return_{W}s").alias("mean_return"), r(f"price_range_{W}s").alias("price_range"),
    )


@query(
    "rolling_intensity",
    f"""WITH {core_cte()} SELECT arrival, {rs(f'n / {W}.0::DOUBLE', 9)} AS trade_intensity, {rs('sp')} AS spread_mean
        FROM core""",
)
def rolling_intensity(spark, sf):
    out = ft.rolling_features(ticks(spark, sf), ft.core_v1(W), label=False, slice_seconds=SLICE)
    return out.select(
        "arrival", r(f"trade_intensity_{W}s", 9).alias("trade_intensity"), r(f"spread_mean_{W}s").alias("spread_mean")
    )


@query(
    "core_features_labelled",
    f"""WITH {core_cte()}{label_cte()}
        SELECT arrival, product_id, {rs('ret')} AS log_return, {rs('spread_bps')} AS spread_bps, {rs('vol')} AS vol,
               {rs('mean_ret')} AS mean_return, {rs(f'n / {W}.0::DOUBLE', 9)} AS trade_intensity,
               CAST(n AS BIGINT) AS n_ticks, {rs('sp')} AS spread_mean, {rs('rng')} AS price_range,
               {rs('future_vol')} AS future_vol, CAST(future_vol > {THRESHOLD} AS INT) AS vol_spike
        FROM lab WHERE future_vol IS NOT NULL""",
)
def core_features_labelled(spark, sf):
    out = ft.rolling_features(ticks(spark, sf), ft.core_v1(W), labelled_only=True, **LABEL)
    return out.select(
        "arrival", "product_id", r("log_return").alias("log_return"), r("spread_bps").alias("spread_bps"),
        r(f"vol_{W}s").alias("vol"), r(f"mean_return_{W}s").alias("mean_return"),
        r(f"trade_intensity_{W}s", 9).alias("trade_intensity"), F.col(f"n_ticks_{W}s").alias("n_ticks"),
        r(f"spread_mean_{W}s").alias("spread_mean"), r(f"price_range_{W}s").alias("price_range"),
        r(f"future_vol_{W}s").alias("future_vol"), "vol_spike",
    )


@query(
    "future_vol_label",
    f"""WITH {core_cte()}{label_cte()}
        SELECT arrival, {rs('future_vol')} AS future_vol, CAST(future_vol > {THRESHOLD} AS INT) AS vol_spike FROM lab""",
)
def future_vol_label(spark, sf):
    out = ft.rolling_features(ticks(spark, sf), ft.core_v1(W), **LABEL)
    return out.select("arrival", r(f"future_vol_{W}s").alias("future_vol"), "vol_spike")


@query(
    "future_vol_drained",
    f"""WITH {core_cte()}{label_cte()}
        SELECT arrival, {rs('''CASE WHEN len(fl) >= 2 AND flast >= ts_us + %d
            THEN list_aggregate(fl[2:], 'stddev_pop') END''' % us(W - 1800))} AS future_vol FROM lab""",
)
def future_vol_drained(spark, sf):
    out = ft.rolling_features(ticks(spark, sf), ft.core_v1(W), drain_tail=True, **LABEL)
    return out.select("arrival", r(f"future_vol_{W}s").alias("future_vol"))


def _multi_sql() -> str:
    frames = ", ".join(back(w, f"f{w}") for w in WINDOWS)
    lists = ", ".join(
        f"list(ret) OVER f{w} AS r{w}, first(price) OVER f{w} AS p{w}, max(price) OVER f{w} - min(price) OVER f{w} AS g{w}, "
        f"avg(spread_bps) OVER f{w} AS s{w}, list((ts_us - prev_ts) / 1000.0::DOUBLE) OVER f{w} AS d{w}"
        for w in WINDOWS
    )
    out = ", ".join(
        f"""{rs(f'ln(price / p{w})')} AS return_{w}s,
        {rs(f"coalesce(list_aggregate(r{w}[2:], 'stddev_pop'), 0)")} AS vol_{w}s,
        {rs(f"coalesce(list_aggregate(r{w}[2:], 'avg'), 0)")} AS mean_return_{w}s,
        {rs(f'g{w} / price * 10000', 4)} AS price_range_bps_{w}s, {rs(f's{w}')} AS spread_mean_bps_{w}s,
        {rs(f'len(r{w}) / {w}.0::DOUBLE', 9)} AS trade_intensity_{w}s,
        {rs(f"coalesce(list_aggregate(d{w}[2:], 'avg'), 0)", 3)} AS interarrival_mean_ms_{w}s,
        {rs(f"CASE WHEN len(d{w}) > 2 THEN list_aggregate(d{w}[2:], 'stddev_pop') ELSE 0 END", 2)} AS interarrival_std_ms_{w}s"""
        for w in WINDOWS
    )
    return f"WITH {RETURNS}, m AS (SELECT *, {lists} FROM quotes WINDOW {frames}) SELECT arrival, {out} FROM m"


@query("multi_window", _multi_sql())
def multi_window(spark, sf):
    out = ft.rolling_features(ticks(spark, sf), ft.multi_window_v1(WINDOWS), label=False, slice_seconds=SLICE)
    digits = {"price_range_bps": 4, "trade_intensity": 9, "interarrival_mean_ms": 3, "interarrival_std_ms": 2}
    names = [n for n in ft.multi_window_v1(WINDOWS).columns if n not in ("log_return", "spread_bps")]
    return out.select("arrival", *[r(n, digits.get(n.rsplit("_", 1)[0], 6)).alias(n) for n in names])


MICRO = dict(
    windows=(W, 2 * W), imbalance=(W,), spread_change=(W,), intensity_change=(W,), momentum=(W,), vol_of_vol=W,
    acceleration=W,
)
RETENTION = 4 * W


def _micro_sql() -> str:
    frames = ", ".join(back(k * W, f"f{k}") for k in (1, 2, 3, 4))
    return f"""WITH {RETURNS},
m AS (
  SELECT *, list(ret) OVER f1 AS r1, list(ret) OVER f2 AS r2, list(ret) OVER f4 AS r4,
         first(price) OVER f1 AS p1, first(price) OVER f2 AS p2, first(price) OVER f3 AS p3,
         avg(imb) OVER f1 AS im, first(spread_bps) OVER f1 AS s1, count(*) OVER f1 AS n1, count(*) OVER f2 AS n2,
         min(rn) OVER f1 AS lo1, min(rn) OVER f4 AS lo4
  FROM quotes WINDOW {frames})
SELECT arrival, {rs('ln(price / p1)')} AS return_short, {rs('ln(price / p2)')} AS return_long,
       {rs("coalesce(list_aggregate(r1[2:], 'stddev_pop'), 0)")} AS vol_short,
       {rs("coalesce(list_aggregate(r2[2:], 'stddev_pop'), 0)")} AS vol_long,
       {rs('imb')} AS book_imbalance, {rs('im')} AS book_imbalance_mean,
       {rs('CASE WHEN n1 > 1 THEN spread_bps - s1 ELSE 0 END')} AS spread_change,
       {rs(f'n1 / {W}.0::DOUBLE - (n2 - n1) / {W}.0::DOUBLE', 9)} AS intensity_change,
       {rs('list_reduce([0.0::DOUBLE] || r4[2:], lambda a, x: 0.3::DOUBLE * abs(x) + 0.7::DOUBLE * a)')} AS ewma_vol_fast,
       {rs('list_reduce([0.0::DOUBLE] || r4[2:], lambda a, x: 0.1::DOUBLE * abs(x) + 0.9::DOUBLE * a)')} AS ewma_vol_slow,
       {rs("CASE WHEN lo1 = lo4 THEN coalesce(list_aggregate(r1[2:], 'stddev_pop'), 0) WHEN n1 < 2 THEN 0 ELSE list_aggregate(r1, 'stddev_pop') END")} AS vol_of_vol,
       {rs('ln(price / p1)')} AS momentum, {rs('ln(price / p1) - ln(p2 / p3)')} AS acceleration
FROM m"""


@query("microstructure", _micro_sql())
def microstructure(spark, sf):
    out = ft.rolling_features(
        ticks(spark, sf), ft.microstructure_v1(**MICRO), label=False, slice_seconds=SLICE, retention_seconds=RETENTION
    )
    names = {
        f"return_{W}s": "return_short", f"return_{2 * W}s": "return_long", f"vol_{W}s": "vol_short",
        f"vol_{2 * W}s": "vol_long", "book_imbalance": "book_imbalance", f"book_imbalance_mean_{W}s": "book_imbalance_mean",
        f"spread_change_{W}s": "spread_change", f"intensity_change_{W}s": "intensity_change",
        "ewma_vol_fast": "ewma_vol_fast", "ewma_vol_slow": "ewma_vol_slow", f"vol_of_vol_{W}s": "vol_of_vol",
        f"momentum_{W}s": "momentum", f"acceleration_{W}s": "acceleration",
    }
    return out.select("arrival", *[r(n, 9 if "intensity" in n else 6).alias(a) for n, a in names.items()])


@query(
    "ewma_vol",
    f"""WITH {RETURNS},
m AS (SELECT *, list(ret) OVER f4 AS r4 FROM quotes WINDOW {back(4 * W, 'f4')})
SELECT arrival, {rs('list_reduce([0.0::DOUBLE] || r4[2:], lambda a, x: 0.3::DOUBLE * abs(x) + 0.7::DOUBLE * a)')} AS fast,
       {rs('list_reduce([0.0::DOUBLE] || r4[2:], lambda a, x: 0.1::DOUBLE * abs(x) + 0.9::DOUBLE * a)')} AS slow FROM m""",
)
def ewma_vol(spark, sf):
    out = ft.rolling_features(
        ticks(spark, sf), ft.microstructure_v1(**MICRO), label=False, slice_seconds=SLICE, retention_seconds=RETENTION
    )
    return out.select("arrival", r("ewma_vol_fast").alias("fast"), r("ewma_vol_slow").alias("slow"))


@query(
    "ewma_alphas",
    f"""WITH {RETURNS},
m AS (SELECT *, list(ret) OVER f4 AS r4 FROM quotes WINDOW {back(4 * W, 'f4')})
SELECT arrival, {rs('list_reduce([0.0::DOUBLE] || r4[2:], lambda a, x: 0.95::DOUBLE * abs(x) + 0.05::DOUBLE * a)')} AS fast,
       {rs('list_reduce([0.0::DOUBLE] || r4[2:], lambda a, x: 0.01::DOUBLE * abs(x) + 0.99::DOUBLE * a)')} AS slow FROM m""",
)
def ewma_alphas(spark, sf):
    spec = ft.microstructure_v1(**MICRO, ewma_alphas=(0.95, 0.01))
    out = ft.rolling_features(ticks(spark, sf), spec, label=False, slice_seconds=SLICE, retention_seconds=RETENTION)
    return out.select("arrival", r("ewma_vol_fast").alias("fast"), r("ewma_vol_slow").alias("slow"))


@query(
    "segmented_features",
    f"""WITH {TICKS},
quotes AS (
  SELECT *, CAST(day(ts) AS INT) AS segment_id,
         CASE WHEN lag(price) OVER p > 0 THEN ln(price / lag(price) OVER p) ELSE 0 END AS ret
  FROM ticks WINDOW p AS (PARTITION BY product_id, CAST(ts AS DATE) ORDER BY ts_us, arrival)),
win AS (
  SELECT *, list(ret) OVER f AS rl FROM quotes
  WINDOW f AS (PARTITION BY product_id, segment_id ORDER BY ts_us RANGE BETWEEN {us(W)} PRECEDING AND CURRENT ROW))
SELECT arrival, product_id, segment_id, {rs('ret')} AS log_return, CAST(len(rl) AS BIGINT) AS n_ticks,
       {rs("coalesce(list_aggregate(rl[2:], 'stddev_pop'), 0)")} AS vol FROM win""",
)
def segmented_features(spark, sf):
    segmented = ticks(spark, sf).withColumn("segment_id", F.dayofmonth("ts").cast("int"))
    out = ft.rolling_features(
        segmented, ft.core_v1(W), keys=("product_id", "segment_id"), label=False, slice_seconds=SLICE
    )
    return out.select(
        "arrival", "product_id", "segment_id", r("log_return").alias("log_return"),
        F.col(f"n_ticks_{W}s").alias("n_ticks"), r(f"vol_{W}s").alias("vol"),
    )


EPOCHS = (
    REGRESSING
    + """,
steps AS (SELECT *, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY product_id ORDER BY arrival) THEN 1 ELSE 0 END AS b FROM moved),
ep AS (SELECT *, CAST(sum(b) OVER (PARTITION BY product_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stream_epoch FROM steps)"""
)


@query("epochs", f"WITH {EPOCHS} SELECT arrival, product_id, stream_epoch FROM ep")
def epochs(spark, sf):
    out = ident.with_epoch(regressing_ticks(spark, sf), chunk_rows=500)
    return out.select("arrival", "product_id", "stream_epoch")


@query(
    "tick_dedupe",
    f"""WITH {REDELIVERED} SELECT arrival, product_id, ts_us FROM again
        QUALIFY row_number() OVER (PARTITION BY product_id, ts_us, price, best_bid, best_ask ORDER BY arrival) = 1""",
)
def tick_dedupe(spark, sf):
    return ident.drop_redelivered(redelivered_ticks(spark, sf)).select("arrival", "product_id", "ts_us")


@query(
    "feature_ids",
    f"""WITH {REDELIVERED},
uniq AS (SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY product_id, ts_us, price, best_bid, best_ask ORDER BY arrival) = 1),
moved AS (SELECT *, arrival % 500 = 0 AS jump FROM again),
steps AS (SELECT *, CASE WHEN ts_us < lag(ts_us) OVER (PARTITION BY product_id ORDER BY arrival) THEN 1 ELSE 0 END AS b FROM again),
ep AS (SELECT *, sum(b) OVER (PARTITION BY product_id ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS e FROM steps),
kept AS (SELECT * FROM ep QUALIFY row_number() OVER (PARTITION BY product_id, e, ts_us, price, best_bid, best_ask ORDER BY arrival) = 1),
num AS (SELECT *, row_number() OVER (PARTITION BY product_id, e ORDER BY arrival) - 1 AS seq FROM kept)
SELECT arrival, 'boot:' || CAST(e AS VARCHAR) AS stream_id,
       product_id || ':boot:' || CAST(e AS VARCHAR) || ':' || CAST(seq AS VARCHAR) AS feature_id FROM num""",
)
def feature_ids(spark, sf):
    out = ident.with_identity(redelivered_ticks(spark, sf), "boot", chunk_rows=5000)
    return out.select("arrival", "stream_id", "feature_id")


@query(
    "duplicate_count",
    f"""WITH {REDELIVERED} SELECT product_id, count(*) AS n_rows, count(*) - count(DISTINCT ts_us) AS n_duplicates
        FROM again GROUP BY product_id""",
)
def duplicate_count(spark, sf):
    return ident.duplicate_count(redelivered_ticks(spark, sf), ["ts_us"], ["product_id"])


@query(
    "seq_gaps",
    """WITH m AS (SELECT event_id + event_id // 11 AS event_id, event_type AS session FROM events),
d AS (SELECT *, lag(event_id) OVER (PARTITION BY session ORDER BY event_id) AS prev FROM m)
SELECT session, event_id, CAST(CASE WHEN prev IS NOT NULL AND event_id <> prev + 1 THEN event_id - prev - 1 ELSE 0 END AS BIGINT) AS missing FROM d""",
)
def seq_gaps(spark, sf):
    # every eleventh number is skipped, no message is left out
    messages = ticks(spark, sf).select(
        F.col("product_id").alias("session"), (F.col("arrival") + F.expr("arrival div 11")).alias("event_id")
    )
    return ident.sequence_gaps(messages, "event_id", "event_id", "session", chunk_rows=700)


@query(
    "out_of_order",
    f"""WITH {REGRESSING}, d AS (
SELECT arrival, product_id, coalesce(ts_us < lag(ts_us) OVER (ORDER BY arrival), FALSE) AS bad FROM moved)
SELECT product_id, count(*) AS n, sum(CAST(bad AS INT))::BIGINT AS out_of_order FROM d GROUP BY product_id""",
)
def out_of_order(spark, sf):
    flagged = ident.out_of_order(regressing_ticks(spark, sf), "ts_us", chunk_rows=900)
    return flagged.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("out_of_order").alias("out_of_order")
    )


@query(
    "replay_cap",
    f"""WITH {TICKS} SELECT product_id, count(*) AS n, max(arrival) AS last_arrival FROM ticks
        WHERE ts_us <= (SELECT min(ts_us) FROM ticks) + {us(10 * 86400)} GROUP BY product_id""",
)
def replay_cap(spark, sf):
    kept = ident.retain_minutes(ticks(spark, sf), 10 * 1440)
    return kept.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.max("arrival").alias("last_arrival"))
