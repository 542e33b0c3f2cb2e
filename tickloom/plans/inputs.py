"""The generic test tables read as domain frames, and the same mapping in SQL.

`events` stands for the tick stream: its type is the product, its value the price,
its id the arrival order. Spacing is minutes, so windows are hours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import ts_micros


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registrar(queries: dict, oracles: dict):
    """Decorator factory: register a query and, where SQL can express it, its SQL twin."""

    def query(name: str, sql: str | None = None):
        def register(fn):
            queries[name] = fn
            if sql is not None:
                oracles[name] = sql
            return fn

        return register

    return query


def _nudge(digits: int) -> str:
    """Moves exact decimal ties (means of short decimals) off the rounding boundary."""
    return f"{0.1379428 * 10.0 ** -digits:.10e}"


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison with the SQL twin."""
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(float(_nudge(digits))), digits)


def rs(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"round(({expression}) + CAST('{_nudge(digits)}' AS DOUBLE), {digits})"


def codes(name: str) -> Column:
    """A list of codes as comma-separated text."""
    return F.concat_ws(",", name).alias(name)


def text(name: str) -> Column:
    """A date as ISO text."""
    return F.col(name).cast("string").alias(name)


# -- ticks --------------------------------------------------------------------


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    user, event = F.col("user_id"), F.col("event_id")
    price = F.col("value") + 0.01  # some values are 0, prices are not
    return events.select(
        F.col("event_type").alias("product_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        ts_micros("ts").alias("ts_us"),
        event.alias("arrival"),
        price.alias("price"),
        (price * (1 - F.lit(0.001) * (1 + user % 5))).alias("best_bid"),
        (price * (1 + F.lit(0.001) * (1 + event % 5))).alias("best_ask"),
        (1 + user % 10).cast("double").alias("bid_size"),
        (1 + event % 10).cast("double").alias("ask_size"),
    )


TICKS = """ticks AS (
  SELECT event_type AS product_id, ts, epoch_us(ts) AS ts_us, event_id AS arrival, value + 0.01::DOUBLE AS price,
         (value + 0.01::DOUBLE) * (1 - 0.001::DOUBLE * (1 + user_id % 5)) AS best_bid,
         (value + 0.01::DOUBLE) * (1 + 0.001::DOUBLE * (1 + event_id % 5)) AS best_ask,
         CAST(1 + user_id % 10 AS DOUBLE) AS bid_size, CAST(1 + event_id % 10 AS DOUBLE) AS ask_size
  FROM events)"""

RETURNS = (
    TICKS
    + """,
quotes AS (
  SELECT *, best_ask - best_bid AS spread_abs,
         CASE WHEN (best_bid + best_ask) / 2 > 0
              THEN (best_ask - best_bid) / ((best_bid + best_ask) / 2) * 1e4 ELSE 0 END AS spread_bps,
         CASE WHEN bid_size + ask_size > 0 THEN (bid_size - ask_size) / (bid_size + ask_size) ELSE 0 END AS imb,
         row_number() OVER p AS rn, lag(ts_us) OVER p AS prev_ts,
         CASE WHEN lag(price) OVER p > 0 THEN ln(price / lag(price) OVER p) ELSE 0 END AS ret
  FROM ticks WINDOW p AS (PARTITION BY product_id ORDER BY ts_us, arrival))"""
)


def redelivered_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with every fifth tick delivered twice."""
    base = ticks(spark, sf_dir)
    again = base.where(F.col("arrival") % 5 == 0).withColumn("arrival", F.col("arrival") + 3)
    return base.withColumn("arrival", F.col("arrival") * 10).unionByName(
        again.withColumn("arrival", F.col("arrival") * 10 + 1)
    )


REDELIVERED = (
    TICKS
    + """,
again AS (
  SELECT * REPLACE (arrival * 10 AS arrival) FROM ticks
  UNION ALL
  SELECT * REPLACE ((arrival + 3) * 10 + 1 AS arrival) FROM ticks WHERE arrival % 5 = 0)"""
)


def regressing_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream with a jump one day back at every fiftieth tick; the jumped tick stands alone."""
    day = 86_400_000_000
    return ticks(spark, sf_dir).withColumn(
        "ts_us", F.col("ts_us") - F.when(F.col("arrival") % 50 == 0, day).otherwise(0)
    )


REGRESSING = (
    TICKS
    + """,
moved AS (SELECT * REPLACE (ts_us - CASE WHEN arrival % 50 = 0 THEN 86400000000 ELSE 0 END AS ts_us) FROM ticks)"""
)


# -- predictions and outcomes -------------------------------------------------


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    e, u = F.col("event_id"), F.col("user_id")
    epoch = (F.dayofmonth("at") % 2).cast("int")
    k = F.get_json_object("props", "$.k").cast("int")
    seconds = lambda n: F.make_dt_interval(secs=n)
    return events.select(
        e.cast("string").alias("event_id"),
        (u % 4).cast("int").alias("source_partition"),
        e.alias("source_offset"),
        _iso(F.col("at")).alias("feature_ts"),
        _iso(F.col("at") + seconds((u % 90).cast("decimal(18,6)"))).alias("api_ts"),
        F.when(e % 10 == 0, "baseline").otherwise("ml").alias("model_variant"),
        F.concat(F.lit("v"), (u % 3).cast("string")).alias("model_version"),
        F.when(e % 19 != 0, k / F.lit(100.0)).alias("score"),
        (F.col("value") / 1e6).alias("vol_60s"),
        F.when(e % 13 != 0, e.cast("string")).alias("feature_id"),
        epoch.alias("stream_epoch"),
        F.when(u % 3 != 2, F.when(e % 4 == 0, 0.4).otherwise(0.6)).alias("tau"),
        F.lit("run").alias("run_id"),
        F.col("value").alias("market_price"),
        F.when(e % 17 != 0, F.concat(F.lit("boot:"), epoch.cast("string"))).alias("stream_id"),
        F.col("event_type").alias("product_id"),
    )


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One outcome per event; every seventh belongs to a feature row that nobody scored."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp"))
    e = F.col("event_id")
    epoch = (F.dayofmonth("at") % 2).cast("int")
    return events.select(
        F.when(e % 7 != 0, e.cast("string")).otherwise(F.concat(F.lit("x"), e.cast("string"))).alias("feature_id"),
        epoch.alias("stream_epoch"),
        F.col("event_type").alias("product_id"),
        _iso(F.col("at")).alias("feature_ts"),
        (F.col("value") / 2e6).alias("future_vol_60s"),
        (F.col("value") > 60).cast("int").alias("vol_spike"),
        F.lit("p85-60s-4.8e-05-v1").alias("label_schema"),
        F.concat(F.lit("boot:"), epoch.cast("string")).alias("stream_id"),
        _iso(F.col("at") + F.expr("INTERVAL 60 SECONDS")).alias("written_at"),
    )


GRADED = """p AS (
  SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id % 4 AS INT) AS source_partition,
         event_id AS source_offset, ts AS feature_ts,
         ts + to_seconds(CAST(user_id % 90 AS INT)) AS api_ts,
         CASE WHEN event_id % 10 = 0 THEN 'baseline' ELSE 'ml' END AS model_variant,
         'v' || CAST(user_id % 3 AS VARCHAR) AS model_version,
         CASE WHEN event_id % 19 <> 0 THEN CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE END AS score,
         value / 1e6 AS vol_60s,
         CASE WHEN event_id % 13 <> 0 THEN CAST(event_id AS VARCHAR) END AS feature_id,
         CAST(day(ts) % 2 AS INT) AS stream_epoch,
         CASE WHEN user_id % 3 <> 2 THEN CASE WHEN event_id % 4 = 0 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END END AS tau,
         'run' AS run_id, value AS market_price,
         CASE WHEN event_id % 17 <> 0 THEN 'boot:' || CAST(day(ts) % 2 AS VARCHAR) END AS stream_id,
         event_type AS product_id
  FROM events),
o AS (
  SELECT CASE WHEN event_id % 7 <> 0 THEN '' ELSE 'x' END || CAST(event_id AS VARCHAR) AS feature_id, ts AS feature_ts, value / 2e6 AS future_vol_60s,
         CAST(value > 60 AS INT) AS vol_spike, 'boot:' || CAST(day(ts) % 2 AS VARCHAR) AS stream_id,
         ts + INTERVAL 60 SECOND AS written_at
  FROM events),
j AS (
  SELECT p.*, o.future_vol_60s, o.vol_spike, o.written_at,
         CASE WHEN o.written_at IS NULL THEN 'unmatched' WHEN p.score IS NULL THEN 'excluded'
              WHEN p.api_ts < o.written_at THEN 'graded' ELSE 'late' END AS grade
  FROM p LEFT JOIN o ON p.feature_id = o.feature_id)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary labels with probabilities in [0, 1], keyed for grouping."""
    events = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        "event_id",
        ts_micros("ts").alias("ts_us"),
        F.col("event_type").alias("regime"),
        (((k * 7 + F.col("user_id")) % 101) / F.lit(100.0)).alias("score"),
        (((k + F.col("event_id")) % 101) / F.lit(100.0)).alias("baseline_score"),
        ((F.col("value") > 50) | ((k * 7 + F.col("user_id")) % 101 > 90)).cast("int").alias("label"),
        F.to_date(F.col("ts")).alias("day"),
    )


SCORED = """s AS (
  SELECT event_id, epoch_us(ts) AS ts_us, event_type AS regime,
         ((CAST(json_extract_string(props, '$.k') AS INT) * 7 + user_id) % 101) / 100.0::DOUBLE AS score,
         CAST(value > 50 OR (CAST(json_extract_string(props, '$.k') AS INT) * 7 + user_id) % 101 > 90 AS INT) AS label,
         CAST(ts AS DATE) AS day
  FROM events)"""

#: With the baseline's score.
SCORED_BOTH = SCORED.replace(
    " AS score,", " AS score, ((CAST(json_extract_string(props, '$.k') AS INT) + event_id) % 101) / 100.0::DOUBLE AS baseline_score,", 1
)

LADDER = """,
ladder AS (
  SELECT {keys}score, sum(label) AS tp, sum(1 - label) AS fp FROM s GROUP BY {keys}score),
steps AS (
  SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp FROM ladder
  WINDOW w AS ({partition}ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


def ladder_sql(*keys: str) -> str:
    names = "".join(f"{k}, " for k in keys)
    partition = f"PARTITION BY {', '.join(keys)} " if keys else ""
    return SCORED + LADDER.format(keys=names, partition=partition)


# -- intervals ----------------------------------------------------------------


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`[ts, ts + value minutes)` per event type."""
    start = ts_micros("ts")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("k"), "event_id", start.alias("start"),
        (start + (F.floor("value") + 1) * 60_000_000).alias("end"),
    )


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps common to every type: ten minutes after each error."""
    start = ts_micros("ts")
    rows = table(spark, sf_dir, "events").where("user_id % 10 = 3").select(
        start.alias("start"), (start + 600_000_000).alias("end")
    )
    return rows


def broken_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same intervals, every second one that is not a click ending after a minute, so that their union has holes."""
    whole = (F.col("k") == "click") | (F.col("event_id") % 2 == 0)
    return intervals(spark, sf_dir).withColumn("end", F.when(whole, F.col("end")).otherwise(F.col("start") + 60_000_000))


INTERVALS = """iv AS (
  SELECT event_type AS k, event_id, epoch_us(ts) AS s,
         epoch_us(ts) + (CAST(floor(value) AS BIGINT) + 1) * 60000000 AS e FROM events),
gaps AS (SELECT epoch_us(ts) AS gs, epoch_us(ts) + 600000000 AS ge FROM events WHERE user_id % 10 = 3)"""

#: `broken_intervals` in SQL, over `iv`.
BROKEN = "SELECT s, CASE WHEN k = 'click' OR event_id % 2 = 0 THEN e ELSE s + 60000000 END AS e FROM iv"
