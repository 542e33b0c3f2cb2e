"""Registered queries of joins, intervals, books, audits, profiles, drift, splits and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.exprs import MICROS, normalize_ts, ts_micros
from tickloom.operators import asof, book, drift, intervals as iv, profile as pf, quality as ql, search as se, splits as sp
from tickloom.plans import models as ml
from tickloom.plans.inputs import (
    BROKEN, INTERVALS, SCORED, TICKS, broken_intervals, codes, gaps, intervals, r, registrar, rs, scored, table, text, ticks,
)
from tickloom.plans.lineage import stage
from tickloom.sources import manifest as mf
from tickloom.sources import tables as tb
from tickloom.sources import ticks as src

QUERIES: dict = {}
ORACLES: dict = {}
query = registrar(QUERIES, ORACLES)

DAY = 86_400 * MICROS
CHUNK = 5 * DAY

# -- trades and books ---------------------------------------------------------


def trades(spark, sf):
    return ticks(spark, sf).where("arrival % 3 <> 0").select(
        "product_id", F.col("arrival").cast("string").alias("trade_id"), F.col("ts").alias("event_time"), "price",
        F.col("bid_size").alias("size"), F.lit("buy").alias("reported_side"),
        F.dayofmonth("ts").cast("bigint").alias("segment_id"),
    )


def books(spark, sf):
    rows = ticks(spark, sf).where("arrival % 3 = 0").withColumn("sec", F.date_trunc("second", "ts"))
    last = rows.groupBy("product_id", "sec").agg(
        F.max_by(F.struct("best_bid", "bid_size", "best_ask", "ask_size", "arrival"), "arrival").alias("b")
    )
    return last.select(
        "product_id", F.col("sec").alias("observed_through"), "b.*", F.dayofmonth("sec").cast("bigint").alias("segment_id")
    )


SIDES = f"""{TICKS},
trades AS (SELECT product_id, CAST(arrival AS VARCHAR) AS trade_id, ts, CAST(day(ts) AS BIGINT) AS segment_id, price
  FROM ticks WHERE arrival % 3 <> 0),
books AS (SELECT product_id, date_trunc('second', ts) AS seen, date_trunc('second', ts) + INTERVAL 1 SECOND AS safe_at,
    CAST(day(ts) AS BIGINT) AS segment_id, arg_max(best_bid, arrival) AS best_bid, arg_max(ask_size, arrival) AS ask_size
  FROM ticks WHERE arrival % 3 = 0 GROUP BY ALL)"""


@query(
    "asof_join",
    f"""WITH {SIDES} SELECT t.trade_id, {rs('best_bid')} AS best_bid, ask_size, epoch_us(seen) AS seen_us, t.segment_id
        FROM trades t ASOF JOIN books b ON t.product_id = b.product_id AND t.segment_id = b.segment_id AND t.ts >= b.safe_at""",
)
def asof_join(spark, sf):
    out = asof.join_trades_to_books(trades(spark, sf), books(spark, sf), chunk_us=DAY)
    return out.select(
        "trade_id", r("best_bid").alias("best_bid"), "ask_size", ts_micros("book_observed_through").alias("seen_us"),
        "segment_id",
    )


@query(
    "segment_infer",
    f"""WITH {TICKS}, books AS (SELECT product_id, date_trunc('minute', ts) + INTERVAL 1 SECOND AS safe_at,
        CAST(min(day(ts)) AS BIGINT) AS segment_id FROM ticks WHERE arrival % 3 = 0 GROUP BY ALL)
        SELECT CAST(arrival AS VARCHAR) AS trade_id, segment_id FROM ticks t JOIN books b
        ON t.product_id = b.product_id AND date_trunc('minute', t.ts) + INTERVAL 1 SECOND = b.safe_at WHERE arrival % 3 <> 0""",
)
def segment_infer(spark, sf):
    minute = F.date_trunc("minute", "event_time")
    left = trades(spark, sf).drop("segment_id").withColumn("event_time", minute + F.expr("INTERVAL 1 SECOND"))
    seen = ticks(spark, sf).where("arrival % 3 = 0").select(
        "product_id", F.date_trunc("minute", "ts").alias("observed_through"),
        F.dayofmonth("ts").cast("bigint").alias("segment_id"),
    )
    return asof.infer_segments(left, seen).select("trade_id", "segment_id")


@query(
    "asof_orders",
    """WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
c AS (SELECT l_orderkey, l_linenumber, o_custkey, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT c.l_orderkey, c.l_linenumber, o.o_orderkey AS last_order
FROM c ASOF LEFT JOIN o ON c.o_custkey = o.o_custkey AND CAST(c.l_shipdate AS DATE) >= CAST(o.o_orderdate AS DATE)""",
)
def asof_orders(spark, sf):
    from tickloom.functions import scan

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    left = lines.join(orders.drop("o_orderdate"), lines.l_orderkey == orders.o_orderkey).drop("o_orderkey")
    days = lambda c: F.unix_date(F.col(c).cast("date"))
    out = scan.asof_backward(
        left, orders, ["o_custkey"], days("l_shipdate"), days("o_orderdate"), {"last_order": F.col("o_orderkey")},
        chunk_width=400, right_tie=F.col("o_orderkey"),
    )
    return out.select("l_orderkey", "l_linenumber", "last_order")


# -- intervals ----------------------------------------------------------------

UNION = f"""{INTERVALS},
r0 AS (SELECT k, s, e, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
r1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM r0),
merged AS (SELECT k, min(s) AS s, max(e) AS e FROM r1 GROUP BY k, isl),
g0 AS (SELECT gs, ge, max(ge) OVER (ORDER BY gs, ge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gaps),
g1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR gs > reach THEN 1 ELSE 0 END) OVER (ORDER BY gs, ge ROWS UNBOUNDED PRECEDING) AS isl FROM g0),
mg AS (SELECT min(gs) AS gs, max(ge) AS ge FROM g1 GROUP BY isl)"""

SUBTRACT = f"""{UNION},
allm0 AS (SELECT s, e, max(e) OVER (ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ({BROKEN})),
allm1 AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM allm0),
base AS (SELECT min(s) AS s, max(e) AS e FROM allm1 GROUP BY isl),
edges AS (SELECT s AS t, 1 AS b, 0 AS c FROM base UNION ALL SELECT e, -1, 0 FROM base
          UNION ALL SELECT gs, 0, 1 FROM mg UNION ALL SELECT ge, 0, -1 FROM mg),
per AS (SELECT t, sum(b) AS b, sum(c) AS c FROM edges GROUP BY t),
sw AS (SELECT t, sum(b) OVER (ORDER BY t) AS b, sum(c) OVER (ORDER BY t) AS c, lead(t) OVER (ORDER BY t) AS u FROM per),
pieces AS (SELECT t AS s, u AS e FROM sw WHERE b > 0 AND c = 0 AND u IS NOT NULL)"""


@query("interval_union", f"WITH {UNION} SELECT k, s AS start, e AS \"end\" FROM merged")
def interval_union(spark, sf):
    return iv.interval_union(intervals(spark, sf), ["k"], chunk_us=CHUNK)


def pieces(spark, sf):
    base = broken_intervals(spark, sf).select("start", "end")
    return iv.interval_subtract(base, gaps(spark, sf), chunk_us=CHUNK)


@query("interval_subtract", f"WITH {SUBTRACT} SELECT s AS start, e AS \"end\" FROM pieces")
def interval_subtract(spark, sf):
    return pieces(spark, sf)


@query(
    "covered_by_day",
    f"""WITH {SUBTRACT},
d AS (SELECT unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) AS dn, s, e FROM pieces)
SELECT CAST(CAST(DATE '1970-01-01' + CAST(dn AS INT) AS DATE) AS VARCHAR) AS day, sum((least(e, (dn + 1) * {DAY}) - greatest(s, dn * {DAY})) // 1000000)::BIGINT AS seconds
FROM d GROUP BY dn""",
)
def covered_by_day(spark, sf):
    out = iv.split_by_day(pieces(spark, sf)).groupBy("day").agg(iv.covered_seconds().alias("seconds"))
    return out.withColumn("day", text("day"))


@query(
    "interval_overlap",
    f"""WITH {INTERVALS} SELECT event_id, EXISTS (SELECT 1 FROM gaps WHERE iv.s < ge AND gs < iv.e) AS overlaps FROM iv""",
)
def interval_overlap(spark, sf):
    return iv.flag_overlap(intervals(spark, sf), gaps(spark, sf), chunk_us=CHUNK).select("event_id", "overlaps")


@query(
    "point_in_gap",
    f"""WITH {INTERVALS} SELECT event_id FROM iv WHERE NOT EXISTS (SELECT 1 FROM gaps WHERE gs <= iv.s AND iv.s < ge)""",
)
def point_in_gap(spark, sf):
    flagged = iv.flag_inside(intervals(spark, sf), gaps(spark, sf), at="start", chunk_us=CHUNK)
    return flagged.where(~F.col("inside")).select("event_id")


@query(
    "islands",
    f"""WITH h AS (SELECT DISTINCT event_type AS k, epoch_us(date_trunc('hour', ts)) AS t FROM events),
g AS (SELECT *, t - row_number() OVER (PARTITION BY k ORDER BY t) * 3600000000 AS isl FROM h)
SELECT k, min(t) AS start, max(t) + 3600000000 AS "end" FROM g GROUP BY k, isl""",
)
def islands(spark, sf):
    hours = table(spark, sf, "events").select(
        F.col("event_type").alias("k"), ts_micros(F.date_trunc("hour", "ts")).alias("ts_us")
    )
    return iv.continuity_islands(hours, ["k"], step_us=3600 * MICROS, chunk_us=CHUNK)


@query(
    "label_bands",
    f"""WITH b AS (SELECT event_type AS k, epoch_us(ts) AS t, value > 60 AS hit,
          lag(epoch_us(ts)) OVER p AS prev, lag(value > 60) OVER p AS was
        FROM events WINDOW p AS (PARTITION BY event_type ORDER BY ts)),
med AS (SELECT k, list_sort(list(t - prev) FILTER (t > prev)) AS l FROM b GROUP BY k),
half AS (SELECT k, l[CAST(len(l) // 2 AS BIGINT) + 1] / 2.0::DOUBLE AS h FROM med),
g AS (SELECT *, sum(CASE WHEN hit AND NOT coalesce(was, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY t ROWS UNBOUNDED PRECEDING) AS isl FROM b),
s AS (SELECT k, min(t) AS x1, max(t) AS x2 FROM g WHERE hit GROUP BY k, isl)
SELECT k, x1 - CASE WHEN x1 = x2 THEN h ELSE 0 END AS x1, x2 + CASE WHEN x1 = x2 THEN h ELSE 0 END AS x2 FROM s JOIN half USING (k)""",
)
def label_bands(spark, sf):
    rows = intervals(spark, sf).select("k", F.col("start").alias("ts_us"), "event_id").join(
        table(spark, sf, "events").select("event_id", (F.col("value") > 60).alias("hit")), "event_id"
    )
    out = iv.true_bands(rows, "hit", keys=["k"], order=["ts_us", "event_id"], chunk_us=CHUNK)
    return out.select("k", F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"))


# -- book ---------------------------------------------------------------------

SIDE_PRICE = "CASE WHEN event_id % 2 = 0 THEN 100 - user_id % 4 ELSE 200 + user_id % 4 END"
QUANTITY = "CASE WHEN user_id % 4 <> 0 AND event_id % 5 = 0 THEN 0 ELSE 1 + event_id % 7 END"


def book_source(spark, sf):
    """One product per day: an anchor at midnight and at noon, a gap from 10 to 11, one change per event.

    The levels 100 and 200 never vanish, so the stated best prices are constant.
    """
    dec = lambda e: F.expr(f"CAST({e} AS DECIMAL(18,8))")
    events = table(spark, sf, "events").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    dated = F.date_format("at", "yyyy-MM-dd")
    deltas = events.select(
        F.lit("P").alias("product_id"), dated.alias("source_date"), F.col("at").alias("changed_second"),
        (F.col("event_id") * 2 + 1000).alias("source_sequence_num_start"),
        (F.col("event_id") * 2 + 1000).alias("source_sequence_num_end"),
        dec("100").alias("best_bid"), dec("200").alias("best_ask"),
        F.array(
            F.struct(
                F.when(F.col("event_id") % 2 == 0, "bid").otherwise("offer").alias("side"),
                dec(SIDE_PRICE).alias("price"), dec(QUANTITY).alias("quantity"),
            )
        ).alias("changes"),
    )
    days = deltas.select("product_id", "source_date").distinct()
    midnight = F.col("source_date").cast("timestamp")
    first = events.groupBy(dated.alias("source_date"), (F.hour("at") >= 12).alias("pm")).agg(
        (F.min("event_id") * 2 + 999).alias("source_sequence_num")
    )
    anchors = first.select(
        F.lit("P").alias("product_id"), "source_date",
        F.when(F.col("pm"), midnight + F.expr("INTERVAL 12 HOURS")).otherwise(midnight).alias("anchor_second"),
        "source_sequence_num", dec("100").alias("best_bid"), dec("200").alias("best_ask"),
        F.create_map(dec("100"), dec("5"), dec("90"), dec("1")).alias("bid_book"),
        F.create_map(dec("200"), dec("6")).alias("ask_book"),
    )
    gap = days.select(
        "product_id", "source_date", (midnight + F.expr("INTERVAL 10 HOURS")).alias("window_start"),
        (midnight + F.expr("INTERVAL 11 HOURS")).alias("window_end"), F.lit("gap").alias("status"),
        F.lit(0).alias("gap_count"),
    )
    bounds = days.select(
        "product_id", "source_date", midnight.alias("day_start"),
        (midnight + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")).alias("day_end"),
    )
    return anchors, deltas, gap, bounds


# seconds from each change (or anchor) until the next one of the half day, per best level
BOOK_SQL = f"""ev AS (
  SELECT CAST(ts AS DATE) AS d, date_trunc('second', ts) AS tm, event_id * 2 + 1000 AS seq, event_id % 2 = 0 AS bid,
         {SIDE_PRICE} AS price, {QUANTITY} AS qty, hour(ts) AS h FROM events),
halves AS (SELECT DISTINCT d, h >= 12 AS pm FROM ev),
anc AS (SELECT d, pm, CAST(d AS TIMESTAMP) + CASE WHEN pm THEN INTERVAL 12 HOUR ELSE INTERVAL 0 HOUR END AS tm FROM halves),
ch AS (
  SELECT d, pm, tm, -1 AS seq, 5 AS bq, 6 AS aq FROM anc
  UNION ALL
  SELECT d, h >= 12, tm, seq, CASE WHEN bid AND price = 100 THEN qty END, CASE WHEN NOT bid AND price = 200 THEN qty END
  FROM ev WHERE h <> 10 AND h <> 11 AND NOT (tm = CAST(d AS TIMESTAMP))),
st AS (
  SELECT d, pm, tm, seq, last_value(bq IGNORE NULLS) OVER w AS bq, last_value(aq IGNORE NULLS) OVER w AS aq
  FROM ch WINDOW w AS (PARTITION BY d, pm ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT d, pm, tm, arg_max(bq, seq) AS bq, arg_max(aq, seq) AS aq FROM st GROUP BY ALL),
dur AS (
  SELECT *, epoch_us(coalesce(lead(tm) OVER (PARTITION BY d, pm ORDER BY tm),
           CAST(d AS TIMESTAMP) + CASE WHEN pm THEN INTERVAL 24 HOUR ELSE INTERVAL 10 HOUR END)) // 1000000 - epoch_us(tm) // 1000000 AS n
  FROM sec)"""


@query(
    "book_replay",
    f"""WITH {BOOK_SQL} SELECT strftime(d, '%Y-%m-%d') AS source_date, CASE WHEN pm THEN 1 ELSE 0 END::BIGINT AS segment_id,
        sum(n)::BIGINT AS states, sum(n * bq)::BIGINT AS bid_size_seconds, sum(n * aq)::BIGINT AS ask_size_seconds
        FROM dur GROUP BY ALL""",
)
def book_replay(spark, sf):
    states = book.replay_book(*book_source(spark, sf))
    return states.groupBy("source_date", "segment_id").agg(
        F.count(F.lit(1)).alias("states"),
        F.sum("bid_size").cast("bigint").alias("bid_size_seconds"),
        F.sum("ask_size").cast("bigint").alias("ask_size_seconds"),
    )


@query(
    "book_state_intervals",
    f"""WITH {BOOK_SQL} SELECT strftime(d, '%Y-%m-%d') AS source_date, CASE WHEN pm THEN 1 ELSE 0 END::BIGINT AS segment_id,
        epoch_us(min(tm)) AS start, epoch_us(min(tm)) + sum(n)::BIGINT * 1000000 AS "end" FROM dur GROUP BY ALL""",
)
def book_state_intervals(spark, sf):
    states = stage(book.replay_book(*book_source(spark, sf)).select("product_id", "source_date", "segment_id", "observed_through"))
    return book.state_intervals(states).drop("product_id")


@query(
    "gap_windows",
    """SELECT event_id FROM events WHERE event_type IN ('error', 'gap') OR user_id % 10 = 0""",
)
def gap_windows(spark, sf):
    meta = table(spark, sf, "events").select(
        "event_id", F.upper("event_type").alias("status"),
        F.when(F.col("user_id") % 10 == 0, 1).otherwise(0).alias("gap_count"),
    )
    return meta.where(book.unusable_window()).select("event_id")


@query(
    "delta_state",
    f"""WITH {SIDES}, b2 AS (SELECT product_id, seen, ask_size FROM books)
SELECT CAST(t.arrival AS VARCHAR) AS id, b2.ask_size FROM ticks t LEFT JOIN b2
ON t.product_id = b2.product_id AND date_trunc('second', t.ts) = b2.seen""",
)
def delta_state(spark, sf):
    deltas = ticks(spark, sf).select(
        F.col("arrival").cast("string").alias("id"), "product_id", F.date_trunc("second", "ts").alias("changed_second")
    )
    return asof.attach_state(deltas, books(spark, sf)).select("id", "ask_size")


# -- contracts and audit ------------------------------------------------------


@query(
    "contract_violations",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN event_id % 7 = 0 THEN 'sequence_regressed' END,
         CASE WHEN user_id % 9 = 0 THEN 'crossed_book' END, CASE WHEN value < 5 THEN 'negative_size' END,
         CASE WHEN event_id % 11 = 0 THEN 'negative_segment' END], lambda x: x IS NOT NULL), ',') AS violations
       FROM events WHERE event_id % 7 = 0 OR user_id % 9 = 0 OR value < 5 OR event_id % 11 = 0""",
)
def contract_violations(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    states = table(spark, sf, "events").select(
        "event_id", F.col("ts").alias("observed_through"),
        F.when(e % 7 == 0, 2).otherwise(1).alias("sequence_start"), F.lit(1).alias("sequence_end"),
        F.when(u % 9 == 0, 11.0).otherwise(9.0).alias("best_bid"), F.lit(10.0).alias("best_ask"),
        (F.col("value") - 5).alias("bid_size"), F.lit(1.0).alias("ask_size"),
        F.when(e % 11 == 0, -1).otherwise(0).alias("segment_id"),
    )
    return ql.rejected(states, ql.book_violations()).select("event_id", codes("violations"))


AUDIT_MIN = 20 * 86_400


def audit(spark, sf):
    stamp = lambda c: F.timestamp_micros(c)
    span = lambda df: df.select(stamp("start").alias("start"), stamp("end").alias("end"))
    base = broken_intervals(spark, sf)
    rows = ticks(spark, sf)
    sold = rows.where("arrival % 3 <> 0").select(
        "arrival", F.col("ts").alias("event_time"),
        F.when(F.col("arrival") % 1009 == 2, F.lit("1")).otherwise(F.col("arrival").cast("string")).alias("trade_id"),
        "price", F.col("bid_size").alias("size"),
    )
    states = rows.where("arrival % 3 = 0").select(
        "arrival", F.col("ts").alias("observed_through"),
        F.when(F.col("arrival") % 999 == 0, F.col("best_ask") + 1).otherwise(F.col("best_bid")).alias("best_bid"),
        "best_ask", F.col("arrival").alias("sequence_start"), (F.col("arrival") + 1).alias("sequence_end"),
    )
    joined = asof.join_trades_to_books(trades(spark, sf), books(spark, sf), strict=False, chunk_us=DAY)
    done = rows.select(F.date_format("ts", "yyyy-MM-dd").alias("source_date")).distinct().select(
        F.lit("P").alias("product_id"), "source_date",
        F.unix_seconds(F.col("source_date").cast("timestamp")).alias("day_start_epoch"),
        (F.unix_seconds(F.col("source_date").cast("timestamp")) + 86_400).alias("day_end_epoch"),
        (F.dayofmonth(F.col("source_date").cast("date")) % 3 != 0).alias("trade_pages_complete"),
    )
    return ql.audit_dataset(
        spark, span(base), sold, states, incidents=span(gaps(spark, sf)), label_windows=span(intervals(spark, sf)),
        joined_ticks=joined, completions=done, minimum_seconds=AUDIT_MIN,
    )


AUDIT_SQL = f"""{SUBTRACT},
d AS (SELECT unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) AS dn, s, e FROM pieces),
cov AS (SELECT dn, sum((least(e, (dn + 1) * {DAY}) - greatest(s, dn * {DAY})) // 1000000)::BIGINT AS n FROM d GROUP BY dn),
days AS (SELECT DISTINCT unnest(range(s // {DAY}, (e - 1) // {DAY} + 1)) AS dn FROM base),
ok AS (SELECT DISTINCT epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // {DAY} AS dn FROM events WHERE day(ts) % 3 <> 0),
pd AS (SELECT dn, ok.dn IS NOT NULL AS complete, CASE WHEN ok.dn IS NOT NULL THEN coalesce(n, 0) ELSE 0 END AS secs
       FROM days LEFT JOIN cov USING (dn) LEFT JOIN ok USING (dn))"""


@query(
    "audit_days",
    f"""WITH {AUDIT_SQL},
tr AS (SELECT epoch_us(CAST(CAST(ts AS DATE) AS TIMESTAMP)) // {DAY} AS dn, count(*) AS c FROM events WHERE event_id % 3 <> 0 GROUP BY 1)
SELECT CAST(CAST(DATE '1970-01-01' + CAST(dn AS INT) AS DATE) AS VARCHAR) AS day, complete AS trade_pages_complete, secs::BIGINT AS valid_seconds,
       coalesce(c, 0) AS trade_count FROM pd LEFT JOIN tr USING (dn)""",
)
def audit_days(spark, sf):
    return audit(spark, sf)[1].select(text("day"), "trade_pages_complete", "valid_seconds", "trade_count")


@query(
    "quality_codes",
    f"""WITH {AUDIT_SQL},
sold AS (SELECT CASE WHEN event_id % 1009 = 2 THEN '1' ELSE CAST(event_id AS VARCHAR) END AS id FROM events WHERE event_id % 3 <> 0),
codes AS (
  SELECT 'crossed_bbo' AS c WHERE EXISTS (SELECT 1 FROM events WHERE event_id % 999 = 0)
  UNION ALL SELECT 'duplicate_trade_ids' WHERE (SELECT count(*) - count(DISTINCT id) FROM sold) > 0
  UNION ALL SELECT 'trade_pages_complete' WHERE EXISTS (SELECT 1 FROM pd WHERE NOT complete)
  UNION ALL SELECT 'invalid_trade_completion_evidence' WHERE EXISTS (SELECT 1 FROM events WHERE day(ts) % 3 = 0)
  UNION ALL SELECT 'qualified_seconds_below_minimum' WHERE (SELECT sum(secs) FROM pd) < {AUDIT_MIN}
  UNION ALL SELECT 'label_window_crosses_excluded_interval' WHERE EXISTS (SELECT 1 FROM iv, gaps WHERE iv.s < ge AND gs < iv.e)
  UNION ALL SELECT 'causal_join_crosses_gap' WHERE EXISTS (
    SELECT 1 FROM (SELECT epoch_us(t.ts) AS t, epoch_us(date_trunc('second', b.ts)) AS o FROM
      (SELECT * FROM events WHERE event_id % 3 <> 0) t ASOF JOIN (SELECT * FROM events WHERE event_id % 3 = 0) b
      ON t.event_type = b.event_type AND day(t.ts) = day(b.ts) AND t.ts >= date_trunc('second', b.ts) + INTERVAL 1 SECOND) q, gaps
    WHERE q.o < ge AND gs < q.t))
SELECT 'FAIL' AS status, (SELECT sum(secs)::BIGINT FROM pd) AS qualified_seconds,
       (SELECT (max(e) - min(s)) // 1000000 FROM base) AS calendar_span_seconds,
       (SELECT count(*) - count(DISTINCT id) FROM sold) AS duplicate_count, array_to_string(list_sort(list(c)), ',') AS failures FROM codes""",
)
def quality_codes(spark, sf):
    report, _ = audit(spark, sf)
    return report.select("status", "qualified_seconds", "calendar_span_seconds", "duplicate_count", codes("failures"))


@query(
    "dataset_gate",
    f"""WITH {SCORED} SELECT array_to_string(list_filter([CASE WHEN count(*) = 0 THEN 'empty' END,
        CASE WHEN min(label) = max(label) THEN 'single_class' END], lambda x: x IS NOT NULL), ',') AS problems FROM s""",
)
def dataset_gate(spark, sf):
    rows = scored(spark, sf).withColumn("timestamp", F.timestamp_micros("ts_us"))
    return ql.dataset_gate(rows, "label", ["score", "baseline_score"], order="event_id").select(codes("problems"))


@query(
    "partition_rules",
    """SELECT event_type AS product, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS rows,
       array_to_string(list_filter([CASE WHEN min(user_id) <> max(user_id) THEN 'several_sources' END,
                    CASE WHEN min(hour(ts)) <> max(hour(ts)) THEN 'several_hours' END], lambda x: x IS NOT NULL), ',') AS problems
       FROM events GROUP BY ALL""",
)
def partition_rules(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("event_type").alias("product"), F.to_date("ts").alias("date"), F.col("event_type").alias("product_id"),
        F.col("user_id").cast("string").alias("source"), F.col("ts").cast("timestamp").alias("event_time"), "event_id",
    )
    out = ql.partition_problems(rows, ["event_id"], "event_time", ("product", "date"))
    return out.select("product", text("date"), "rows", codes("problems"))


@query(
    "hourly_manifest",
    """WITH c AS (SELECT event_type AS kind, CAST(ts AS DATE) AS date, CAST(hour(ts) AS INT) AS hour, count(*) AS n FROM events GROUP BY ALL),
g AS (SELECT DISTINCT kind, date, CAST(h AS INT) AS hour FROM c, range(24) r(h))
SELECT kind, CAST(date AS VARCHAR) AS date, hour, coalesce(n, 0) AS rows FROM g LEFT JOIN c USING (kind, date, hour)""",
)
def hourly_manifest(spark, sf):
    rows = table(spark, sf, "events").withColumn("kind", F.col("event_type"))
    return tb.hourly_manifest(rows, "ts", ["kind"]).withColumn("date", text("date"))


@query(
    "inventory_missing",
    """WITH w AS (SELECT CAST(d AS DATE) AS day, k AS kind FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY) r(d),
  (VALUES ('click'), ('error')) v(k))
SELECT CAST(day AS VARCHAR) AS day, kind FROM w WHERE NOT EXISTS (SELECT 1 FROM events e WHERE CAST(e.ts AS DATE) = w.day AND e.event_type = w.kind AND value > 0)""",
)
def inventory_missing(spark, sf):
    listing = table(spark, sf, "events").select(
        F.to_date("ts").alias("day"), F.col("event_type").alias("kind"), F.col("value").alias("size")
    )
    return ql.inventory_missing(listing, "2024-01-01", "2024-02-04", ("click", "error")).withColumn("day", text("day"))


@query(
    "sidecar_counts",
    """WITH d AS (SELECT event_type AS t, count(*) + max(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS declared_rows FROM events GROUP BY ALL),
a AS (SELECT event_type AS t, count(*) AS actual_rows, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS outside FROM events GROUP BY ALL)
SELECT t AS "table", declared_rows, actual_rows, array_to_string(list_filter([CASE WHEN declared_rows <> actual_rows THEN 'row_count_mismatch' END,
  CASE WHEN outside > 0 THEN 'outside_day' END], lambda x: x IS NOT NULL), ',') AS problems
FROM d JOIN a USING (t) WHERE declared_rows <> actual_rows OR outside > 0""",
)
def sidecar_counts(spark, sf):
    events = table(spark, sf, "events")
    declared = events.groupBy(F.col("event_type").alias("table")).agg(
        (F.count(F.lit(1)) + F.max(F.when(F.col("event_type") == "click", 1).otherwise(0))).alias("declared_rows")
    )
    rows = events.select(F.col("event_type").alias("table"), F.col("ts").cast("timestamp").alias("at"))
    out = mf.sidecar_problems(
        declared, rows, F.lit("2000-01-01").cast("timestamp"), F.lit("2024-01-30").cast("timestamp")
    )
    return out.select("table", "declared_rows", "actual_rows", codes("problems"))


@query(
    "dataset_manifest",
    f"""WITH {SCORED} SELECT count(*) AS rows, min(ts_us) AS start_time, max(ts_us) AS end_time,
        {rs('avg(label)')} AS prevalence, count(*) - count(DISTINCT ts_us) AS duplicate_timestamps FROM s""",
)
def dataset_manifest(spark, sf):
    row = mf.dataset_manifest(scored(spark, sf), "label", "ts_us", ["score", "label"])
    return row.select("rows", "start_time", "end_time", r("prevalence").alias("prevalence"), "duplicate_timestamps")


@query("manifest_id")
def manifest_id(spark, sf):
    return mf.dataset_manifest(scored(spark, sf), "label", "ts_us", ["score", "label"]).select("manifest_id")


# -- profile ------------------------------------------------------------------


@query(
    "profile",
    f"""WITH {SCORED} SELECT count(*) AS rows, min(ts_us) AS start_us, max(ts_us) AS end_us,
        count(*) - count(DISTINCT ts_us) AS duplicate_timestamps, {rs('avg(label)')} AS positive_rate,
        CAST(date_diff('day', min(day), max(day)) + 1 AS INT) AS coverage_days,
        date_diff('day', min(day), max(day)) + 1 >= 30 AS qualification_data,
        count(*) >= 100000 AND sum(label) >= 500 AS neural_data_eligible FROM s""",
)
def profile(spark, sf):
    row = pf.profile(scored(spark, sf), "label")
    return row.select(
        "rows", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"),
        "duplicate_timestamps", r("positive_rate").alias("positive_rate"), "coverage_days", "qualification_data",
        "neural_data_eligible",
    )


def holed(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.when(e % 7 != 0, F.when(e % 11 == 0, float("nan")).when(e % 13 == 0, float("inf")).otherwise(F.col("value"))).alias("x"),
        F.when(e % 5 != 0, F.col("user_id").cast("double")).alias("y"),
        F.col("value").alias("z"),
    )


@query(
    "non_finite",
    """SELECT 'x' AS "column", count(*) FILTER (WHERE event_id % 7 = 0) AS nulls,
         count(*) FILTER (WHERE event_id % 7 = 0 OR event_id % 11 = 0 OR event_id % 13 = 0) AS non_finite FROM events
       UNION ALL SELECT 'y', count(*) FILTER (WHERE event_id % 5 = 0), count(*) FILTER (WHERE event_id % 5 = 0) FROM events""",
)
def non_finite(spark, sf):
    return pf.non_finite(holed(spark, sf), ["x", "y"])


@query("daily_prevalence", f"WITH {SCORED} SELECT CAST(day AS VARCHAR) AS day, {rs('avg(label)')} AS label FROM s GROUP BY s.day")
def daily_prevalence(spark, sf):
    return pf.daily_means(scored(spark, sf), ["label"]).select(text("day"), r("label").alias("label"))


@query(
    "daily_feature_means",
    f"WITH {TICKS} SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, {rs('avg(price)')} AS price, {rs('avg(bid_size)')} AS bid_size FROM ticks GROUP BY 1",
)
def daily_feature_means(spark, sf):
    out = pf.daily_means(ticks(spark, sf), ["price", "bid_size"])
    return out.select(text("day"), r("price").alias("price"), r("bid_size").alias("bid_size"))


GAPS_SQL = f"""{TICKS}, g AS (SELECT product_id, ts_us, lag(ts_us) OVER (PARTITION BY product_id ORDER BY ts_us, arrival) AS prev,
  ts_us - lag(ts_us) OVER (PARTITION BY product_id ORDER BY ts_us, arrival) AS gap FROM ticks)"""


@query(
    "arrival_percentiles",
    f"""WITH {GAPS_SQL} SELECT product_id, {rs('quantile_cont(gap / 1000.0::DOUBLE, 0.5)', 3)} AS median_ms,
        {rs('quantile_cont(gap / 1000.0::DOUBLE, 0.95)', 3)} AS p95_ms, {rs('quantile_cont(gap / 1000.0::DOUBLE, 0.99)', 3)} AS p99_ms
        FROM g GROUP BY product_id""",
)
def arrival_percentiles(spark, sf):
    out = pf.arrival_percentiles(ticks(spark, sf), order=["arrival"], keys=["product_id"])
    return out.select("product_id", *[r(n, 3).alias(n) for n in ("median_ms", "p95_ms", "p99_ms")])


@query(
    "gap_summary",
    f"""WITH {GAPS_SQL} SELECT product_id, count(*) FILTER (WHERE gap > 3600000000) AS count_over_threshold,
        {rs('max(gap) / 1e6')} AS longest_gap_seconds, min(CASE WHEN gap = mg THEN prev END) AS longest_gap_start_us
        FROM (SELECT *, max(gap) OVER (PARTITION BY product_id) AS mg FROM g) GROUP BY product_id""",
)
def gap_summary(spark, sf):
    out = pf.gap_summary(ticks(spark, sf), order=["arrival"], keys=["product_id"], threshold_seconds=3600)
    return out.select(
        "product_id", "count_over_threshold", r("longest_gap_seconds").alias("longest_gap_seconds"),
        F.unix_micros("longest_gap_start").alias("longest_gap_start_us"),
    )


LAGS = (3600, 6 * 3600, 24 * 3600, 5 * 86_400)


@query(
    "autocorr",
    f"""WITH b AS (SELECT epoch_us(ts) // 3600000000 AS bin, avg(value) AS value, avg(user_id) AS user_id FROM events GROUP BY 1),
l AS (SELECT unnest([{', '.join(str(x) for x in LAGS)}]) AS lag_seconds),
p AS (SELECT l.lag_seconds, a.value AS v1, b.value AS v0, a.user_id AS u1, b.user_id AS u0
  FROM l JOIN b a ON TRUE JOIN b ON a.bin = b.bin + l.lag_seconds // 3600)
SELECT CAST(lag_seconds AS INT) AS lag_seconds, {rs('corr(v1, v0)')} AS value, {rs('corr(u1, u0)')} AS user_id FROM p GROUP BY lag_seconds""",
)
def autocorr(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts_us", ts_micros("ts"))
    out = pf.autocorrelation(rows, ["value", "user_id"], lags_seconds=LAGS, bin_seconds=3600)
    return out.select("lag_seconds", r("value").alias("value"), r("user_id").alias("user_id"))


@query(
    "correlations",
    f"""WITH q AS (SELECT CASE WHEN event_id % 5 <> 0 THEN user_id::DOUBLE END AS y, value AS z, CAST(event_id % 7 AS DOUBLE) AS w FROM events)
SELECT 'y' AS a, 'z' AS b, {rs('corr(y, z)')} AS r FROM q UNION ALL SELECT 'y', 'w', {rs('corr(y, w)')} FROM q
UNION ALL SELECT 'z', 'w', {rs('corr(z, w)')} FROM q""",
)
def correlations(spark, sf):
    rows = table(spark, sf, "events").select(
        F.when(F.col("event_id") % 5 != 0, F.col("user_id").cast("double")).alias("y"), F.col("value").alias("z"),
        (F.col("event_id") % 7).cast("double").alias("w"),
    )
    return pf.correlations(rows, ["y", "z", "w"]).select("a", "b", r("r").alias("r"))


PERCENTS = (50, 75, 80, 85, 90, 95, 99)


@query(
    "percentile_table",
    "WITH t AS ("
    + " UNION ALL ".join(f"SELECT {p} AS percentile, quantile_cont(value, {p / 100}) AS threshold FROM events" for p in PERCENTS)
    + f""") SELECT percentile, {rs('threshold')} AS threshold,
        {rs('(SELECT avg(CAST(value > threshold AS DOUBLE)) FROM events)')} AS spike_rate, {rs('threshold * 60000', 3)} AS move FROM t""",
)
def percentile_table(spark, sf):
    out = pf.percentile_table(table(spark, sf, "events"), "value")
    return out.select("percentile", r("threshold").alias("threshold"), r("spike_rate").alias("spike_rate"), r("move", 3).alias("move"))


@query(
    "threshold_sweep",
    f"""WITH x AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events),
p AS (SELECT *, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM x),
t AS (SELECT unnest([85, 90, 95]) AS percentile, unnest([100.0, 150.0, 200.0]::DOUBLE[]) AS threshold)
SELECT split, percentile, threshold, {rs('avg(CAST(value > threshold AS DOUBLE))')} AS spike_rate FROM p, t GROUP BY ALL""",
)
def threshold_sweep(spark, sf):
    rows = table(spark, sf, "events").withColumn("ts_us", ts_micros("ts"))
    split = sp.sequential_split(rows, order=["event_id"])
    out = pf.threshold_sweep(split, "value", {85: 100.0, 90: 150.0, 95: 200.0}, ["split"])
    return out.withColumn("spike_rate", r("spike_rate"))


@query(
    "class_counts",
    "SELECT quality, count(*) AS n, count(*) < 100 AS undersized FROM labels GROUP BY quality",
)
def class_counts(spark, sf):
    return pf.class_counts(table(spark, sf, "labels"), "quality", 100)


@query(
    "service_rollup",
    f"""WITH e AS (SELECT event_type AS variant, epoch_us(ts) AS t, value, user_id, event_id FROM events),
w AS (SELECT *, unnest([t // 10800000000 * 10800000000, t // 10800000000 * 10800000000 - 10800000000]) AS ws FROM e)
SELECT ws AS window_us, variant, {rs('count(*) / 21600.0::DOUBLE')} AS request_rate,
       {rs('count(*) FILTER (WHERE user_id % 20 = 0) / count(*)::DOUBLE')} AS error_ratio, quantile_disc(value, 0.5) AS latency_p50_ms,
       quantile_disc(value, 0.95) AS latency_p95_ms, max(event_id % 300) AS max_lag, {rs('avg(abs((value - 50) / 30))')} AS mean_abs_zscore,
       quantile_disc(value, 0.95) <= 800 AND quantile_disc(value, 0.5) <= 100 AND 1 - count(*) FILTER (WHERE user_id % 20 = 0) / count(*)::DOUBLE >= 0.9
         AND max(event_id % 300) <= 200 AS slo_met
FROM w GROUP BY ws, variant""",
)
def service_rollup(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("variant"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("latency_ms"),
        (F.col("user_id") % 20 != 0).alias("ok"), (F.col("event_id") % 300).alias("lag"),
        ((F.col("value") - 50) / 30).alias("zscore"),
    )
    out = pf.slo_status(pf.service_rollup(log, window="6 hours", slide="3 hours", window_seconds=21600.0), success=0.9)
    return out.select(
        F.unix_micros("window_start").alias("window_us"), "variant", r("request_rate").alias("request_rate"),
        r("error_ratio").alias("error_ratio"), "latency_p50_ms", "latency_p95_ms", "max_lag",
        r("mean_abs_zscore").alias("mean_abs_zscore"), "slo_met",
    )


@query(
    "staleness",
    """SELECT (max(epoch_us(ts)) + 30000000 - max(epoch_us(ts))) / 1e6 AS event_age_seconds,
       (max(epoch_us(ts)) + 30000000 - max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END)) / 1e6 AS write_age_seconds,
       TRUE AS fresh, (max(epoch_us(ts)) + 30000000 - max(CASE WHEN event_type = 'error' THEN epoch_us(ts) END)) / 1e6 > 60 AS degraded
       FROM events""",
)
def staleness(spark, sf):
    ts = F.col("ts").cast("timestamp")
    rows = table(spark, sf, "events").select(
        ts.alias("event_ts"), F.when(F.col("event_type") == "error", ts).alias("write_ts"),
        (ts + F.expr("INTERVAL 30 SECONDS")).alias("clock"),
    )
    return pf.staleness(rows, "clock")


# -- drift --------------------------------------------------------------------


def halves(spark, sf):
    rows = table(spark, sf, "events").select(
        "value", F.col("user_id").cast("double").alias("user_id"), (F.col("value") > 60).cast("int").alias("hit"),
        F.dayofmonth("ts").alias("d"),
    )
    # a third of the users change between the halves
    later = rows.where("d > 15").withColumns({
        "value": F.when(F.col("user_id") % 3 == 0, F.col("value") / 2).otherwise(F.col("value")),
        "user_id": F.when(F.col("user_id") % 3 == 0, F.col("user_id") + 40).otherwise(F.col("user_id")),
    })
    return rows.where("d <= 15"), later.withColumn("hit", (F.col("value") > 60).cast("int"))


HALVES = """h0 AS (SELECT day(ts) <= 15 AS ref, CASE WHEN day(ts) > 15 AND user_id % 3 = 0 THEN value / 2 ELSE value END AS value,
  CASE WHEN day(ts) > 15 AND user_id % 3 = 0 THEN user_id + 40 ELSE user_id END::DOUBLE AS user_id FROM events),
h AS (SELECT *, CAST(value > 60 AS INT) AS hit FROM h0)"""


@query(
    "drift_wasserstein",
    f"""WITH {HALVES},
l AS (SELECT 'value' AS feature, value AS v, ref FROM h UNION ALL SELECT 'user_id', user_id, ref FROM h),
t AS (SELECT feature, count(*) FILTER (WHERE ref) AS nr, count(*) FILTER (WHERE NOT ref) AS nc, stddev_pop(v) FILTER (ref) AS dev FROM l GROUP BY feature),
s AS (SELECT feature, v, count(*) FILTER (WHERE ref) AS r, count(*) FILTER (WHERE NOT ref) AS c FROM l GROUP BY feature, v),
w AS (SELECT *, sum(r) OVER p AS cr, sum(c) OVER p AS cc, lead(v) OVER (PARTITION BY feature ORDER BY v) - v AS step
  FROM s WINDOW p AS (PARTITION BY feature ORDER BY v ROWS UNBOUNDED PRECEDING))
SELECT feature, {rs('sum(abs(cr / nr::DOUBLE - cc / nc::DOUBLE) * step)')} AS wasserstein,
       {rs('sum(abs(cr / nr::DOUBLE - cc / nc::DOUBLE) * step) / greatest(any_value(dev), 0.001)')} AS drift_score
FROM w JOIN t USING (feature) GROUP BY feature""",
)
def drift_wasserstein(spark, sf):
    out = drift.wasserstein(*halves(spark, sf), ["value", "user_id"])
    return out.select("feature", r("wasserstein").alias("wasserstein"), r("drift_score").alias("drift_score"))


@query(
    "drift_js",
    f"""WITH {HALVES},
p AS (SELECT hit, count(*) FILTER (WHERE ref) / (SELECT count(*) FILTER (WHERE ref) FROM h)::DOUBLE AS p, count(*) FILTER (WHERE NOT ref) / (SELECT count(*) FILTER (WHERE NOT ref) FROM h)::DOUBLE AS q FROM h GROUP BY hit)
SELECT {rs('sqrt(greatest(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2, 0))')} AS js_distance FROM p""",
)
def drift_js(spark, sf):
    return drift.jensen_shannon(*halves(spark, sf), "hit").select(r("js_distance").alias("js_distance"))


@query(
    "skew",
    f"""WITH {HALVES},
l AS (SELECT 'value' AS feature, value AS v, ref FROM h UNION ALL SELECT 'user_id', user_id, ref FROM h),
t AS (SELECT feature, avg(v) FILTER (ref) AS m, stddev_pop(v) FILTER (ref) AS s FROM l GROUP BY feature),
z AS (SELECT feature, abs((v - m) / CASE WHEN s = 0 THEN 1 ELSE s END) AS z FROM l JOIN t USING (feature) WHERE NOT ref)
SELECT feature, count(*) AS n, {rs('avg(z)')} AS mean_abs_z, {rs('max(z)')} AS max_abs_z, count(*) FILTER (WHERE z >= 1.5) AS skewed_rows FROM z GROUP BY feature""",
)
def skew(spark, sf):
    training, live = halves(spark, sf)
    out = drift.feature_skew(live, training, ["value", "user_id"], limit=1.5)
    return out.select("feature", "n", r("mean_abs_z").alias("mean_abs_z"), r("max_abs_z").alias("max_abs_z"), "skewed_rows")


# -- splits and search --------------------------------------------------------


@query(
    "temporal_splits",
    f"""WITH {SCORED},
p AS (SELECT *, row_number() OVER (ORDER BY ts_us, event_id) - 1 AS pos, count(*) OVER () AS n, min(ts_us) OVER () AS t0 FROM s),
c AS (SELECT max(n) AS n, max(n) - CAST(ceil(max(n) * 0.2) AS BIGINT) AS de, count(*) FILTER (WHERE ts_us < t0 + 2 * 86400000000) AS fl FROM p),
k AS (SELECT *, greatest(fl, de // 5) AS f0, (de - greatest(fl, de // 5)) // 4 AS ch FROM c),
f AS (SELECT CAST(i AS INT) AS fold, f0 + i * ch AS vs, CASE WHEN i = 3 THEN de ELSE f0 + (i + 1) * ch END AS ve FROM k, range(4) r(i)),
g AS (SELECT f.*, p.ts_us - 86400000000 AS cut FROM f JOIN p ON p.pos = f.vs)
SELECT event_id, fold, CASE WHEN pos >= vs AND pos < ve THEN 'validation' ELSE 'train' END AS role FROM p, g
WHERE (pos >= vs AND pos < ve) OR (pos < vs AND ts_us <= cut)
UNION ALL SELECT event_id, -1, 'holdout' FROM p, k WHERE pos >= de""",
)
def temporal_splits(spark, sf):
    members, _ = sp.make_temporal_splits(
        scored(spark, sf), folds=4, holdout_fraction=0.2, embargo_seconds=86_400, target="label", order=["event_id"]
    )
    return members.select("event_id", "fold", "role")


@query(
    "sequential_split",
    """WITH x AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM x""",
)
def sequential_split(spark, sf):
    return sp.sequential_split(scored(spark, sf), order=["event_id"]).select("event_id", "split")


@query(
    "calibration_tail",
    """WITH x AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM events)
SELECT event_id FROM x WHERE i >= n - ceil(n * 0.25)""",
)
def calibration_tail(spark, sf):
    return sp.calibration_tail(scored(spark, sf), order=["event_id"]).where("calibrates").select("event_id")


def trials(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") == "error", "baseline").otherwise(F.col("event_type")).alias("stage"),
        e.alias("trial_id"), e.alias("trial_order"), (u % 4).alias("search_id"),
        F.when(u % 13 == 0, "failed").when(u % 11 == 0, "skipped").otherwise("finished").alias("outcome"),
        (F.get_json_object("props", "$.k").cast("int") / F.lit(100.0)).alias("aggregate_pr_auc"),
        (0.9 + (u % 30) / F.lit(100.0)).alias("development_brier_ratio"),
        (e % 6).cast("double").alias("development_folds_won"),
        F.concat(F.lit("d"), (u % 4).cast("string")).alias("dataset_id"), F.lit("core_v1").alias("feature_set_id"),
        F.lit("t1").alias("target_version"), F.lit("v1").alias("validation_version"),
        F.when(e % 1000 == 7, "g2").otherwise("g1").alias("git_sha"),
    )


TRIALS = """t AS (SELECT CASE WHEN event_type = 'error' THEN 'baseline' ELSE event_type END AS stage, event_id AS trial_id, user_id % 4 AS search_id,
  CASE WHEN user_id % 13 = 0 THEN 'failed' WHEN user_id % 11 = 0 THEN 'skipped' ELSE 'finished' END AS outcome,
  CAST(json_extract_string(props, '$.k') AS INT) / 100.0::DOUBLE AS ap, 90 + user_id % 30 AS brier, event_id % 6 AS won,
  CASE WHEN event_id % 1000 = 7 THEN 'g2' ELSE 'g1' END AS git FROM events)"""


@query(
    "leaderboard",
    f"""WITH {TRIALS} SELECT stage, trial_id, ap AS aggregate_pr_auc FROM t
        WHERE outcome = 'finished' AND (stage = 'baseline' OR (brier <= 105 AND won >= 4))
        QUALIFY row_number() OVER (PARTITION BY stage ORDER BY ap DESC, trial_id) = 1""",
)
def leaderboard(spark, sf):
    return se.leaderboard(trials(spark, sf), max_brier=1.0500001).select("stage", "trial_id", "aggregate_pr_auc")


@query(
    "stage_gates",
    f"""WITH {TRIALS},
s AS (SELECT stage, ap, row_number() OVER (PARTITION BY stage ORDER BY trial_id) - 1 AS i, count(*) OVER (PARTITION BY stage) AS n FROM t WHERE outcome = 'finished'),
h AS (SELECT stage, max(n) AS scored, max(CASE WHEN i < n // 2 THEN ap END) AS eb, max(CASE WHEN i >= n // 2 THEN ap END) AS lb FROM s GROUP BY stage),
f AS (SELECT stage, count(*) AS trials, count(*) FILTER (WHERE outcome = 'failed') AS failures FROM t GROUP BY stage)
SELECT stage, trials, failures, failures / trials::DOUBLE > 0.2 AS too_many_failures, scored, eb AS earlier_best, lb AS later_best,
       scored >= 10 AND lb - eb <= 0.001 AS plateau FROM f JOIN h USING (stage)""",
)
def stage_gates(spark, sf):
    return se.stage_gates(trials(spark, sf))


@query(
    "contract_check",
    f"""WITH {TRIALS} SELECT search_id, array_to_string(list_filter([CASE WHEN count(DISTINCT git) > 1 THEN 'git_sha' END], lambda x: x IS NOT NULL), ',') AS conflicts
        FROM t GROUP BY search_id""",
)
def contract_check(spark, sf):
    return se.contract_check(trials(spark, sf)).select("search_id", codes("conflicts"))


@query(
    "pending_trials",
    f"WITH {TRIALS} SELECT stage, trial_id FROM t WHERE outcome <> 'finished'",
)
def pending_trials(spark, sf):
    rows = trials(spark, sf)
    return se.pending_trials(rows, rows.where("outcome = 'finished'")).select("stage", "trial_id")


@query(
    "qualify",
    """SELECT event_id, array_to_string(list_filter([CASE WHEN user_id % 40 < 30 THEN 'coverage_under_thirty_days' END,
         CASE WHEN event_id % 2 = 0 THEN 'quote_trade_coverage_missing' END, CASE WHEN event_id % 6 < 4 THEN 'fewer_than_four_folds_won' END,
         CASE WHEN value <= 20 THEN 'bootstrap_lower_not_positive' END, CASE WHEN value > 105 THEN 'brier_regression_over_five_percent' END,
         CASE WHEN user_id % 3 = 0 THEN 'event_f1_regressed' END, CASE WHEN user_id % 5 = 0 THEN 'final_pr_auc_not_improved' END,
         CASE WHEN value * 10 > 800 THEN 'p95_latency_over_800ms' END, CASE WHEN event_id % 7 = 0 THEN 'feature_set_not_deployable' END,
         CASE WHEN event_id % 11 = 0 THEN 'feature_parity_failed' END], lambda x: x IS NOT NULL), ',') AS reasons FROM events""",
)
def qualify(spark, sf):
    e, u, v = F.col("event_id"), F.col("user_id"), F.col("value")
    evidence = table(spark, sf, "events").select(
        "event_id", (u % 40).cast("double").alias("coverage_days"), (e % 2 != 0).alias("quote_trade_coverage"),
        (e % 6).alias("folds_won"), (v - 20).alias("bootstrap_lower"), F.when(v > 105, 2.0).otherwise(1.0).alias("brier_ratio"),
        F.when(u % 3 == 0, -0.1).otherwise(0.0).alias("event_f1_delta"), F.when(u % 5 == 0, 0.0).otherwise(0.1).alias("final_pr_auc_delta"),
        (v * 10).alias("p95_latency_ms"), (e % 7 != 0).alias("deployable"), (e % 11 != 0).alias("parity_passed"),
    )
    return se.qualify(evidence).select("event_id", codes("reasons"))


# -- sources and scoring ------------------------------------------------------


@query(
    "ws_flatten",
    """SELECT event_id, event_type AS product_id, CAST(value AS VARCHAR) AS price FROM events WHERE event_id % 9 <> 0 AND event_id % 10 <> 3""",
)
def ws_flatten(spark, sf):
    e = F.col("event_id")
    ticker = F.struct(
        F.col("event_type").alias("product_id"), F.when(e % 9 != 0, F.col("value").cast("string")).alias("price"),
        F.lit("1").alias("best_bid"), F.lit("2").alias("best_ask"),
    )
    envelope = F.struct(
        F.lit("ticker").alias("channel"), F.when(e % 10 != 3, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).alias("timestamp"),
        e.alias("sequence_num"), F.array(F.struct(F.lit("update").alias("type"), F.array(ticker).alias("tickers"))).alias("events"),
    )
    messages = table(spark, sf, "events").select("event_id", F.to_json(envelope).alias("value"))
    return src.flatten_envelopes(messages).select("event_id", "product_id", "price")


@query(
    "message_parse",
    """SELECT event_id, value AS price FROM events WHERE event_id % 8 <> 0 AND event_id % 6 <> 1""",
)
def message_parse(spark, sf):
    e = F.col("event_id")
    tick = F.to_json(
        F.struct(
            F.col("event_type").alias("product_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'000Z'").alias("timestamp"),
            F.when(e % 6 != 1, F.col("value").cast("string")).otherwise("n/a").alias("price"), F.lit("1").alias("best_bid"),
            F.lit("2").alias("best_ask"),
        )
    )
    log = table(spark, sf, "events").select(
        F.lit("ticks").alias("topic"), F.lit(0).alias("partition"), e.alias("offset"),
        F.when(e % 8 != 0, tick).otherwise(F.lit("{broken")).alias("value"),
    )
    return src.ticks_from_log(log).select(F.col("offset").alias("event_id"), "price")


@query(
    "normalize_ts",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS ts FROM events""",
)
def normalize_timestamps(spark, sf):
    raw = F.when(F.col("event_id") % 4 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    return table(spark, sf, "events").select("event_id", normalize_ts(raw).alias("ts"))


@query(
    "insert_or_ignore",
    """SELECT CAST(event_id % 4000 AS VARCHAR) AS event_id, arg_min(value, event_id) AS value FROM events
WHERE event_id % 4000 % 3 <> 0 GROUP BY 1""",
)
def insert_or_ignore(spark, sf):
    batch = table(spark, sf, "events").select(
        (F.col("event_id") % 4000).cast("string").alias("event_id"), "value", F.col("event_id").alias("source_offset")
    )
    existing = batch.where("cast(event_id as bigint) % 3 = 0").select("event_id").distinct()
    return tb.insert_or_ignore(existing, batch, "event_id", ("source_offset",)).select("event_id", "value")


@query(
    "score_baseline",
    "SELECT event_id, CASE WHEN value > 60 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM events",
)
def score_baseline(spark, sf):
    return ml.score_baseline(table(spark, sf, "events"), "value", 60.0).select("event_id", "score")


def vectors(spark, sf):
    """Every component of every embedding as a column, and their names."""
    rows = table(spark, sf, "embeddings")
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"x{i}" for i in range(width)]
    out = rows.select(
        "vec_id", F.col("vec_id").alias("ts_us"), (F.col("label") % 2).cast("int").alias("y"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)],
    )
    return out, names


@query("score_ml")
def score_ml(spark, sf):
    rows, names = vectors(spark, sf)
    held_out = F.col("vec_id") % 5 == 0
    scorer = ml.fit_candidate(rows.where(~held_out), names, "logistic", label="y")
    return ml.score_ml(rows.where(held_out), scorer).select("vec_id", F.round("score", 6).alias("score"))


@query("walkforward")
def walkforward(spark, sf):
    rows, names = vectors(spark, sf)
    return ml.walkforward_evaluate(rows, names, "logistic", label="y", embargo_seconds=1e-5)["metrics"]
