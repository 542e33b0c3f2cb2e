"""Contracts, dataset gates and the fail-closed quality audit.

Every check yields rows that carry a failure code; a report passes only when no
code was produced. Bad evidence is itself a failure, never a warning.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import MICROS, event_time, is_finite, reasons, ts_micros
from tickloom.operators import identity
from tickloom.operators.intervals import (
    covered_seconds,
    flag_overlap,
    interval_subtract,
    interval_union,
    split_by_day,
)
from tickloom.plans.lineage import stage

#: Thirty days of qualified seconds.
MINIMUM_SECONDS = 2_592_000
MINIMUM_CLASS_ROWS = 10

# -- row contracts ------------------------------------------------------------


def book_violations() -> Column:
    return reasons(
        ("missing_time", F.col("observed_through").isNull()),
        ("sequence_regressed", F.col("sequence_start") > F.col("sequence_end")),
        ("crossed_book", F.col("best_bid") > F.col("best_ask")),
        ("negative_size", (F.col("bid_size") < 0) | (F.col("ask_size") < 0)),
        ("negative_segment", F.col("segment_id") < 0),
    )


def delta_violations() -> Column:
    bad_change = F.exists(
        "changes", lambda c: ~F.coalesce(c["side"].isin("bid", "offer"), F.lit(False)) | (c["quantity"] < 0)
    )
    return reasons(
        ("missing_time", F.col("changed_second").isNull()),
        ("sequence_regressed", F.col("source_sequence_num_start") > F.col("source_sequence_num_end")),
        ("crossed_book", F.col("best_bid") > F.col("best_ask")),
        ("invalid_change", bad_change),
    )


def trade_violations() -> Column:
    return reasons(
        ("missing_time", F.col("event_time").isNull()),
        ("non_positive", (F.col("price") <= 0) | (F.col("size") <= 0)),
    )


def incident_violations() -> Column:
    bad = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end"))
    return reasons(("empty_window", bad))


def with_violations(df: DataFrame, violations: Column, name: str = "violations") -> DataFrame:
    return df.withColumn(name, violations)


def rejected(df: DataFrame, violations: Column) -> DataFrame:
    """Rows that break their contract, with the codes."""
    return df.withColumn("violations", violations).where(F.size("violations") > 0)


def partition_problems(
    rows: DataFrame, key: Sequence[str], time: str, partition: Sequence[str] = ("product", "date", "hour")
) -> DataFrame:
    """Per stored partition: one product, one source, one UTC hour, unique keys, right place."""
    per_key = rows.groupBy(*partition, *[k for k in key if k not in partition]).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("product_id").alias("p0"), F.max("product_id").alias("p1"),
        F.min("source").alias("s0"), F.max("source").alias("s1"),
        F.min(F.date_trunc("hour", time)).alias("h0"), F.max(F.date_trunc("hour", time)).alias("h1"),
        F.count_if(F.col(time).isNull()).alias("timeless"),
        F.count_if(F.coalesce(F.length("source"), F.lit(0)) == 0).alias("sourceless"),
    )
    grouped = per_key.groupBy(*partition).agg(
        F.sum("n").alias("rows"),
        reasons(
            ("several_products", F.min("p0") != F.max("p1")),
            ("several_sources", (F.min("s0") != F.max("s1")) | (F.sum("sourceless") > 0)),
            ("several_hours", (F.min("h0") != F.max("h1")) | (F.sum("timeless") > 0)),
            ("duplicate_keys", F.max("n") > 1),
        ).alias("problems"),
    )
    return grouped


def dataset_gate(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    ts: str = "timestamp",
    order: str | None = None,
    minimum: int = MINIMUM_CLASS_ROWS,
) -> DataFrame:
    """One row with the reasons a labelled dataset cannot be used (empty array: usable).

    `order` is the stored row order that time must follow.
    """
    known = set(df.columns)
    spark = df.sparkSession
    absent = [name for name in (target, ts, *features) if name not in known]
    duplicated = len(known) != len(df.columns)
    if absent or duplicated:
        codes = [f"missing_column:{name}" for name in sorted(absent)] + (["duplicate_columns"] if duplicated else [])
        return spark.range(1).select(F.array(*[F.lit(c) for c in codes]).alias("problems"))
    time = F.col(ts) if dict(df.dtypes)[ts].startswith("timestamp") else event_time(ts)
    rows = df.select(time.alias("t"), F.col(target).cast("double").alias("y"), *([order] if order else []))
    facts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("t").isNull()).alias("unparsed"),
        F.count_if(~F.coalesce(F.col("y").isin(0.0, 1.0), F.lit(True))).alias("other"),
        F.count_if(F.col("y") == 0).alias("negatives"),
        F.count_if(F.col("y") == 1).alias("positives"),
    )
    backwards = F.lit(0)
    if order:
        flagged = identity.out_of_order(rows.withColumn("u", ts_micros("t")), "u", order)
        backwards = flagged.agg(F.count_if("out_of_order")).scalar()
    smallest = F.least("negatives", "positives")
    return facts.withColumn("__back", backwards).select(
        reasons(
            ("empty", F.col("n") == 0),
            ("unparseable_timestamps", F.col("unparsed") > 0),
            ("not_monotone", F.col("__back") > 0),
            ("target_not_binary", F.col("other") > 0),
            ("single_class", smallest == 0),
            ("undersized_class", (smallest > 0) & (smallest < minimum)),
        ).alias("problems")
    )


def finite_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose every feature is a finite number."""
    return df.where(reduce(lambda a, b: a & b, [is_finite(c) for c in columns]))


def feature_identity_problems(df: DataFrame, feature_set_id: str, schema_version: str) -> DataFrame:
    """Rows built by another feature set or schema than the model expects."""
    same = F.col("feature_set_id").eqNullSafe(F.lit(feature_set_id)) & F.col(
        "feature_schema_version"
    ).eqNullSafe(F.lit(schema_version))
    return df.where(~same)


# -- evidence checks ----------------------------------------------------------


def completion_evidence(completions: DataFrame) -> DataFrame:
    """Completion rows with their day and whether the evidence is valid.

    Expected columns: product_id, source_date (date text), day_start_epoch,
    day_end_epoch, trade_pages_complete and optionally page_count, trade_count,
    completed_through.
    """
    day = F.expr("try_cast(source_date AS date)")
    start = F.unix_seconds(day.cast("timestamp"))
    valid = (
        (F.col("trade_pages_complete") == F.lit(True))
        & (F.length("product_id") > 0)
        & (F.col("day_start_epoch") == start)
        & (F.col("day_end_epoch") == start + 86_400)
    )
    for count in ("page_count", "trade_count"):
        if count in completions.columns:
            valid = valid & (F.col(count).isNull() | (F.col(count) >= 0))
    if "completed_through" in completions.columns:
        done = F.col("completed_through").cast("timestamp")
        valid = valid & (done.isNull() | (F.unix_seconds(done) == start + 86_400))
    return completions.withColumns({"day": day, "valid": F.coalesce(valid, F.lit(False))})


def partition_evidence(partitions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Partitions with `problem`: partition_unverified, checksum_mismatch, or null.

    `stored` holds (path, sha256) of files that can be read; a partition with a
    local path must be there and match, otherwise its receipt must match.
    """
    digest = F.coalesce(F.col("sha256").rlike("^[0-9a-fA-F]{64}$"), F.lit(False))
    receipt = F.col("verified_receipt")
    receipt_ok = F.coalesce(
        (receipt["success"] == F.lit(True))
        & (receipt["remote_path"] == F.col("remote_path"))
        & (receipt["sha256"] == F.col("sha256"))
        & receipt["revision"].rlike("^[0-9a-fA-F]{40}$"),
        F.lit(False),
    )
    by_receipt = F.when(~receipt_ok, "partition_unverified")
    if stored is None or "local_path" not in partitions.columns:
        return partitions.withColumn("problem", F.when(~digest, "partition_unverified").otherwise(by_receipt))
    found = stored.select(F.col("path").alias("local_path"), F.col("sha256").alias("__actual"))
    joined = partitions.join(found, "local_path", "left")
    local = F.when(F.col("__actual").isNull(), "partition_unverified").when(
        F.col("__actual") != F.lower("sha256"), "checksum_mismatch"
    )
    problem = F.when(~digest, "partition_unverified").otherwise(
        F.when(F.col("local_path").isNotNull(), local).otherwise(by_receipt)
    )
    return joined.withColumn("problem", problem).drop("__actual")


# -- audit --------------------------------------------------------------------


def _codes(df: DataFrame, *pairs: tuple[str, Column]) -> DataFrame:
    """Distinct codes whose condition holds for some row: one aggregation, one small result."""
    row = df.agg(*[F.count_if(F.coalesce(cond, F.lit(False))).alias(f"c{i}") for i, (_, cond) in enumerate(pairs)])
    hits = reasons(*[(code, F.col(f"c{i}") > 0) for i, (code, _) in enumerate(pairs)])
    return row.select(F.explode(hits).alias("code"))


def _interval_micros(df: DataFrame) -> DataFrame:
    return df.select(ts_micros("start").alias("start"), ts_micros("end").alias("end"))


def _well_formed(df: DataFrame) -> DataFrame:
    return df.where(F.col("start").isNotNull() & F.col("end").isNotNull() & (F.col("start") < F.col("end")))


def book_codes(states: DataFrame, arrival: str = "arrival") -> DataFrame:
    """Failure codes of book states listed in `arrival` order."""
    at = ts_micros("observed_through")
    malformed = reduce(
        lambda a, b: a | b,
        [F.col(c).isNull() for c in ("observed_through", "best_bid", "best_ask", "sequence_start", "sequence_end")],
    )
    ordered = identity.out_of_order(
        states.withColumn("__at", at).where(F.col("__at").isNotNull()), "__at", arrival
    )
    return _codes(
        states,
        ("crossed_bbo", F.col("best_bid") > F.col("best_ask")),
        ("invalid_book_state", F.col("sequence_start") > F.col("sequence_end")),
        ("malformed_book_evidence", malformed),
    ).unionByName(_codes(ordered, ("out_of_order_book_state", F.col("out_of_order"))))


def trade_codes(trades: DataFrame, arrival: str = "arrival") -> DataFrame:
    malformed = reduce(
        lambda a, b: a | b, [F.col(c).isNull() for c in ("event_time", "trade_id", "price", "size")]
    )
    ordered = identity.out_of_order(
        trades.withColumn("__at", ts_micros("event_time")).where(F.col("__at").isNotNull()), "__at", arrival
    )
    copies = identity.duplicate_count(trades.where(F.col("trade_id").isNotNull()), ["trade_id"])
    return (
        _codes(
            trades,
            ("non_positive_trade", (F.col("price") <= 0) | (F.col("size") <= 0)),
            ("malformed_trade_evidence", malformed),
        )
        .unionByName(_codes(ordered, ("out_of_order_event_time", F.col("out_of_order"))))
        .unionByName(_codes(copies, ("duplicate_trade_ids", F.col("n_duplicates") > 0)))
    )


def join_codes(ticks: DataFrame, cuts: DataFrame, merged: bool = False) -> DataFrame:
    """Failure codes of trades joined to books, against gaps and exclusions (microseconds; `merged`: disjoint already)."""
    seen, at = ts_micros("book_observed_through"), ts_micros("timestamp")
    rows = ticks.withColumns({"__seen": seen, "__at": at})
    crossing = flag_overlap(rows.where(F.col("__seen").isNotNull()), cuts, (), "__seen", "__at", name="__crosses", merged=merged)
    other = (
        F.col("segment_id").isNotNull() & F.col("book_segment_id").isNotNull()
        & (F.col("segment_id") != F.col("book_segment_id"))
        if "book_segment_id" in ticks.columns
        else F.lit(False)
    )
    second = F.floor(F.col("__at") / F.lit(MICROS)) * F.lit(MICROS)
    return _codes(
        rows, ("missing_causal_join_evidence", F.col("__seen").isNull() | F.col("__at").isNull())
    ).unionByName(
        _codes(
            crossing,
            ("book_state_leakage", F.col("__seen") >= second),
            ("causal_join_segment_mismatch", other),
            ("causal_join_crosses_gap", F.col("__crosses")),
        )
    )


def audit_dataset(
    spark: SparkSession,
    book_intervals: DataFrame,
    trades: DataFrame | None = None,
    book_states: DataFrame | None = None,
    incidents: DataFrame | None = None,
    exclusions: DataFrame | None = None,
    label_windows: DataFrame | None = None,
    joined_ticks: DataFrame | None = None,
    completions: DataFrame | None = None,
    partitions: DataFrame | None = None,
    minimum_seconds: int = MINIMUM_SECONDS,
    arrival: str = "arrival",
) -> tuple[DataFrame, DataFrame]:
    """The report (one row) and its per-day evidence.

    Interval frames have timestamp columns `start` and `end`. A day without valid
    trade-completion evidence counts no seconds.
    """
    nothing = spark.createDataFrame([], "start timestamp, end timestamp")
    raw = {
        "book": _interval_micros(book_intervals),
        "gap": _interval_micros(incidents if incidents is not None else nothing),
        "cut": _interval_micros(exclusions if exclusions is not None else nothing),
    }
    failures = [
        _codes(df, ("malformed_interval_evidence", F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end"))))
        for df in raw.values()
    ]
    base, gap, cut = (stage(_well_formed(df)) for df in raw.values())
    blocked = interval_union(gap.unionByName(cut))  # merged once, for all that ask
    valid = interval_subtract(base, blocked, merged=True)

    if partitions is not None:
        problems = partition_evidence(partitions)
        failures.append(problems.where(F.col("problem").isNotNull()).select(F.col("problem").alias("code")).distinct())
    if book_states is not None:
        failures.append(book_codes(book_states, arrival))
    if trades is not None:
        failures.append(trade_codes(trades, arrival))
    if joined_ticks is not None:
        failures.append(join_codes(joined_ticks, blocked, merged=True))
    if label_windows is not None:
        windows = _interval_micros(label_windows)
        crossing = flag_overlap(_well_formed(windows), blocked, name="__crosses", merged=True)
        failures.append(_codes(crossing, ("label_window_crosses_excluded_interval", F.col("__crosses"))))
        broken = F.col("start").isNull() | F.col("end").isNull() | (F.col("start") >= F.col("end"))
        failures.append(_codes(windows, ("malformed_label_window", broken)))

    days = split_by_day(base).select("day").distinct()
    seconds = split_by_day(valid).groupBy("day").agg(covered_seconds().alias("valid_seconds"))
    if completions is not None:
        evidence = completion_evidence(completions)
        failures.append(_codes(evidence, ("invalid_trade_completion_evidence", ~F.col("valid"))))
        complete = evidence.where("valid").select("day").distinct().withColumn("trade_pages_complete", F.lit(True))
    else:
        complete = spark.createDataFrame([], "day date, trade_pages_complete boolean")
    per_day = (
        days.join(seconds, "day", "left")
        .join(complete, "day", "left")
        .withColumn("trade_pages_complete", F.coalesce("trade_pages_complete", F.lit(False)))
        .withColumn(
            "valid_seconds",
            F.when(F.col("trade_pages_complete"), F.coalesce("valid_seconds", F.lit(0))).otherwise(0).cast("bigint"),
        )
    )
    for df, name in ((gap, "gap_incidents"), (cut, "exclusions")):
        touched = split_by_day(df).groupBy("day").agg(F.count(F.lit(1)).alias(name))
        per_day = per_day.join(touched, "day", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    totals = {}
    if trades is not None:
        dated = trades.where(F.col("event_time").isNotNull())
        daily = dated.groupBy(F.to_date("event_time").alias("day"), "trade_id").agg(
            F.count(F.lit(1)).alias("n"), F.min("event_time").alias("first"), F.max("event_time").alias("last")
        )
        by_day = daily.groupBy("day").agg(
            F.sum("n").alias("trade_count"), F.min("first").alias("first_event"),
            F.max("last").alias("last_event"), F.sum(F.col("n") - 1).alias("duplicate_count"),
        )
        per_day = per_day.join(by_day, "day", "left").fillna(0, ["trade_count", "duplicate_count"])
        copies = identity.duplicate_count(trades.where(F.col("trade_id").isNotNull()), ["trade_id"])
        totals["duplicate_count"] = F.coalesce(copies.agg(F.max("n_duplicates")).scalar(), F.lit(0))
        ends = dated.agg(F.struct(F.min("event_time").alias("a"), F.max("event_time").alias("b")).alias("e")).scalar()
        totals["__events"] = ends
    if book_states is not None:
        observed = book_states.where(F.col("observed_through").isNotNull())
        sequences = observed.groupBy(F.to_date("observed_through").alias("day")).agg(
            F.min(F.least("sequence_start", "sequence_end")).alias("sequence_min"),
            F.max(F.greatest("sequence_start", "sequence_end")).alias("sequence_max"),
        )
        per_day = per_day.join(sequences, "day", "left")
        totals["__sequence"] = observed.agg(
            F.struct(
                F.min(F.least("sequence_start", "sequence_end")).alias("a"),
                F.max(F.greatest("sequence_start", "sequence_end")).alias("b"),
            ).alias("s")
        ).scalar()
    per_day = stage(per_day)
    failures.append(_codes(per_day, ("trade_pages_complete", ~F.col("trade_pages_complete"))))
    qualified = per_day.agg(F.coalesce(F.sum("valid_seconds"), F.lit(0)).alias("qualified_seconds"))
    failures.append(_codes(qualified, ("qualified_seconds_below_minimum", F.col("qualified_seconds") < minimum_seconds)))

    codes = reduce(lambda a, b: a.unionByName(b), failures)
    found = codes.agg(F.array_sort(F.collect_set("code")).alias("failures")).scalar()
    span = base.agg(F.floor((F.max("end") - F.min("start")) / F.lit(MICROS))).scalar()
    report = qualified.withColumns(
        {"calendar_span_seconds": F.coalesce(span, F.lit(0)), "failures": found, **totals}
    ).withColumn("status", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL"))
    if "__events" in totals:
        report = report.withColumns({"first_event": F.col("__events.a"), "last_event": F.col("__events.b")})
    if "__sequence" in totals:
        report = report.withColumns({"sequence_min": F.col("__sequence.a"), "sequence_max": F.col("__sequence.b")})
    return report.drop("__events", "__sequence"), per_day


def combine_reports(reports: DataFrame, minimum_seconds: int = MINIMUM_SECONDS) -> DataFrame:
    """One report over several days' reports; the minimum is tested on the sum."""
    total = reports.agg(
        F.sum("qualified_seconds").alias("qualified_seconds"),
        F.sum("calendar_span_seconds").alias("calendar_span_seconds"),
        F.sum("duplicate_count").alias("duplicate_count"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.min("sequence_min").alias("sequence_min"),
        F.max("sequence_max").alias("sequence_max"),
    )
    inherited = reports.select(F.explode("failures").alias("code")).agg(F.collect_set("code")).scalar()
    short = F.when(
        F.col("qualified_seconds") < minimum_seconds, F.array(F.lit("qualified_seconds_below_minimum"))
    ).otherwise(F.array().cast("array<string>"))
    failures = F.sort_array(F.array_union(F.coalesce(inherited, F.array().cast("array<string>")), short))
    return total.withColumn("failures", failures).withColumn(
        "status", F.when(F.size("failures") == 0, "PASS").otherwise("FAIL")
    )


def inventory_missing(
    listing: DataFrame, start: str, end: str, kinds: Sequence[str] = ("dump", "sidecar")
) -> DataFrame:
    """Requested days without a non-empty file of every kind; `listing` has day, kind, size."""
    spark = listing.sparkSession
    wanted = spark.range(1).select(
        F.explode(F.expr(f"sequence(date'{start}', date'{end}', interval 1 day)")).alias("day")
    ).withColumn("kind", F.explode(F.array(*[F.lit(k) for k in kinds])))
    present = listing.where(F.col("size") > 0).select(F.col("day").cast("date").alias("day"), "kind")
    return wanted.join(present.distinct(), ["day", "kind"], "left_anti")


