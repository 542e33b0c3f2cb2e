"""Whole jobs: history to features, replay of days, published reports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.exprs import ts_micros
from tickloom.operators import asof, book, profile
from tickloom.operators import features as ft
from tickloom.plans.lineage import stage
from tickloom.sources import manifest, tables

HISTORY_KEYS = ("product_id", "source_date", "segment_id")


def history_ticks(trades: DataFrame, states: DataFrame, strict: bool = True) -> DataFrame:
    """Trades joined to books per product, day and segment, as feature input.

    Decimal prices and sizes become doubles. Days do not share windows.
    """
    number = lambda df, names: df.withColumns({n: F.col(n).cast("double") for n in names})
    joined = asof.join_trades_to_books(
        number(trades, ["price", "size"]),
        number(states, ["best_bid", "best_ask", "bid_size", "ask_size"]),
        keys=("product_id", "source_date"),
        strict=strict,
    )
    return joined.withColumns({"ts_us": ts_micros("timestamp"), "arrival": F.col("trade_id")})


def materialize_segmented_features(
    trades: DataFrame, states: DataFrame, feature_sets: Sequence[ft.FeatureSet] | None = None, strict: bool = True,
    labelled_only: bool = True, **options,
) -> dict[str, DataFrame]:
    """Every feature set over the joined ticks; no window crosses a segment or a day."""
    ticks = stage(history_ticks(trades, states, strict))
    sets = feature_sets or tuple(ft.FEATURE_SETS.values())
    return {
        spec.feature_set_id: ft.rolling_features(
            ticks, spec, keys=HISTORY_KEYS, labelled_only=labelled_only, **options
        )
        for spec in sets
    }


def write_feature_sets(outputs: dict[str, DataFrame], root: str) -> DataFrame:
    """Publish the feature sets under the digest of their content: (feature_set_id, rows, content_sha256, path, reused).

    A set is written to a hidden folder, digested, moved to `part-<digest>` and marked. Only marked folders count (see
    `published_feature_sets`), so a write that is killed leaves nothing visible. The same content again reuses what is
    there after its digest has been checked; content that no longer has its digest is an error.
    """
    wanted = set(ft.FEATURE_SETS)
    if set(outputs) != wanted:
        raise ValueError(f"want outputs for {sorted(wanted)}, not {sorted(outputs)}")
    rows = []
    for name, df in outputs.items():
        spark, folder = df.sparkSession, f"{root.rstrip('/')}/features/feature_set={name}"
        draft = f"{folder}/_draft-{uuid.uuid4().hex}"
        try:
            df.write.parquet(draft)
            written = spark.read.schema(df.schema).parquet(draft)
            digest = manifest.merkle_root(written).first()["digest"]
            path = f"{folder}/part-{digest}"
            reused = tables.exists(spark, f"{path}/_published")
            if reused:
                found = manifest.merkle_root(spark.read.schema(df.schema).parquet(path)).first()["digest"]
                if found != digest:
                    raise ValueError(f"{path} does not hold what its digest says")
            else:
                tables.remove(spark, path)  # left by a write that ended before its mark
                tables.move(spark, draft, path)
                spark.createDataFrame([(digest,)], "value string").coalesce(1).write.text(f"{path}/_published")
            rows.append((name, written_rows(spark, path, df.schema), digest, path, reused))
        finally:
            tables.remove(spark, draft)
    return spark.createDataFrame(rows, "feature_set_id string, rows bigint, content_sha256 string, path string, reused boolean")


def written_rows(spark: SparkSession, path: str, schema) -> int:
    return spark.read.schema(schema).parquet(path).count()


def published_feature_sets(spark: SparkSession, root: str) -> list[str]:
    """Paths of the published outputs, sorted."""
    out = []
    for name in ft.FEATURE_SETS:
        folder = f"{root.rstrip('/')}/features/feature_set={name}"
        out += [p for p in tables.folders(spark, folder) if p.rsplit("/", 1)[1].startswith("part-") and tables.exists(spark, f"{p}/_published")]
    return sorted(out)


def materialize_history(spark: SparkSession, root: str, feature_set_id: str, days: Sequence[str] | None = None, **options) -> DataFrame:
    """Features of one set from partitioned history; incomplete days are an error."""
    spec = ft.feature_set(feature_set_id)
    trades = tables.read_history(spark, root, "trades", days)
    states = tables.read_history(spark, root, "book_states", days)
    holes = tables.incomplete_days(trades, states).collect()
    if holes:
        raise ValueError(f"days without trades or book states: {sorted(r['day'] for r in holes)}")
    return materialize_segmented_features(trades, states, [spec], **options)[feature_set_id]


def process_replay_days(
    days: DataFrame, anchors: DataFrame, checkpoints: DataFrame, deltas: DataFrame, metadata: DataFrame,
    source: str, source_revision: str, strict: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Book states and annotated deltas of all requested product-days, in storage layout."""
    kept, day_deltas, covered = book.load_replay_rows(days, anchors, checkpoints, deltas, metadata)
    bounds = days.select("product_id", F.col("source_date").cast("string").alias("source_date")).distinct()
    midnight = F.col("source_date").cast("date").cast("timestamp")
    bounds = bounds.withColumns(
        {"day_start": midnight, "day_end": midnight + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")}
    )
    states = stage(book.replay_book(kept, day_deltas, covered, bounds, strict))
    layout = [
        F.lit(source).alias("source"), "product_id", "observed_through", "sequence_start", "sequence_end", "best_bid",
        "bid_size", "best_ask", "ask_size", "segment_id", "changes_json",
        F.lit(source_revision).alias("source_revision"), "source_date",
    ]
    annotated = asof.attach_state(day_deltas, states, ("product_id", "source_date"))
    changes = annotated.withColumns(
        {
            "observed_through": F.col("changed_second"), "sequence_start": F.col("source_sequence_num_start"),
            "sequence_end": F.col("source_sequence_num_end"), "changes_json": F.to_json("changes"),
        }
    )
    return states.withColumn("changes_json", F.lit("[]")).select(*layout), changes.select(*layout)


def export_profile(df: DataFrame, out: str, target: str = "vol_spike", ts: str = "ts_us", order: Sequence[str] = ()) -> None:
    """Profile artifacts; an existing folder is never overwritten."""
    numeric = profile.numeric_columns(df)
    wanted = [c for c in ("log_return", "vol_60s", "spread_bps", "trade_intensity_60s") if c in df.columns]
    one = lambda frame: frame.coalesce(1).write.mode("errorifexists")  # noqa: E731 - a handful of rows
    one(profile.profile(df, target, ts)).json(f"{out}/profile")
    one(profile.non_finite(df, numeric)).json(f"{out}/non_finite")
    one(profile.arrival_percentiles(df, ts, order)).json(f"{out}/inter_arrival")
    one(profile.gap_summary(df, ts, order)).json(f"{out}/gaps")
    one(profile.autocorrelation(df, [c for c in (target, "log_return") if c in df.columns], ts)).json(f"{out}/autocorrelation")
    one(profile.daily_means(df, [target], ts).orderBy("day")).option("header", True).csv(f"{out}/daily_prevalence")
    if len(numeric) > 1:
        one(profile.correlations(df, numeric)).option("header", True).csv(f"{out}/correlations")
    if wanted:
        one(profile.daily_means(df, wanted, ts).orderBy("day")).option("header", True).csv(f"{out}/daily_feature_means")


def export_quality(report: DataFrame, per_day: DataFrame, out: str) -> None:
    """The audit as JSON and as readable text, one row per day."""
    report.coalesce(1).write.mode("overwrite").json(f"{out}/quality")
    per_day.coalesce(1).write.mode("overwrite").json(f"{out}/quality_days")
    head = report.select(
        F.concat_ws(
            "\n", F.concat(F.lit("# Audit of the history: "), F.col("status")), F.lit(""),
            F.concat(F.lit("Seconds that qualify: "), F.col("qualified_seconds").cast("string")),
            F.concat(F.lit("Seconds from first to last day: "), F.col("calendar_span_seconds").cast("string")), F.lit(""),
            F.lit("## Codes"), F.concat_ws("\n", F.transform("failures", lambda c: F.concat(F.lit("- "), c))),
        ).alias("value"),
        F.lit("0").alias("k"),
    )
    days = per_day.select(
        F.concat_ws("\n", F.lit(""), F.concat(F.lit("### "), F.col("day").cast("string")),
                    F.concat(F.lit("- "), F.to_json(F.struct(*[c for c in per_day.columns if c != "day"])))).alias("value"),
        F.col("day").cast("string").alias("k"),
    )
    head.unionByName(days).coalesce(1).sortWithinPartitions("k").select("value").write.mode("overwrite").text(f"{out}/quality_text")
