import json
import tempfile

import pytest
from pyspark.sql import functions as F

from tickloom.operators.identity import sequence_gaps
from tickloom.plans import pipelines
from tickloom.sources import manifest as mf
from tickloom.sources import tables as tb
from tickloom.sources import ticks as src


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def line(second, price="1.5", product="A", **extra):
    return json.dumps({"product_id": product, "timestamp": f"2026-04-06T15:00:{second:02d}.123456789Z", "price": price,
                       "best_bid": "1.0", "best_ask": "2.0", **extra})


def test_ndjson_is_merged_deduplicated_and_cleaned(spark):
    root = folder()
    open(f"{root}/b.ndjson", "w").write("\n".join([line(2), "{oops", "", line(1), line(1, "x")]) + "\n")
    open(f"{root}/a.ndjson", "w").write("\n".join([line(1, volume_24_h="9"), line(3)]) + "\n")
    open(f"{root}/.hidden.ndjson", "w").write(line(9) + "\n")
    open(f"{root}/note.txt", "w").write(line(8) + "\n")
    out = src.with_arrival_number(src.read_ndjson(spark, root)).orderBy("arrival").collect()
    assert [(r["ts_us"] // 1_000_000 % 60, r["arrival"]) for r in out] == [(1, 0), (2, 1), (3, 2)]
    assert out[0]["ts_us"] % 1_000_000 == 123456 and out[0]["price"] == 1.5


def test_envelopes_and_sequence_gaps(spark):
    tick = {"product_id": "A", "price": "1", "best_bid": "1", "best_ask": "2"}
    rows = [(i, json.dumps({"timestamp": "2026-01-01T00:00:00Z", "sequence_num": s, "events": [{"tickers": [tick, {**tick, "price": None}]}]}))
            for i, s in enumerate((1, 2, 5, 6))]
    flat = src.flatten_envelopes(spark.createDataFrame(rows, "arrival long, value string"))
    assert flat.count() == 4
    gaps = sequence_gaps(flat.withColumn("session", F.lit("s")), chunk_rows=2).orderBy("arrival").collect()
    assert [r["missing"] for r in gaps] == [0, 0, 2, 0]


def test_tables_by_suffix_and_partitions(spark):
    root = folder()
    df = spark.createDataFrame([("A", "x", "2026-04-24", i) for i in range(4)], "product_id string, source string, source_date string, h int")
    df = df.withColumn("event_time", F.timestamp_seconds(F.unix_seconds(F.lit("2026-04-24").cast("timestamp")) + F.col("h") * 3600))
    tb.write_hourly(df, root, "trades", "event_time")
    back = tb.read_history(spark, root, "trades", ["2026-04-24"])
    assert back.count() == 4 and {str(r["hour"]) for r in back.collect()} == {"0", "1", "2", "3"}
    assert tb.hourly_manifest(df.withColumn("kind", F.lit("trades")), "event_time").where("rows = 0").count() == 20
    assert [r[0] for r in tb.incomplete_days(df, df.where("false")).collect()] == ["2026-04-24"]
    df.select("product_id", "h").write.option("header", True).csv(f"{root}/t.csv")
    assert tb.read_by_extension(spark, f"{root}/t.csv", ["h"]).count() == 4
    with pytest.raises(ValueError, match=r"\['nope'\]"):
        tb.read_by_extension(spark, f"{root}/t.csv", ["nope"])
    with pytest.raises(ValueError, match="unsupported"):
        tb.read_by_extension(spark, f"{root}/t.bin")
    digests = mf.file_digests(spark, f"{root}/raw")
    assert digests.count() == digests.select("sha256").distinct().count() >= 4


def test_manifest_id_is_stable_and_ignores_creation_time(spark):
    row = spark.createDataFrame([(1, "a", None, "now")], "b int, a string, c string, created_at string")
    again = row.select("created_at", "c", "a", "b").withColumn("created_at", F.lit("later"))
    ids = {mf.canonical_id(row).first()["manifest_id"], mf.canonical_id(again).first()["manifest_id"]}
    assert len(ids) == 1
    import hashlib

    assert ids == {hashlib.sha256(b'{"a":"a","b":1}').hexdigest()}


def test_history_to_features_job(spark):
    root = folder()
    base = "2026-04-24"
    second = F.unix_seconds(F.lit(base).cast("timestamp"))
    books = spark.range(200).select(
        F.lit("feed").alias("source"), F.lit("P").alias("product_id"), F.timestamp_seconds(second + F.col("id")).alias("observed_through"),
        F.lit(99).cast("decimal(18,8)").alias("best_bid"), F.lit(1).cast("decimal(18,8)").alias("bid_size"),
        F.lit(101).cast("decimal(18,8)").alias("best_ask"), F.lit(3).cast("decimal(18,8)").alias("ask_size"),
        F.when(F.col("id") < 100, 0).otherwise(1).cast("bigint").alias("segment_id"), F.lit(base).alias("source_date"),
    )
    trades = spark.range(198).select(
        F.lit("tape").alias("source"), F.lit("P").alias("product_id"), F.format_string("%04d", F.col("id")).alias("trade_id"),
        F.timestamp_micros((second + F.col("id") + 1) * 1_000_000 + 500_000).alias("event_time"),
        (100 + F.col("id") % 3).cast("decimal(18,8)").alias("price"), F.lit(1).cast("decimal(18,8)").alias("size"),
        F.lit("buy").alias("reported_side"), F.lit(base).alias("source_date"),
    )
    tb.write_hourly(books, root, "book_states", "observed_through")
    tb.write_hourly(trades, root, "trades", "event_time")
    out = pipelines.materialize_history(spark, root, "microstructure_v1").collect()
    assert {r["segment_id"] for r in out} == {0, 1} and all(r["book_imbalance"] == -0.5 for r in out)
    # no window reaches across the segment: the first trades of segment 1 start over
    first = min((r for r in out if r["segment_id"] == 1), key=lambda r: r["timestamp"])
    assert first["log_return"] == 0.0 and first["vol_60s"] == 0.0
    outputs = pipelines.materialize_segmented_features(tb.read_history(spark, root, "trades"), tb.read_history(spark, root, "book_states"))
    written = {r["feature_set_id"]: r["rows"] for r in pipelines.write_feature_sets(outputs, folder()).collect()}
    assert written["core_v1"] == written["microstructure_v1"] == len(out)
    with pytest.raises(ValueError, match="want outputs"):
        pipelines.write_feature_sets({"core_v1": trades}, folder())
