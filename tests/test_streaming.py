import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from test_features import make_ticks

from tickloom import schemas
from tickloom.operators import features as ft
from tickloom.operators.identity import with_identity
from tickloom.plans import lineage
from tickloom.sources import tables
from tickloom.sources import ticks as src
from tickloom.streaming import joins, sinks
from tickloom.streaming.features import FeatureStream


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write_batches(rows, root, size):
    from datetime import datetime, timezone

    for i in range(0, len(rows), size):
        with open(f"{root}/{i:06d}.ndjson", "w") as fh:
            for p, ts, arrival, price, bid, ask, bs, asz in rows[i : i + size]:
                at = datetime.fromtimestamp(ts / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
                fh.write(json.dumps({"product_id": p, "timestamp": at, "price": repr(price), "best_bid": repr(bid),
                                     "best_ask": repr(ask), "arrival": arrival}) + "\n")
            fh.write("\n{broken\n")


def test_stream_equals_batch(spark):
    streams, rows = make_ticks(12, 260, ("A",), (0, 0.25, 0.5, 1.0, 2.0), jumps=False)
    # a second pass over older times opens a new epoch; some ticks come twice
    rows = rows[:180] + [(r[0], r[1], 1000 + i, *r[3:]) for i, r in enumerate(rows[179:180])] + [
        (r[0], r[1] - 40_000_000_000, 2000 + i, *r[3:]) for i, r in enumerate(rows[:80])
    ]
    source, state = folder(), folder()
    write_batches(rows, source, 100)
    schema = StructType([*schemas.TICK.fields, StructField("arrival", LongType())])
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(source, pathGlobFilter="*.ndjson")
    ticks, _ = src.split_ticks(raw)
    spec = ft.core_v1()
    stream = FeatureStream(state, "boot", spec)
    staged = set(lineage.staged())
    query = stream.start(ticks, f"{state}/features", f"{state}/outcomes", f"{state}/checkpoint", {"availableNow": True})
    query.awaitTermination()
    assert set(lineage.staged()) == staged  # triggers leave no staged table

    batch, _ = src.split_ticks(spark.read.schema(schema).json(source, pathGlobFilter="*.ndjson"))
    whole = with_identity(batch, "boot")
    wanted = ft.rolling_features(whole, spec, keys=("product_id", "stream_epoch")).collect()
    names = [*spec.columns, "stream_id", "timestamp"]
    got = {r["feature_id"]: r for r in spark.read.parquet(f"{state}/features").collect()}
    assert set(got) == {r["feature_id"] for r in wanted}
    for r in wanted:
        for n in names:
            a, b = got[r["feature_id"]][n], r[n]
            assert a == b or abs(a - b) < 1e-9, n
    labels = {r["feature_id"]: r["future_vol_60s"] for r in spark.read.parquet(f"{state}/outcomes").collect()}
    expected = {r["feature_id"]: r["future_vol_60s"] for r in wanted if r["future_vol_60s"] is not None}
    assert set(labels) == set(expected) and len(expected) > 30
    assert all(abs(labels[k] - v) < 1e-9 for k, v in expected.items())
    with pytest.raises(FileNotFoundError, match="position"):
        stream.process(batch, 9)  # state that is gone is an error, not a fresh start
    drained = {r["feature_id"] for r in stream.drain(spark, 2).collect()}
    complete = ft.rolling_features(whole, spec, keys=("product_id", "stream_epoch"), drain_tail=True, labelled_only=True)
    last = complete.where("stream_epoch = 1").select("feature_id").collect()
    assert drained == {r[0] for r in last} - set(labels)


def test_read_model_keeps_the_first_write(spark):
    source, out = folder(), folder()
    event = {"event_id": "t:0:1", "feature_ts": "2026-01-01T00:00:00Z", "score": 0.5}
    for i, rows in enumerate(([event, {"event_id": ""}], [{**event, "score": 0.9}, {**event, "event_id": "t:0:2"}])):
        with open(f"{source}/{i}.json", "w") as fh:
            fh.writelines(json.dumps({"value": json.dumps(r)}) + "\n" for r in rows)
        os.utime(f"{source}/{i}.json", (1_000_000 + i, 1_000_000 + i))  # a file source goes by modification time
    log = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).json(source)
    good, _ = src.parse_predictions(log)
    query = sinks.to_read_model(good, f"{out}/t", "event_id", ("source_offset", "score"), f"{out}/c", trigger={"availableNow": True})
    query.awaitTermination()
    rows = {r["event_id"]: r for r in spark.read.parquet(f"{out}/t").collect()}
    assert set(rows) == {"t:0:1", "t:0:2"} and rows["t:0:1"]["score"] == 0.5
    assert rows["t:0:1"]["feature_ts"] == "2026-01-01T00:00:00.000000+00:00"


def test_first_write_in_log_order_within_a_batch(spark):
    rows = [("k", 0, i, float(i)) for i in (7, 3, 5)] + [("q", 1, 2, 1.0), ("q", 0, 9, 2.0), (None, 0, 0, 0.0), ("old", 0, 1, 1.0)]
    batch = spark.createDataFrame(rows, "event_id string, source_partition int, source_offset long, score double")
    old = spark.createDataFrame([("old",)], "event_id string")
    new = tables.insert_or_ignore(old, batch.repartition(3), "event_id", ("source_partition", "source_offset"))
    assert {(r["event_id"], r["score"]) for r in new.collect()} == {("k", 3.0), ("q", 2.0)}


def test_stream_join_dedupe_and_mirror(spark):
    p, o, out = folder(), folder(), folder()
    at = lambda s: f"2026-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    with open(f"{p}/0.json", "w") as fh:
        fh.writelines(json.dumps({"feature_id": f"f{i}", "feature_ts": at(i * 30), "score": 0.1}) + "\n" for i in range(40))
    with open(f"{o}/0.json", "w") as fh:
        fh.writelines(json.dumps({"feature_id": f"f{i}", "feature_ts": at(i * 30), "vol_spike": 1}) + "\n" for i in range(0, 40, 2))
    predictions = spark.readStream.schema("feature_id string, feature_ts string, score double").json(p)
    outcomes = spark.readStream.schema(
        "feature_id string, feature_ts string, future_vol_60s double, vol_spike int, label_schema string").json(o)
    q = joins.join_outcome_stream(predictions, outcomes).writeStream.format("memory").queryName("joined").outputMode(
        "append").option("checkpointLocation", f"{out}/c1").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.table("joined").collect()
    matched = {r["feature_id"] for r in rows if r["vol_spike"] == 1}
    assert matched == {f"f{i}" for i in range(0, 40, 2)}
    late = {r["feature_id"] for r in rows if r["vol_spike"] is None}
    assert late and late <= {f"f{i}" for i in range(1, 40, 2)}

    ticks = predictions.withColumn("ts", F.to_timestamp("feature_ts"))
    both = joins.drop_redelivered_stream(ticks, key=["score"])
    q = sinks.mirror_ndjson(both.select("feature_id"), f"{out}/mirror", f"{out}/c2", {"availableNow": True})
    q.awaitTermination()
    assert spark.read.json(f"{out}/mirror").count() == 1
    messages = sinks.as_messages(spark.read.schema("feature_id string, score double").json(p), "feature_id").first()
    assert messages["key"].startswith("f") and json.loads(messages["value"])["score"] == 0.1
