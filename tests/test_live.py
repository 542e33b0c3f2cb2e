"""Keyed state of the live job: equal to the batch operators over many micro-batches, restarts, expiry and draining."""

import json
import os
import tempfile
import time

import pytest
from pyspark.sql.types import LongType, StructField, StructType
from test_features import make_ticks

from tickloom import schemas
from tickloom.operators import features as ft
from tickloom.operators.identity import with_identity
from tickloom.plans import lineage
from tickloom.sources import ticks as src
from tickloom.streaming.live import LiveFeatures

SCHEMA = StructType([*schemas.TICK.fields, StructField("arrival", LongType())])


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def write(rows, root, size, first=0):
    from datetime import datetime, timezone

    for i in range(0, len(rows), size):
        name = f"{root}/{first + i:06d}.ndjson"
        with open(name, "w") as fh:
            for p, ts, arrival, price, bid, ask, bs, asz in rows[i : i + size]:
                at = datetime.fromtimestamp(ts / 1e6, timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
                fh.write(json.dumps({"product_id": p, "timestamp": at, "price": repr(price), "best_bid": repr(bid), "best_ask": repr(ask),
                                     "arrival": arrival, "bid_size": repr(bs), "ask_size": repr(asz)}) + "\n")
        os.utime(name, (1_000_000 + first + i, 1_000_000 + first + i))


def ticks_of(spark, root, stream):
    reader = spark.readStream.option("maxFilesPerTrigger", 1) if stream else spark.read
    return src.split_ticks(reader.schema(SCHEMA).json(root, pathGlobFilter="*.ndjson"))[0]


def run(job, spark, source, out):
    query = job.start(ticks_of(spark, source, True), f"{out}/rows", f"{out}/checkpoint", {"availableNow": True})
    query.awaitTermination()


@pytest.fixture
def only_data(spark):
    """Timers fire in batches with data only, so that a query over what is available ends."""
    name = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


def same(got, wanted, names):
    assert set(got) == {r["feature_id"] for r in wanted}
    for r in wanted:
        for n in names:
            a, b = got[r["feature_id"]][n], r[n]
            assert a == b or abs(a - b) <= 1e-9 * max(1.0, abs(b)), (r["feature_id"], n, a, b)


@pytest.mark.parametrize("kind", ["core_v1", "multi_window_v1", "microstructure_v1"])
def test_live_equals_batch_over_restarts(spark, kind):
    _, rows = make_ticks(12, 420, ("A", "B"), (0, 0.25, 0.5, 1.0, 3.0, 20.0), jumps=True)
    # time goes back for a second pass, and some ticks come twice in a row
    again = [(r[0], r[1] - 40_000_000_000, 2000 + i, *r[3:]) for i, r in enumerate(rows[:120])]
    twice = [(r[0], r[1], 1000 + i, *r[3:]) for i, r in enumerate(rows[-1:] * 2)]
    rows = rows + twice + again
    source, out = folder(), folder()
    job = LiveFeatures("boot", ft.feature_set(kind))
    staged = set(lineage.staged())
    half = len(rows) // 2
    write(rows[:half], source, 60)
    run(job, spark, source, out)
    write(rows[half:], source, 60, half)
    run(job, spark, source, out)  # the same checkpoint: goes on where the first run ended
    assert set(lineage.staged()) == staged  # nothing is staged, whatever the number of batches

    whole = with_identity(ticks_of(spark, source, False), "boot")
    wanted = ft.rolling_features(whole, job.spec, keys=("product_id", "stream_epoch")).collect()
    written = spark.read.parquet(f"{out}/rows")
    got = {r["feature_id"]: r.asDict() for r in job.features(written).collect()}
    same(got, wanted, [*job.spec.columns, "stream_id", "stream_epoch", "timestamp", "arrival"])
    labels = {r["feature_id"]: r.asDict() for r in job.outcomes(written).collect()}
    same(labels, [r for r in wanted if r["future_vol_60s"] is not None], ["future_vol_60s", "vol_spike"])
    assert len(labels) > 30
    assert job.features(written).count() == len(got) and job.outcomes(written).count() == len(labels)


def test_lost_state_is_an_error(spark):
    _, rows = make_ticks(3, 60, ("A",), (0.5, 1.0), jumps=False)
    source, out = folder(), folder()
    job = LiveFeatures("boot", ft.core_v1())
    write(rows[:30], source, 10)
    run(job, spark, source, out)
    for root, _, files in os.walk(f"{out}/checkpoint/state"):
        for name in files:
            if name.endswith(".zip") or name.endswith(".changelog"):
                os.truncate(os.path.join(root, name), 0)
    write(rows[30:], source, 10, 30)
    with pytest.raises(Exception, match="(?i)state|rocksdb|checkpoint|changelog|zip"):
        run(job, spark, source, out)


def test_silent_products_are_drained_once_and_keep_their_numbers(spark, only_data):
    _, rows = make_ticks(5, 200, ("A",), (0.5, 1.0), jumps=False)
    source, out = folder(), folder()
    job = LiveFeatures("boot", ft.core_v1(), drain_idle_seconds=0.2)
    write(rows, source, 200)
    run(job, spark, source, out)
    time.sleep(1)
    other = [("B", *r[1:]) for r in rows[:1]]
    write(other, source, 1, 500)
    run(job, spark, source, out)  # the timer of A fires in a batch without its ticks
    whole = with_identity(ticks_of(spark, source, False).where("product_id = 'A'"), "boot")
    wanted = ft.rolling_features(whole, job.spec, keys=("product_id", "stream_epoch"), drain_tail=True, labelled_only=True).collect()
    labels = job.outcomes(spark.read.parquet(f"{out}/rows")).where("product_id = 'A'").collect()
    assert len(labels) == len({r["feature_id"] for r in labels})
    same({r["feature_id"]: r.asDict() for r in labels}, wanted, ["future_vol_60s"])


def test_an_expired_tail_keeps_the_sequence(spark, only_data):
    _, rows = make_ticks(6, 40, ("A",), (0.5,), jumps=False)
    source, out = folder(), folder()
    job = LiveFeatures("boot", ft.core_v1(), tail_ttl_seconds=0.5)
    write(rows[:20], source, 20)
    run(job, spark, source, out)
    time.sleep(1.5)
    write(rows[20:], source, 20, 20)
    run(job, spark, source, out)
    got = job.features(spark.read.parquet(f"{out}/rows")).collect()
    assert {r["feature_id"] for r in got} == {f"A:boot:0:{i}" for i in range(40)}
    first = next(r for r in got if r["feature_id"] == "A:boot:0:20")
    assert first["n_ticks_60s"] == 1 and first["log_return"] is not None
