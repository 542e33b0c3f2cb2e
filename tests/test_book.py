import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tickloom import schemas
from tickloom.operators import book

DAY = datetime(2026, 4, 24, tzinfo=timezone.utc)


def at(s):
    return DAY + timedelta(seconds=s)


def anchor(s, seq, bids=None, asks=None, best=None, product="P"):
    bids = bids or {D("90000.00"): D("1.25")}
    asks = asks or {D("90000.10"): D("0.75")}
    b, a = best or (max(bids), min(asks))
    return (product, at(s), seq, b, a, bids, asks)


def delta(s, seq, changes, best, product="P"):
    return (product, at(s), seq, seq, *best, changes)


BEST = (D("90000.00"), D("90000.10"))


def unit(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("source_date", F.lit("2026-04-24"))


def run(spark, anchors, deltas, gaps=(), start=0, end=10, strict=True, incidents=False):
    meta = [("P", at(a), at(b), "gap", 0, None) for a, b in gaps]
    days = spark.createDataFrame(
        [("P", "2026-04-24", at(start), at(end))],
        "product_id string, source_date string, day_start timestamp, day_end timestamp",
    )
    args = (
        unit(spark, anchors, schemas.ANCHOR), unit(spark, deltas, schemas.DELTA),
        unit(spark, meta, schemas.REPLAY_METADATA), days,
    )
    if incidents:
        return {(r["incident"]) for r in book.replay_incidents(*args).collect()}
    out = book.replay_book(*args, strict=strict).withColumn("s", F.unix_seconds("observed_through")).collect()
    base = int(DAY.timestamp())
    return {r["s"] - base: (r["best_bid"], r["bid_size"], r["best_ask"], r["ask_size"], r["segment_id"]) for r in out}


def test_levels_are_replaced_removed_and_carried(spark):
    got = run(
        spark, [anchor(0, 100)],
        [delta(1, 101, [("bid", D("89999.90"), D("2")), ("bid", D("90000.00"), D("0"))], (D("89999.90"), D("90000.10"))),
         delta(4, 102, [("offer", D("90000.05"), D("3"))], (D("89999.90"), D("90000.05")))],
        end=6,
    )
    assert sorted(got) == list(range(7))
    assert got[0] == (D("90000.00"), D("1.25"), D("90000.10"), D("0.75"), 0)
    assert got[3] == (D("89999.90"), D("2"), D("90000.10"), D("0.75"), 0)
    assert got[6] == (D("89999.90"), D("2"), D("90000.05"), D("3"), 0)


def test_gap_ends_the_state_until_a_new_anchor(spark):
    late = delta(9, 500, [("bid", D("90000.00"), D("9"))], BEST)
    got = run(spark, [anchor(0, 100)], [late], gaps=[(3, 6)], end=12)
    assert sorted(got) == [0, 1, 2]
    got = run(spark, [anchor(0, 100), anchor(8, 400)], [late], gaps=[(3, 6)], end=12)
    assert sorted(got) == [0, 1, 2, 8, 9, 10, 11, 12]
    assert got[2][4] == 0 and got[8][4] == 1 and got[12][1] == D("9")


def test_day_that_opens_inside_a_gap_starts_segment_one(spark):
    got = run(spark, [anchor(-5, 90), anchor(4, 100)], [], gaps=[(-5, 2)], end=5)
    assert {s: v[4] for s, v in got.items()} == {4: 1, 5: 1}


def test_opening_anchor_before_the_day_and_its_deltas(spark):
    got = run(
        spark, [anchor(-3, 90)],
        [delta(-3, 91, [("bid", D("90000.00"), D("7"))], BEST), delta(-1, 92, [("bid", D("90000.00"), D("5"))], BEST)],
        end=1,
    )
    assert {s: v[1] for s, v in got.items()} == {0: D("5"), 1: D("5")}


@pytest.mark.parametrize(
    "anchors,deltas,code",
    [
        ([anchor(5, 1)], [], "missing_anchor"),
        ([anchor(0, 100, best=(D("1"), D("2")))], [], "bbo_mismatch"),
        ([anchor(0, 100)], [delta(1, 100, [], BEST)], "sequence_regression"),
        ([anchor(0, 100)], [delta(1, 101, [("ask", D("1"), D("1"))], BEST)], "invalid_change"),
        ([anchor(0, 100)], [delta(1, 101, [("bid", D("90000.10"), D("1"))], BEST)], "crossed_book"),
        ([anchor(0, 100)], [delta(1, 101, [("bid", D("90000.00"), D("0"))], BEST)], "empty_side"),
    ],
)
def test_untrustworthy_sources_fail_closed(spark, anchors, deltas, code):
    assert run(spark, anchors, deltas, incidents=True) == {code}
    with pytest.raises(Exception, match=code):
        run(spark, anchors, deltas)
    assert all(s < 1 for s in run(spark, anchors, deltas, strict=False))


def test_random_replay_matches_a_plain_walk(spark):
    rng = random.Random(5)
    anchors, deltas, gaps = [], [], [(40, 55), (120, 121), (300, 310)]
    bids, asks = {D(100): D(1)}, {D(200): D(1)}
    state, want, seg, fresh, live = None, {}, 0, False, False
    seq = 0
    for s in range(0, 400):
        if any(a <= s < b for a, b in gaps):
            state, fresh, live = None, True, False
            continue
        if s % 90 == 0:
            seq += 1
            bids, asks = {D(100 - rng.randint(0, 3)): D(2), D(90): D(1)}, {D(200): D(2)}
            anchors.append(anchor(s, seq, dict(bids), dict(asks)))
            if fresh:
                seg, fresh = seg + 1, False
            live = True
        if rng.random() < 0.5:
            for _ in range(rng.randint(1, 2)):
                seq += 1
                side, price, qty = rng.choice(("bid", "offer")), D(rng.randint(91, 105)), D(rng.randint(0, 3))
                price = price if side == "bid" else price + 95
                probe = dict(bids if side == "bid" else asks)
                probe.pop(price, None)
                if qty:
                    probe[price] = qty
                if not probe:
                    continue
                if live and s > 0:
                    if side == "bid":
                        bids = probe
                    else:
                        asks = probe
                deltas.append(delta(s, seq, [(side, price, qty)], (max(bids), min(asks))))
        if live:
            state = (max(bids), bids[max(bids)], min(asks), asks[min(asks)], seg)
            want[s] = state
    got = run(spark, anchors, deltas, gaps, end=399)
    assert got == want


def test_rows_for_a_day(spark):
    anchors = spark.createDataFrame(
        [anchor(-90000, 1), anchor(-10, 2), anchor(-10, 3), anchor(50, 9)], schemas.ANCHOR
    )
    checkpoints = spark.createDataFrame([anchor(50, 11), anchor(3600, 12)], schemas.ANCHOR).withColumnRenamed(
        "anchor_second", "checkpoint_hour"
    )
    deltas = spark.createDataFrame([delta(-1, 4, [], BEST), delta(60, 10, [], BEST)], schemas.DELTA)
    meta = spark.createDataFrame([("P", at(-100), at(20), "gap", 1, None), ("P", at(-900), at(-800), "gap", 1, None)],
                                 schemas.REPLAY_METADATA)
    days = spark.createDataFrame([("P", "2026-04-24")], "product_id string, source_date string")
    kept, day_deltas, covered = book.load_replay_rows(days, anchors, checkpoints, deltas, meta)
    assert sorted(r["source_sequence_num"] for r in kept.collect()) == [3, 11, 12]
    assert [r["source_sequence_num_start"] for r in day_deltas.collect()] == [10]
    assert covered.count() == 1


def test_a_dense_run_is_dealt_to_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(book, "LEAST_ROWS", 100, raising=False)
    monkeypatch.setattr(book, "PIECE", 5, raising=False)
    rng = random.Random(3)
    bids, asks = {D("90"): D("1")}, {D("110"): D("1")}
    deltas, want, second = [], {}, 1
    for seq in range(101, 1301):
        second += rng.choice((0, 0, 1, 2))
        side, held, price = rng.choice((("bid", bids, D(90 - rng.randrange(9))), ("offer", asks, D(110 + rng.randrange(9)))))
        quantity = D(0) if rng.random() < 0.4 and (set(held) - {price}) else D(rng.randrange(1, 9))
        held.pop(price, None)
        if quantity:
            held[price] = quantity
        deltas.append(delta(second, seq, [(side, price, quantity)], (max(bids), min(asks))))
        want[second] = (max(bids), bids[max(bids)], min(asks), asks[min(asks)])
    days = spark.createDataFrame(
        [("P", "2026-04-24", at(0), at(second))], "product_id string, source_date string, day_start timestamp, day_end timestamp"
    )
    start = anchor(0, 100, {D("90"): D("1")}, {D("110"): D("1")})
    out = book.replay_events(
        unit(spark, [start], schemas.ANCHOR), unit(spark, deltas, schemas.DELTA), unit(spark, [], schemas.REPLAY_METADATA), days
    ).withColumn("task", F.spark_partition_id()).collect()
    base = int(DAY.timestamp())
    got = {r["at_us"] // 1_000_000 - base: (r["best_bid"], r["bid_size"], r["best_ask"], r["ask_size"]) for r in out}
    assert got.pop(0) == (D("90"), D("1"), D("110"), D("1"))
    assert got == want and {r["incident"] for r in out} == {None}
    assert len({r["task"] for r in out}) > 1  # one run, yet not one task
