"""Selection by position: exact against sorted lists, ties and nulls included."""

import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions.select import first_rows, hashed_sample, kth_smallest


@pytest.mark.parametrize("k", [1, 2, 150, 399, 400, 401, 900])
def test_kth_smallest_is_exact(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.randrange(-50, 50), rng.randrange(-(2**63), 2**63), 7]) for _ in range(400)] + [None] * 5
    df = spark.createDataFrame([(v,) for v in values], "v long").repartition(5)
    held = sorted(v for v in values if v is not None)
    want = held[k - 1] if k <= len(held) else None
    assert kth_smallest(df, "v", k) == (want, len(held) if want is None else sum(v < want for v in held))


@pytest.mark.parametrize("k", [1, 30, 200, 203, 208, 500])
def test_first_rows_keep_ties_exact(spark, k):
    rng = random.Random(3)
    rows = [(i, rng.choice([5, 5, rng.randrange(20)])) for i in range(200)] + [(200 + i, None) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, v long").repartition(7)
    got = {r["id"] for r in first_rows(df, "v", k, [F.col("id").desc()]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, -r[0]))
    assert got == {i for i, _ in order[:k]}


def test_hashed_sample_is_bounded_and_steady(spark):
    df = spark.range(5_000)
    some = {r["id"] for r in hashed_sample(df, F.col("id"), 700).collect()}
    assert 600 < len(some) <= 700
    assert some == {r["id"] for r in hashed_sample(df.repartition(9), F.col("id"), 700).collect()}
    assert hashed_sample(df, F.col("id"), 5_000).count() == 5_000
    assert hashed_sample(df.where("false"), F.col("id"), 10).count() == 0
