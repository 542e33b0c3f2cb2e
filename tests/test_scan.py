"""Value ranges of the ladder."""

from pyspark.sql import functions as F

from tickloom.functions import scan


def test_a_dominant_value_does_not_draw_the_edges_to_itself(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") < 19_000, 0.0).otherwise(F.col("id") * 0.5).alias("x"))
    ladder = scan.value_ladder(rows, "x", {"n": F.lit(1).cast("bigint")}, chunks=16)
    per_chunk = [r["count"] for r in ladder.groupBy("__chunk").count().collect()] if "__chunk" in ladder.columns else None
    steps = rows.groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    sizes = [r["count"] for r in scan.with_value_chunk(steps, steps, "x", "c", 16).groupBy("c").count().collect()]
    assert sum(sizes) == 1001 and max(sizes) <= 2 * 1001 / 16
    assert per_chunk is None or max(per_chunk) <= 2 * 1001 / 16
    top = ladder.orderBy(F.desc("x")).first()
    assert top["cum_n"] == 20_000


def test_ranges_hold_equally_many_rows_with_one_dense_hour(spark):
    import random

    from pyspark.sql import functions as F

    from tickloom.functions import scan
    from tickloom.operators import splits

    rng = random.Random(4)
    hour = 3_600_000_000
    rows = [(i, rng.randrange(hour) if i % 10 else rng.randrange(2000 * hour)) for i in range(20_000)]
    df = spark.createDataFrame(rows, "i long, ts_us long").repartition(4)
    sizes = [r["count"] for r in scan.order_chunk(df, "ts_us").groupBy("__chunk").count().collect()]
    assert len(sizes) >= 16 and max(sizes) <= 2 * len(rows) / len(sizes)
    place = {i: n for n, (_, i) in enumerate(sorted((t, i) for i, t in rows))}
    for width in (None, hour, 300 * hour):
        got = splits.with_position(df, order=["i"], chunk_us=width)
        assert got.where(F.col("position") >= 0).count() == len(rows)
        assert {r["i"]: r["position"] for r in got.collect()} == place
