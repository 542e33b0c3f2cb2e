"""Distribution drift between a reference and a current period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import ratio
from tickloom.plans.lineage import stage

DRIFT_LIMIT = 0.1
DATASET_SHARE = 0.5
SKEW_LIMIT = 4.0


def _long(df: DataFrame, columns: Sequence[str], side: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])
    return (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*", F.lit(side).alias("side"))
        .where(F.col("value").isNotNull() & ~F.isnan("value"))
    )


def wasserstein(reference: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: area between the two distribution functions over the reference deviation.

    Both samples become one ladder of distinct values with running counts; no
    sample is collected or sorted in one place.
    """
    both = _long(reference, columns, "reference").unionByName(_long(current, columns, "current"))
    one = lambda side: F.when(F.col("side") == side, 1).otherwise(0).cast("bigint")
    ladder = stage(
        scan.value_ladder(both, "value", {"ref": one("reference"), "cur": one("current")}, ["feature"])
    )
    steps = scan.next_row(ladder, ["feature"], "__chunk", ["value"], {"next_value": F.col("value")})
    totals = both.groupBy("feature").agg(
        F.sum(one("reference")).alias("n_ref"),
        F.sum(one("current")).alias("n_cur"),
        F.stddev_pop(F.when(F.col("side") == "reference", F.col("value"))).alias("deviation"),
    )
    sized = scan.join_null_safe(steps, totals, ["feature"])
    gap = F.abs(F.try_divide("cum_ref", "n_ref") - F.try_divide("cum_cur", "n_cur"))
    return (
        sized.groupBy("feature")
        .agg(
            F.sum(gap * (F.col("next_value") - F.col("value"))).alias("__area"),
            F.max("deviation").alias("__dev"),
        )
        .select(
            "feature",
            F.coalesce("__area", F.lit(0.0)).alias("wasserstein"),
            (F.coalesce("__area", F.lit(0.0)) / F.greatest(F.col("__dev"), F.lit(0.001))).alias("drift_score"),
        )
    )


def jensen_shannon(reference: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Jensen-Shannon distance (natural logarithm) between two category distributions; one row."""
    tag = lambda df, side: df.select(F.col(column).cast("string").alias("v"), F.lit(side).alias("side"))
    both = tag(reference, "r").unionByName(tag(current, "c")).where(F.col("v").isNotNull())
    counts = both.groupBy("v").agg(
        F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c")
    )
    totals = both.agg(
        F.struct(F.count_if(F.col("side") == "r").alias("r"), F.count_if(F.col("side") == "c").alias("c")).alias("t")
    ).scalar()
    shares = counts.withColumn("t", totals).select(
        ratio("r", "t.r").alias("p"), ratio("c", "t.c").alias("q")
    )
    middle = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.when(x > 0, x * F.ln(F.try_divide(x, middle))).otherwise(0.0)
    divergence = F.sum(part(F.col("p")) + part(F.col("q"))) / 2
    return shares.agg(F.sqrt(F.greatest(divergence, F.lit(0.0))).alias("js_distance"))


def drift_report(
    reference: DataFrame, current: DataFrame, numeric: Sequence[str], target: str | None = None,
    limit: float = DRIFT_LIMIT,
) -> DataFrame:
    """Drift score and flag per column; the binary target is compared by category shares."""
    rows = wasserstein(reference, current, numeric).select("feature", "drift_score")
    if target is not None:
        rows = rows.unionByName(
            jensen_shannon(reference, current, target).select(
                F.lit(target).alias("feature"), F.col("js_distance").alias("drift_score")
            )
        )
    return rows.withColumn("drifted", F.col("drift_score") >= limit)


def drift_share(report: DataFrame, share: float = DATASET_SHARE) -> DataFrame:
    return report.agg(
        F.count_if("drifted").alias("drifted_columns"),
        F.count(F.lit(1)).alias("columns"),
        (F.count_if("drifted") / F.count(F.lit(1))).alias("drift_share"),
        (F.count_if("drifted") / F.count(F.lit(1)) >= share).alias("dataset_drift"),
    )


def zscore(value: Column, mean: Column, scale: Column) -> Column:
    """|z| against training statistics; a constant training column counts as scale 1."""
    safe = F.when(scale == 0, F.lit(1.0)).otherwise(scale)
    return F.abs(F.try_divide(value - mean, safe))


def training_statistics(training: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column, one row with `mean_*` and `scale_*`."""
    return training.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"scale_{c}") for c in columns],
    )


def feature_skew(
    live: DataFrame, training: DataFrame, columns: Sequence[str], limit: float = SKEW_LIMIT,
    edges: Sequence[float] = (0.5, 1, 2, 3, 4, 6, 10),
) -> DataFrame:
    """Per feature: rows, mean and maximum |z|, rows at or over the limit, histogram counts."""
    stats = training_statistics(training, columns)
    packed = stats.select(F.struct(*stats.columns).alias("s")).scalar()
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                zscore(F.col(c).cast("double"), F.col(f"__s.mean_{c}"), F.col(f"__s.scale_{c}")).alias("z"),
            )
            for c in columns
        ]
    )
    long = live.withColumn("__s", packed).select(F.explode(pairs).alias("p")).select("p.*")
    return long.groupBy("feature").agg(
        F.count("z").alias("n"),
        F.avg("z").alias("mean_abs_z"),
        F.max("z").alias("max_abs_z"),
        F.count_if(F.col("z") >= limit).alias("skewed_rows"),
        F.array(*[F.count_if(F.col("z") <= edge) for edge in edges]).alias("cumulative_histogram"),
    )
