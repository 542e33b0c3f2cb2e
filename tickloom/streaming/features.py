"""Live features and delayed outcomes as a micro-batch job over the batch operators.

Every micro-batch joins the new ticks to a retained tail and runs the same sliced
window job as history does, so both paths agree by construction and one busy
product is spread over many tasks. State is a set of tables versioned by batch id:
a repeated batch overwrites its own version, so a restart after losing the driver
or an executor repeats nothing and loses nothing.

  tail/batch=N      ticks the next windows and labels can still reach
  position/batch=N  per product: epoch, next sequence number, last time and price
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.functions.exprs import micros
from tickloom.operators import features as ft
from tickloom.operators.identity import DEDUPE_KEY, drop_redelivered, with_epoch, with_log_return
from tickloom.plans.lineage import scope, stage
from tickloom.sources.tables import exists, read_or_empty

TICK_COLUMNS = (
    "product_id string, timestamp string, ts_us bigint, arrival bigint, price double, best_bid double, "
    "best_ask double, bid_size double, ask_size double, ingest_mode string"
)
IDENTITY_COLUMNS = "stream_epoch bigint, seq bigint, log_return double"
POSITION_COLUMNS = (
    "product_id string, stream_epoch bigint, next_seq bigint, ts_us bigint, price double, arrival bigint"
)


@dataclass
class FeatureStream:
    """Turns micro-batches of typed ticks into feature rows and outcome events.

    `root` is a folder all executors share. Ticks need `arrival`, increasing over
    the life of the stream (the log offset of a single-partition topic per product).
    """

    root: str
    boot_id: str
    spec: ft.FeatureSet
    horizon_seconds: float = ft.HORIZON_SECONDS
    slack_seconds: float = ft.LABEL_SLACK_SECONDS
    threshold: float = ft.SPIKE_THRESHOLD
    retention_seconds: float | None = None
    slice_seconds: float = ft.SLICE_SECONDS

    def _path(self, name: str, batch: int) -> str:
        return f"{self.root.rstrip('/')}/{name}/batch={batch}"

    def _retention(self) -> int:
        if self.retention_seconds is not None:
            return micros(self.retention_seconds)
        return micros(max(ft.RETENTION_SECONDS, self.spec.max_lookback + self.horizon_seconds))

    def process(self, batch: DataFrame, batch_id: int) -> tuple[DataFrame, DataFrame]:
        """Feature rows of the batch and outcome events it completes; also advances the state."""
        spark = batch.sparkSession
        if batch_id > 0:  # only the first batch starts from nothing
            missing = [name for name in ("tail", "position") if not exists(spark, self._path(name, batch_id - 1))]
            if missing:
                raise FileNotFoundError(f"state of batch {batch_id - 1} is gone: {', '.join(missing)}")
        tail = read_or_empty(spark, self._path("tail", batch_id - 1), f"{TICK_COLUMNS}, {IDENTITY_COLUMNS}")
        position = read_or_empty(spark, self._path("position", batch_id - 1), POSITION_COLUMNS)
        names = [field.split()[0] for field in TICK_COLUMNS.split(", ")]
        for name in names:
            if name not in batch.columns:
                kind = next(f.split()[1] for f in TICK_COLUMNS.split(", ") if f.split()[0] == name)
                batch = batch.withColumn(name, F.lit(None).cast(kind))
        new = self._identify(stage(batch.select(*names)), tail, position)

        everything = stage(tail.withColumn("__new", F.lit(False)).unionByName(new.withColumn("__new", F.lit(True))))
        rows = ft.rolling_features(
            everything, self.spec, keys=("product_id", "stream_epoch"), horizon_seconds=self.horizon_seconds,
            slack_seconds=self.slack_seconds, threshold=self.threshold,
            retention_seconds=self._retention() / 1e6, slice_seconds=self.slice_seconds, closed_by=True,
        )
        epoch = F.col("stream_epoch").cast("string")
        rows = stage(
            rows.withColumns(
                {
                    "stream_id": F.concat_ws(":", F.lit(self.boot_id), epoch),
                    "feature_id": F.concat_ws(
                        ":", "product_id", F.lit(self.boot_id), epoch, F.col("seq").cast("string")
                    ),
                }
            )
        )
        label = f"future_vol_{ft._seconds_name(self.horizon_seconds)}s"
        features = rows.where("__new").drop("__new", label, "vol_spike", "closed_by", "seq")
        first_new = new.groupBy("product_id").agg(F.min("arrival").alias("__first"))
        closed = rows.join(first_new, "product_id").where(F.col("closed_by") >= F.col("__first"))
        outcomes = closed.where(F.col(label).isNotNull()).select(
            "feature_id", "stream_epoch", "product_id", F.col("timestamp").alias("feature_ts"), label, "vol_spike",
            F.lit(f"p85-{int(self.horizon_seconds)}s-{self.threshold}-v1").alias("label_schema"), "stream_id",
        )
        self._advance(everything, position, batch_id)
        return features, outcomes

    def _identify(self, batch: DataFrame, tail: DataFrame, position: DataFrame) -> DataFrame:
        """Epoch, redelivery removal, sequence and log return, continued from the last batch."""
        # the product's last tick stands in front of the batch
        seeds = position.select(
            "product_id", "ts_us", "arrival", "price", F.col("stream_epoch").alias("__base"),
            F.lit(True).alias("__seed"),
        )
        joined = batch.unionByName(seeds, allowMissingColumns=True)
        counted = with_epoch(joined).join(
            position.select("product_id", F.col("stream_epoch").alias("__from"), "next_seq"), "product_id", "left"
        )
        counted = counted.withColumn("stream_epoch", F.col("stream_epoch") + F.coalesce("__from", F.lit(0)))
        live = stage(counted)
        unique = drop_redelivered(live.where(F.col("__seed").isNull()), ["product_id", "stream_epoch"])
        known = tail.select("stream_epoch", *DEDUPE_KEY).distinct()
        fresh = stage(unique.join(known, ["stream_epoch", *DEDUPE_KEY], "left_anti").select(*unique.columns))
        with_seeds = fresh.unionByName(live.where(F.col("__seed").isNotNull()))
        returns = with_log_return(
            with_seeds, ("product_id", "stream_epoch"), ("ts_us", "arrival"), micros(self.slice_seconds)
        ).where(F.col("__seed").isNull())
        from tickloom.functions import scan

        chunked = returns.withColumn("__chunk", F.floor(F.col("ts_us") / F.lit(micros(self.slice_seconds))))
        numbered = scan.row_index(chunked, ["product_id", "stream_epoch"], "__chunk", ["ts_us", "arrival"], "seq")
        same = F.col("stream_epoch") == F.coalesce("__from", F.lit(-1))
        seq = F.col("seq") + F.when(same, F.col("next_seq")).otherwise(F.lit(0))
        names = [f.split()[0] for f in TICK_COLUMNS.split(", ")]
        return stage(numbered.withColumn("seq", seq).select(*names, "stream_epoch", "seq", "log_return"))

    def _advance(self, everything: DataFrame, position: DataFrame, batch_id: int) -> None:
        latest = everything.groupBy("product_id").agg(
            F.max_by(F.struct("stream_epoch", "seq", "ts_us", "price", "arrival"), F.struct("stream_epoch", "seq")).alias("l")
        )
        now = latest.select(
            "product_id", "l.stream_epoch", (F.col("l.seq") + 1).alias("next_seq"), "l.ts_us", "l.price", "l.arrival"
        )
        idle = position.join(now.select("product_id"), "product_id", "left_anti")
        now.unionByName(idle).write.mode("overwrite").parquet(self._path("position", batch_id))
        reach = self._retention() + micros(self.horizon_seconds)
        ends = now.select("product_id", "stream_epoch", F.col("ts_us").alias("__end"))
        kept = everything.join(ends, ["product_id", "stream_epoch"]).where(F.col("ts_us") >= F.col("__end") - reach)
        kept.drop("__end", "__new").write.mode("overwrite").parquet(self._path("tail", batch_id))

    def start(
        self, ticks: DataFrame, features_path: str, outcomes_path: str, checkpoint: str,
        trigger: dict | None = None, **columns: Sequence[str],
    ) -> StreamingQuery:
        """Run on a streaming frame of typed ticks, writing both outputs once per batch."""

        def handle(batch: DataFrame, batch_id: int) -> None:
            with scope(batch.sparkSession):  # what a trigger stages goes when its outputs are written
                features, outcomes = self.process(batch, batch_id)
                features.write.mode("overwrite").parquet(f"{features_path}/batch={batch_id}")
                outcomes.write.mode("overwrite").parquet(f"{outcomes_path}/batch={batch_id}")

        writer = ticks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "1 second"})).start()

    def drain(self, spark: SparkSession, batch_id: int) -> DataFrame:
        """After the last batch: labels that end of input completes (with the usual slack)."""
        tail = read_or_empty(spark, self._path("tail", batch_id), f"{TICK_COLUMNS}, {IDENTITY_COLUMNS}")
        rows = ft.rolling_features(
            tail, self.spec, keys=("product_id", "stream_epoch"), horizon_seconds=self.horizon_seconds,
            slack_seconds=self.slack_seconds, threshold=self.threshold,
            retention_seconds=self._retention() / 1e6, slice_seconds=self.slice_seconds, drain_tail=True, closed_by=True,
            labelled_only=True,
        )
        epoch = F.col("stream_epoch").cast("string")
        return rows.where(F.col("closed_by").isNull()).withColumn(
            "feature_id", F.concat_ws(":", "product_id", F.lit(self.boot_id), epoch, F.col("seq").cast("string"))
        )


