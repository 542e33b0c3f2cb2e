"""Reading ticks: NDJSON files, a message log, websocket envelopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.exprs import event_time, is_finite
from tickloom.operators.identity import drop_redelivered
from tickloom.schemas import ENVELOPE, OUTCOME, PREDICTION, TICK

_NUMBERS = ("price", "best_bid", "best_ask", "bid_size", "ask_size")


def cast_ticks(raw: DataFrame) -> DataFrame:
    """Text ticks as typed columns with `ts` and `ts_us`; what cannot be parsed is null."""
    numbers = {c: F.expr(f"try_cast({c} AS double)") for c in _NUMBERS if c in raw.columns}
    return raw.withColumns({**numbers, "ts": event_time("timestamp")}).withColumn(
        "ts_us", F.unix_micros("ts")
    )


def valid_tick() -> Column:
    """A usable tick has a product, a time, and finite price, bid and ask."""
    return (
        F.col("product_id").isNotNull() & F.col("ts_us").isNotNull()
        & is_finite("price") & is_finite("best_bid") & is_finite("best_ask")
    )


def split_ticks(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed valid ticks, and the rejected rows."""
    typed = cast_ticks(raw)
    return typed.where(valid_tick()), typed.where(~F.coalesce(valid_tick(), F.lit(False)))


def read_ndjson(spark: SparkSession, paths: str | Sequence[str], dedupe: bool = True) -> DataFrame:
    """Ticks of NDJSON files as one stream, `arrival` being (time, file, position) order.

    Hidden files and other suffixes are skipped, as are blank and malformed lines.
    Copies of a tick at one instant are dropped.
    """
    lines = (
        spark.read.schema(T.StructType([*TICK.fields, T.StructField("_bad", T.StringType())]))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_bad")
        .option("pathGlobFilter", "*.ndjson")
        .option("recursiveFileLookup", "true")
        .json(list(paths) if not isinstance(paths, str) else paths)
        # the id grows with the position inside a file split
        .withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__line": F.monotonically_increasing_id()})
    )
    good, _ = split_ticks(lines.where(F.col("_bad").isNull()).drop("_bad"))
    placed = good.withColumn("arrival", F.struct("ts_us", "__file", "__block", "__line"))
    if dedupe:
        placed = drop_redelivered(placed)
    return placed.drop("__file", "__block", "__line")


def with_arrival_number(ticks: DataFrame, slice_us: int = 3_600_000_000) -> DataFrame:
    """Replace a structured `arrival` by its position in the whole stream."""
    from tickloom.functions import scan

    chunked = ticks.withColumn("__chunk", F.floor(F.col("ts_us") / F.lit(slice_us)))
    numbered = scan.row_index(chunked, [], "__chunk", ["arrival"], "__n")
    return numbered.withColumn("arrival", F.col("__n")).drop("__n", "__chunk")


def parse_messages(log: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """JSON messages as columns next to topic, partition, offset and publish time; bad JSON is null."""
    return log.withColumn("__m", F.from_json(F.col(value).cast("string"), schema)).drop(value)


def read_log(
    spark: SparkSession, topic: str, servers: str, starting: str = "earliest", max_per_trigger: int | None = None,
    streaming: bool = True,
) -> DataFrame:
    """A message log as a (streaming) frame; needs the Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(
        **{"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}
    )
    if max_per_trigger and streaming:
        reader = reader.option("maxOffsetsPerTrigger", max_per_trigger)
    return reader.load()


def ticks_from_log(log: DataFrame) -> DataFrame:
    """Typed ticks of a log; malformed messages are skipped."""
    parsed = parse_messages(log, TICK).where(F.col("__m").isNotNull())
    keep = [c for c in ("topic", "partition", "offset") if c in parsed.columns]
    good, _ = split_ticks(parsed.select(*keep, "__m.*"))
    return good.withColumn("arrival", F.col("offset")) if "offset" in keep else good


def flatten_envelopes(messages: DataFrame, value: str = "value", ingest_mode: str = "live") -> DataFrame:
    """Ticks of websocket envelopes, stamped with the envelope's time and provenance.

    Ticks without price, bid, ask or time are rejected.
    """
    parsed = messages.withColumn("__e", F.from_json(F.col(value), ENVELOPE))
    rows = (
        parsed.select(
            *[c for c in messages.columns if c != value],
            F.col("__e.timestamp").alias("timestamp"),
            F.col("__e.sequence_num").alias("sequence_num"),
            F.explode("__e.events").alias("__event"),
        )
        .withColumn("__t", F.explode("__event.tickers"))
        .drop("__event")
    )
    flat = rows.select(
        *[c for c in rows.columns if c != "__t"], F.col("__t.product_id").alias("product_id"),
        F.col("__t.price").alias("price"), F.col("__t.best_bid").alias("best_bid"),
        F.col("__t.best_ask").alias("best_ask"), F.col("__t.volume_24_h").alias("volume_24_h"),
        F.col("__t.best_bid_quantity").alias("bid_size"), F.col("__t.best_ask_quantity").alias("ask_size"),
        F.lit(ingest_mode).alias("ingest_mode"),
    )
    usable = (
        F.col("price").isNotNull() & F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull()
        & (F.length(F.coalesce("timestamp", F.lit(""))) > 0)
    )
    return flat.where(usable)


def parse_events(log: DataFrame, schema: T.StructType, key: str, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Messages with a non-empty key, and the rejected ones (bad JSON or no key)."""
    parsed = log.withColumn("__m", F.from_json(F.col(value).cast("string"), schema))
    keyed = F.coalesce(F.length(F.col(f"__m.{key}")) > 0, F.lit(False))
    return parsed.where(keyed).select("__m.*"), parsed.where(~keyed).drop("__m")


def parse_predictions(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parse_events(log, PREDICTION, "event_id")


def parse_outcomes(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parse_events(log, OUTCOME, "feature_id")


NON_MODEL_COLUMNS = ("feature_id", "stream_epoch", "stream_id", "ingest_mode", "future_vol_60s", "vol_spike")


def model_rows(features: DataFrame, published: str | None = None) -> DataFrame:
    """Model input: identity and labels dropped, `ts` from the publish time or the event time."""
    rows = features.drop(*[c for c in NON_MODEL_COLUMNS if c in features.columns])
    event = event_time("timestamp")
    return rows.withColumn("ts", F.coalesce(F.col(published).cast("timestamp"), event) if published else event)
