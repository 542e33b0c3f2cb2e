"""Stream identity: redelivery removal, epochs, feature ids, sequence gaps.

`arrival` is the order in which ticks were received (an offset, a file position).
It is cut into chunks of `chunk_rows` arrivals so that a product holding most of
the stream is still scanned by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions import scan
from tickloom.functions.exprs import log_return
from tickloom.plans.lineage import stage

#: What makes two ticks the same delivery. The 24 h volume is not part of it.
DEDUPE_KEY = ("product_id", "ts_us", "price", "best_bid", "best_ask")

ARRIVAL_CHUNK = 1_000_000


def arrival_chunk(arrival: str = "arrival", rows: int = ARRIVAL_CHUNK) -> Column:
    return F.floor(F.col(arrival) / F.lit(rows))


def drop_redelivered(
    ticks: DataFrame, scope: Sequence[str] = (), arrival: str = "arrival", key: Sequence[str] = DEDUPE_KEY
) -> DataFrame:
    """Keep the first arrival of every key within `scope` (an epoch, a replay pass, nothing).

    An aggregate rather than a ranked window: copies collapse on the map side, so
    a group of copies holding a third of the rows never meets in one task.
    """
    group = [*scope, *[name for name in key if name not in scope]]
    rest = [name for name in ticks.columns if name not in group]
    first = ticks.groupBy(*group).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("__first"))
    return first.select(*group, "__first.*").select(*ticks.columns)


def duplicate_count(df: DataFrame, key: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows beyond the first of every `key`, per `keys` group."""
    per_key = df.groupBy(*keys, *[k for k in key if k not in keys]).agg(F.count(F.lit(1)).alias("__n"))
    return per_key.groupBy(*keys).agg(
        F.sum("__n").alias("n_rows"), F.sum(F.col("__n") - 1).alias("n_duplicates")
    )


def with_epoch(
    ticks: DataFrame, arrival: str = "arrival", ts: str = "ts_us", chunk_rows: int = ARRIVAL_CHUNK,
    keys: Sequence[str] = ("product_id",),
) -> DataFrame:
    """Add `stream_epoch`: how often event time has gone backwards so far, per product."""
    chunked = ticks.withColumn("__chunk", arrival_chunk(arrival, chunk_rows))
    within = Window.partitionBy(*keys, "__chunk").orderBy(arrival)
    running = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = lambda before: F.coalesce((F.col(ts) < before).cast("bigint"), F.lit(0))

    # chunk summary: regressions inside it, and its first and last event time
    narrow = chunked.select(*keys, "__chunk", arrival, ts).withColumn("__step", step(F.lag(ts).over(within)))
    parts = narrow.groupBy(*keys, "__chunk").agg(
        F.sum("__step").alias("__inside"),
        F.min_by(ts, arrival).alias("__head"),
        F.max_by(ts, arrival).alias("__tail"),
    )
    chunks = Window.partitionBy(*keys).orderBy("__chunk")
    entered = parts.withColumn(
        "__entry", F.coalesce((F.col("__head") < F.lag("__tail").over(chunks)).cast("bigint"), F.lit(0))
    )
    offsets = entered.select(
        *keys, "__chunk",
        (
            F.sum(F.col("__entry") + F.col("__inside")).over(
                chunks.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            )
            - F.col("__inside")
        ).alias("__offset"),
    )
    located = scan.join_null_safe(chunked, offsets, [*keys, "__chunk"]).withColumn(
        "__step", step(F.lag(ts).over(within))
    )
    return located.withColumn("stream_epoch", F.sum("__step").over(running) + F.col("__offset")).drop(
        "__chunk", "__step", "__offset"
    )


def with_identity(
    ticks: DataFrame,
    boot_id: str,
    arrival: str = "arrival",
    ts: str = "ts_us",
    chunk_rows: int = ARRIVAL_CHUNK,
) -> DataFrame:
    """Epoch, redelivery removal within the epoch, then `stream_id` and `feature_id`.

    A dropped redelivery consumes no sequence number; the sequence restarts in
    every epoch.
    """
    in_epochs = with_epoch(ticks, arrival, ts, chunk_rows)
    unique = stage(drop_redelivered(in_epochs, ["product_id", "stream_epoch"], arrival))
    chunked = unique.withColumn("__chunk", arrival_chunk(arrival, chunk_rows))
    numbered = scan.row_index(chunked, ["product_id", "stream_epoch"], "__chunk", [arrival], "seq")
    epoch = F.col("stream_epoch").cast("string")
    return numbered.drop("__chunk").withColumns(
        {
            "stream_id": F.concat_ws(":", F.lit(boot_id), epoch),
            "feature_id": F.concat_ws(
                ":", "product_id", F.lit(boot_id), epoch, F.col("seq").cast("string")
            ),
        }
    )


def with_log_return(
    ticks: DataFrame,
    keys: Sequence[str] = ("product_id",),
    order: Sequence[str] = ("ts_us", "arrival"),
    slice_us: int = 3_600_000_000,
) -> DataFrame:
    """Add the previous tick's time and price, of any age, and `log_return` (0 for the first)."""
    sliced = ticks.withColumn("__chunk", F.floor(F.col(order[0]) / F.lit(slice_us)))
    seen = scan.previous_row(
        sliced, keys, "__chunk", order, {"prev_ts_us": F.col(order[0]), "prev_price": F.col("price")}
    )
    return seen.drop("__chunk").withColumn("log_return", log_return("price", "prev_price"))


def sequence_gaps(
    messages: DataFrame,
    sequence: str = "sequence_num",
    arrival: str = "arrival",
    session: str = "session",
    chunk_rows: int = ARRIVAL_CHUNK,
) -> DataFrame:
    """Add `missing`: sequence numbers skipped since the previous message of the session."""
    chunked = messages.withColumn("__chunk", arrival_chunk(arrival, chunk_rows))
    seen = scan.previous_row(chunked, [session], "__chunk", [arrival], {"__before": F.col(sequence)})
    missing = F.when(
        F.col("__before").isNotNull() & (F.col(sequence) != F.col("__before") + 1),
        F.col(sequence) - F.col("__before") - 1,
    ).otherwise(F.lit(0))
    return seen.withColumn("missing", missing.cast("bigint")).drop("__chunk", "__before")


def out_of_order(
    rows: DataFrame,
    ts: str,
    arrival: str = "arrival",
    keys: Sequence[str] = (),
    chunk_rows: int = ARRIVAL_CHUNK,
) -> DataFrame:
    """Add `out_of_order`: event time earlier than that of the preceding row."""
    chunked = rows.withColumn("__chunk", arrival_chunk(arrival, chunk_rows))
    seen = scan.previous_row(chunked, keys, "__chunk", [arrival], {"__before": F.col(ts)})
    return seen.withColumn(
        "out_of_order", F.coalesce(F.col(ts) < F.col("__before"), F.lit(False))
    ).drop("__chunk", "__before")


def retain_minutes(ticks: DataFrame, minutes: float, ts: str = "ts_us") -> DataFrame:
    """Ticks within `minutes` of the first one."""
    first = ticks.agg(F.min(ts)).scalar()
    return ticks.where(F.col(ts) <= first + F.lit(int(minutes * 60_000_000)))
