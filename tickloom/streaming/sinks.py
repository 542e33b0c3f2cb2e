"""Streaming sinks: idempotent read models, message log, NDJSON mirror."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickloom.sources.tables import first_of_each, stamped
from tickloom.streaming.key_index import KeyIndex

KEYS = {"features": "product_id", "outcomes": "feature_id", "predictions": "event_id"}
MIRROR_LINES = 100


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """Rows as key and JSON value, ready for a message log."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def to_log(df: DataFrame, kind: str, topic: str, servers: str, checkpoint: str) -> StreamingQuery:
    """Publish features, outcomes or predictions; offsets advance after delivery."""
    return (
        as_messages(df, KEYS[kind]).writeStream.format("kafka")
        .options(**{"kafka.bootstrap.servers": servers, "topic": topic, "checkpointLocation": checkpoint})
        .start()
    )


def read_model_batch(path: str, key: str, order: Sequence[str], stamp: str | None = None, **index):
    """A batch handler that appends only keys the table does not hold yet; the first write in log `order` wins.

    Each batch is its own folder, overwritten if the batch is repeated. Stored rows are never read: `KeyIndex` below
    `path` tells which keys are there, from the buckets that the batch's keys fall in (`index`: its settings).
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        known = KeyIndex(batch.sparkSession, f"{path.rstrip('/')}/_keys", **index)
        new = known.unseen(first_of_each(batch, key, order), key, batch_id)
        stamped(new, stamp).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        known.add(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/batch={batch_id}"), key, batch_id)

    return handle


def to_read_model(
    stream: DataFrame, path: str, key: str, order: Sequence[str], checkpoint: str, stamp: str | None = None,
    trigger: dict | None = None, **index,
) -> StreamingQuery:
    """Project a stream into a keyed table; `order` is the log position that decides between equal keys. A rebuild is a new checkpoint read from the start."""
    writer = stream.writeStream.foreachBatch(read_model_batch(path, key, order, stamp, **index))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()


def mirror_ndjson(stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Copy a stream to NDJSON segments of at most a hundred lines."""
    return (
        stream.writeStream.format("json")
        .option("path", path)
        .option("maxRecordsPerFile", MIRROR_LINES)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
