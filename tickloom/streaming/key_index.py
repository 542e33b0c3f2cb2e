"""Which keys a growing table holds already, asked without reading the table.

Keys lie in hash buckets. A generation holds the keys of all batches up to a point, one folder a bucket, with a Bloom filter of
each bucket; later batches add small folders until the next compaction, which writes a new generation, with as many buckets as
its number of keys asks for, and then publishes it by a marker. A batch reads the filters of the buckets its keys fall in, and
the keys of those buckets only where a filter says maybe. Everything lives in the table's folder, which executors share; a
repeated batch writes its own folders again.

    _keys/gen=G/bucket=B, _keys/bloom=G/bucket=B, _keys/batch=N/bucket=B, _keys/current
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys a bucket is meant to hold, bits of a filter per key, probes per key.
BUCKET_KEYS, BITS_PER_KEY, PROBES = 1_000_000, 12, 8
#: Batches between compactions.
COMPACT_EVERY = 100


def _probes(h: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a key's bits, from the two halves of its 64-bit hash."""
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((low + np.uint64(i) * high) % np.uint64(bits)).astype(np.int64)


def bloom_bits(hashes: np.ndarray) -> bytes:
    bits = max(64, -(-len(hashes) * BITS_PER_KEY // 64) * 64)
    held = np.zeros(bits, bool)
    for at in _probes(hashes.astype(np.int64).view(np.uint64), bits):
        held[at] = True
    return np.packbits(held, bitorder="little").tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    held = np.frombuffer(bits, np.uint8)
    out = np.ones(len(hashes), bool)
    for at in _probes(hashes.astype(np.int64).view(np.uint64), 8 * len(held)):
        out &= (held[at >> 3] >> (at & 7)) & 1 == 1
    return out


@dataclass
class KeyIndex:
    """Index of one table's key column, below `path`."""

    spark: SparkSession
    path: str
    compact_every: int = COMPACT_EVERY
    bucket_keys: int = BUCKET_KEYS

    def _file(self, name: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path.rstrip('/')}/{name}")
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        place, fs = self._file(name)
        return fs.exists(place)

    def _read(self, name: str, buckets: list[int], schema: str) -> DataFrame | None:
        """The folders of the wanted buckets only; None if none of them exists."""
        found = [f"{self.path}/{name}/bucket={b}" for b in buckets if self._exists(f"{name}/bucket={b}")]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*found) if found else None

    def current(self) -> dict:
        """The published generation: gen, upto (last batch it holds), buckets."""
        place, fs = self._file("current")
        if not fs.exists(place):
            return {"gen": 0, "upto": -1, "buckets": 1}
        # a text of one line, replaced as a whole
        return json.loads(self.spark.read.text(f"{self.path}/current").first()[0])

    def _publish(self, state: dict) -> None:
        """A new marker folder takes the place of the old one; a reader finds either."""
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/next")
        (new, fs), (old, _) = self._file("next"), self._file("current")
        fs.delete(old, True)
        fs.rename(new, old)

    def _recover(self) -> None:
        """A marker left between delete and rename is put in place."""
        if not self._exists("current") and self._exists("next/_SUCCESS"):
            (new, fs), (old, _) = self._file("next"), self._file("current")
            fs.rename(new, old)

    @staticmethod
    def _bucket(buckets: int) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")

    def _batches(self, above: int, without: int) -> list[int]:
        place, fs = self._file("")
        if not fs.exists(place):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(place)]
        return sorted(n for n in (int(name[6:]) for name in names if name.startswith("batch=")) if n > above and n != without)

    def unseen(self, rows: DataFrame, key: str, batch_id: int) -> DataFrame:
        """Rows whose key no earlier batch has added."""
        self._recover()
        state = self.current()
        asked = rows.select(F.col(key).cast("string").alias("key")).distinct().withColumn("bucket", self._bucket(state["buckets"]))
        asked = asked.withColumn("h", F.xxhash64("key"))
        touched = [r["bucket"] for r in asked.select("bucket").distinct().collect()]  # no more than there are buckets
        known = None
        add = lambda more: more if known is None else known.unionByName(more)
        blooms = self._read(f"bloom={state['gen']}", touched, "bucket int, bits binary") if state["gen"] else None
        if blooms is not None:

            def check(_, keys: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
                if not len(keys) or not len(filters):
                    return keys.iloc[:0]
                return keys[may_hold(filters["bits"].iloc[0], keys["h"].to_numpy(np.int64))]

            maybe = asked.groupBy("bucket").cogroup(blooms.groupBy("bucket")).applyInPandas(check, "key string, bucket int, h bigint")
            maybe = maybe.select("key", "bucket")
            wanted = [r["bucket"] for r in maybe.select("bucket").distinct().collect()]
            held = self._read(f"gen={state['gen']}", wanted, "bucket int, key string")
            if held is not None:
                known = add(maybe.join(held.select("key"), "key", "left_semi").select("key"))
        for n in self._batches(state["upto"], batch_id):
            recent = self._read(f"batch={n}", touched, "bucket int, key string")
            if recent is not None:
                known = add(recent.select("key"))
        if known is None:
            return rows
        return rows.join(known.distinct().withColumnRenamed("key", "__known"), F.col(key).cast("string") == F.col("__known"), "left_anti")

    def add(self, rows: DataFrame, key: str, batch_id: int) -> None:
        """Remember the keys of a batch; compacts when enough batches have come."""
        state = self.current()
        keys = rows.select(F.col(key).cast("string").alias("key")).withColumn("bucket", self._bucket(state["buckets"]))
        keys.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={batch_id}")
        if batch_id - state["upto"] >= self.compact_every:
            self.compact(batch_id - 1)  # the batch at hand may be repeated, the ones before it may not

    def compact(self, batch_id: int) -> None:
        """One generation of all keys up to `batch_id`, then its marker; older folders go afterwards."""
        state = self.current()
        names = [f"gen={state['gen']}"] if state["gen"] else []
        batches = [n for n in self._batches(state["upto"], -1) if n <= batch_id]
        folders = [f"{self.path}/{name}" for name in [*names, *(f"batch={n}" for n in batches)]]
        keys = None
        for folder in folders:
            part = self.spark.read.schema("key string").parquet(folder)
            keys = part if keys is None else keys.unionByName(part)
        if keys is None:
            return
        total = keys.count()
        buckets = 1 << max(0, (total // self.bucket_keys).bit_length())
        gen = state["gen"] + 1
        placed = keys.distinct().withColumn("bucket", self._bucket(buckets))
        placed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/gen={gen}")
        written = self.spark.read.schema("key string, bucket int").parquet(f"{self.path}/gen={gen}")

        def bits(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"bucket": pdf["bucket"].iloc[:1], "bits": [bloom_bits(pdf["h"].to_numpy(np.int64))]})

        filters = written.select("bucket", F.xxhash64("key").alias("h")).groupBy("bucket").applyInPandas(bits, "bucket int, bits binary")
        filters.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/bloom={gen}")
        self._publish({"gen": gen, "upto": batch_id, "buckets": buckets})
        for name in [*names, f"bloom={state['gen']}", *(f"batch={n}" for n in batches)]:
            place, fs = self._file(name)
            fs.delete(place, True)
