"""Key index of the read model: exact over repeated batches and compactions, reads only the buckets it needs."""

import random
import tempfile

import numpy as np
import pytest

from tickloom.sources import tables
from tickloom.streaming import key_index as ki
from tickloom.streaming import sinks


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def test_bloom_filter_never_misses_and_rarely_errs():
    rng = np.random.default_rng(0)
    held, other = rng.integers(-(2**63), 2**63, 5000), rng.integers(-(2**63), 2**63, 5000)
    bits = ki.bloom_bits(held)
    assert ki.may_hold(bits, held).all() and ki.may_hold(bits, other).mean() < 0.02
    assert not ki.may_hold(ki.bloom_bits(held[:0]), other).any()


def test_read_model_over_many_batches(spark):
    rng = random.Random(1)
    path = folder() + "/t"
    handle = sinks.read_model_batch(path, "k", ("pos",), compact_every=3, bucket_keys=15)
    want, pos = {}, 0
    for n in range(9):
        rows = []
        for _ in range(40):
            pos += 1
            rows.append((rng.choice([f"k{rng.randrange(160)}", None]), pos, float(pos)))
        for k, at, v in rows:
            if k is not None:
                want.setdefault(k, (at, v))
        batch = spark.createDataFrame(rows, "k string, pos long, v double").repartition(3)
        handle(batch, n)
        if n in (3, 4, 7):
            handle(batch, n)  # a batch that is repeated, right after a compaction too
    got = spark.read.parquet(path).collect()
    assert len(got) == len(want) and {r["k"]: (r["pos"], r["v"]) for r in got} == want
    assert ki.KeyIndex(spark, f"{path}/_keys").current()["gen"] == 4


def test_a_batch_reads_only_its_buckets(spark, monkeypatch):
    path = folder() + "/t"
    index = ki.KeyIndex(spark, f"{path}/_keys", bucket_keys=50)
    index.add(spark.range(4000).selectExpr("cast(id AS string) AS k"), "k", 0)
    index.compact(0)
    assert index.current()["buckets"] >= 64
    read = []
    plain = ki.KeyIndex._read

    def noted(self, name, buckets, schema):
        out = plain(self, name, buckets, schema)
        read.append((name.split("=")[0], 0 if out is None else len(out.inputFiles())))
        return out

    monkeypatch.setattr(ki.KeyIndex, "_read", noted)
    asked = spark.createDataFrame([("17",), ("new-1",), ("new-2",)], "k string")
    assert {r["k"] for r in index.unseen(asked, "k", 1).collect()} == {"new-1", "new-2"}
    files = dict(read)
    assert 1 <= files["bloom"] <= 3 and 1 <= files["gen"] <= 2  # of 64 buckets and more

    fresh = spark.createDataFrame([("other",)], "k string")
    read.clear()
    assert index.unseen(fresh, "k", 1).count() == 1
    assert sum(n for name, n in read if name == "gen") == 0  # the filter says no: no keys are read


def test_an_order_is_required(spark):
    batch = spark.createDataFrame([("a", 1)], "k string, pos long")
    with pytest.raises(ValueError, match="log position"):
        tables.insert_or_ignore(batch, batch, "k", ())
