"""Nearest neighbours by a hash-prefix forest.

Every tree gives a vector a long hash string (signs of random projections, one bit each, packed in a long) and keeps the
strings as sorted arrays. A query descends each tree to its longest matching prefix by binary search; then all trees
ascend together, one bit at a time, until enough candidates share a prefix with the query. Candidates are scored
exactly and the best of all trees are merged.

Largest inner products are turned into nearest directions by one more coordinate, sqrt(max norm squared - norm squared).
Equal vectors are one unit with its smallest ids, as many as a result can hold, so a vector with a third of all rows is
one entry of each array. Arrays are cut by their first bits into shards, and large shards into blocks, so a task
holds one block; query blocks are bounded as well. Only per-shard counts and per-query level counts are gathered.

How many candidates are enough is fitted: for SAMPLE queries the true neighbours are found by brute force, and the least
number that finds `recall` of them is used for all queries. Vectors without structure need a large share of all rows.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of
another length than the most common one; rows with a null id take no part; rows that repeat an id and vector count
once; ties go to the smaller id; with fewer candidates than asked for all are returned; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.plans.lineage import stage

TREES, BITS, SEED = 16, 40, 5
#: Rows of a tree's array, and queries, that a task holds at once.
BLOCK, QUERY_BLOCK = 16_384, 4_096
#: Queries that the number of candidates is fitted on, and the share of their neighbours it must find.
SAMPLE, RECALL = 128, 0.95


def valid(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vec array<float>) of the vectors that take part."""
    v = F.col(vector)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    held = vectors.where(good & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.cast("array<float>").alias("vec"))
    common = held.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return held.where(F.size("vec") == (common["d"] if common else 0))


def _hash(batches: Iterator[pa.RecordBatch], most: float, trees: int, bits: int) -> Iterator[pa.RecordBatch]:
    planes = None
    weight = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            x = np.stack([np.asarray(v, np.float32) for v in part.column(1).to_numpy(zero_copy_only=False)])
            if planes is None:
                planes = np.random.Generator(np.random.PCG64(SEED)).standard_normal((x.shape[1] + 1, trees * bits))
            y = x.astype(np.float64) / most
            y = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))])
            codes = ((y @ planes > 0).reshape(len(x), trees, bits) * weight).sum(2)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(list(codes), pa.list_(pa.int64()))],
                names=["unit", "ids", "raw", "codes"],
            )


def _vectors(raw) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), -1).astype(np.float64) if len(raw) else np.zeros((0, 0))


def _levels(key, index: pd.DataFrame, queries: pd.DataFrame, bits: int, top: int) -> pd.DataFrame:
    """For each query, how many strings of this block share its first l bits, l = top..bits."""
    codes = np.sort(index["code"].to_numpy(np.int64))
    q = queries["code"].to_numpy(np.int64)
    found = []
    for level in range(top, bits + 1):
        low = (q >> (bits - level)) << (bits - level)
        found.append(np.searchsorted(codes, low + (1 << (bits - level))) - np.searchsorted(codes, low))
    return pd.DataFrame({"query": queries["query"].to_numpy(), "counts": list(np.stack(found, 1).astype(np.int64))})


def _best(key, index: pd.DataFrame, queries: pd.DataFrame, bits: int, most: int) -> pd.DataFrame:
    """The best candidates of this block for each query, scored on the original vectors."""
    names = ["query", "unit", "score"]
    if index.empty or queries.empty:
        return pd.DataFrame({"query": pd.Series([], "int64"), "unit": pd.Series([], "int64"), "score": pd.Series([], "float64")})
    order = np.argsort(index["code"].to_numpy(np.int64), kind="stable")
    codes, units = index["code"].to_numpy(np.int64)[order], index["unit"].to_numpy(np.int64)[order]
    x = _vectors(index["raw"].to_numpy())[order]
    q, level = queries["code"].to_numpy(np.int64), queries["level"].to_numpy(np.int64)
    low = (q >> (bits - level)) << (bits - level)
    a, b = np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << (bits - level)))
    y = _vectors(queries["raw"].to_numpy())
    ids = queries["query"].to_numpy(np.int64)
    out = []
    for i in np.unique(np.stack([a, b], 1), axis=0):  # queries with the same prefix share one product
        lo, hi = int(i[0]), int(i[1])
        if lo == hi:
            continue
        rows = np.flatnonzero((a == lo) & (b == hi))
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            score = y[some] @ x[lo:hi].T
            n = min(most, hi - lo)
            if n < hi - lo:  # everything that ties with the last place stays
                edge = np.partition(score, hi - lo - n, axis=1)[:, hi - lo - n] - 1e-9
                r, c = np.nonzero(score >= edge[:, None])
            else:
                r, c = np.nonzero(np.ones_like(score, bool))
            exact = np.concatenate([(y[some[r[k : k + 8192]]] * x[lo + c[k : k + 8192]]).sum(1) for k in range(0, len(r), 8192)])
            out.append(pd.DataFrame(dict(zip(names, (ids[some[r]], units[lo + c], exact), strict=True))))
    return pd.concat(out) if out else pd.DataFrame({"query": pd.Series([], "int64"), "unit": pd.Series([], "int64"), "score": pd.Series([], "float64")})


def _true(batches: Iterator[pa.RecordBatch], sample, most: int) -> Iterator[pa.RecordBatch]:
    """Brute force of the sample against all rows: per batch the best of each query, with their strings."""
    queries, y = sample.value
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _vectors(batch.column(1).to_pylist())
        score = y @ x.T
        n = min(most, score.shape[1])
        top = np.argpartition(-score, n - 1, axis=1)[:, :n]
        r = np.repeat(np.arange(len(y)), n)
        c = top.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries[r], pa.int64()), batch.column(0).take(pa.array(c)), pa.array(score[r, c]), batch.column(2).take(pa.array(c))],
            names=["query", "unit", "score", "codes"],
        )


def search(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = TREES,
    bits: int = BITS, recall: float = RECALL,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of every row that `is_query` (a condition on `id`) selects."""
    spark = vectors.sparkSession
    rows = stage(valid(vectors, id_col, vector).distinct())
    most = k + 1
    # the smallest ids of equal vectors: the limit works in every task before rows are shuffled
    w = Window.partitionBy("vec").orderBy("id")
    kept = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    units = stage(kept.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("unit", F.monotonically_increasing_id()))
    size = units.count()
    longest = units.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))).first()[0] or 1.0
    hashed = stage(units.select("unit", "vec", "ids").mapInArrow(
        partial(_hash, most=float(np.sqrt(longest)), trees=trees, bits=bits), "unit long, ids array<long>, raw binary, codes array<long>"
    ))
    asked = stage(rows.where(is_query).join(units.select("unit", "vec"), "vec").select(F.col("id").alias("query_id"), "unit"))
    queries = stage(hashed.join(asked.select("unit").distinct(), "unit").select(F.col("unit").alias("query"), "raw", "codes"))

    cut = max(0, int(np.ceil(np.log2(max(size, 1) / BLOCK))))  # first bits that name a shard
    strings = lambda d: d.select("*", F.posexplode("codes").alias("tree", "code")).drop("codes").withColumn("shard", F.shiftright("code", bits - cut))
    index = strings(hashed.select("unit", "raw", "codes"))
    shards = stage(index.groupBy("tree", "shard").agg(F.count(F.lit(1)).alias("rows")).withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")))
    spread = index.join(shards.select("tree", "shard", "blocks"), ["tree", "shard"]).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    asking = strings(queries)

    # how many strings share the first l bits, summed over trees
    here = asking.select("query", "tree", "code", "shard").join(shards, ["tree", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    here = _query_blocks(here)
    key = ["tree", "shard", "block", "part"]
    counted = spread.select("tree", "shard", "block", "code").join(
        here.groupBy("tree", "shard", "block").agg(F.max("part").alias("parts")), ["tree", "shard", "block"]
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts"))))
    deep = counted.groupBy(*key).cogroup(here.select(*key, "query", "code").groupBy(*key)).applyInPandas(
        partial(_levels, bits=bits, top=cut), "query long, counts array<long>"
    )
    sums = deep.groupBy("query").agg(*(F.sum(F.col("counts")[i]).alias(f"l{cut + i}") for i in range(bits - cut + 1)))
    for level in range(cut):
        wide = shards.groupBy("tree", F.shiftright("shard", cut - level).alias("prefix")).agg(F.sum("rows").alias("n"))
        part = asking.select("query", "tree", F.shiftright("shard", cut - level).alias("prefix")).join(wide, ["tree", "prefix"])
        sums = sums.join(part.groupBy("query").agg(F.sum("n").alias(f"l{level}")), "query")
    sums = stage(sums.select("query", F.array(*(F.col(f"l{i}") for i in range(bits + 1))).alias("sums")))

    enough = _fit(spark, hashed, queries, sums, k, recall)
    # the deepest level at which the trees together have enough
    level = F.greatest(F.size(F.filter("sums", lambda n: n >= enough)) - 1, F.lit(0))
    leveled = asking.join(sums.select("query", level.alias("level")), "query")
    wide = F.greatest(F.lit(cut) - F.col("level"), F.lit(0))
    first = F.expr("shiftleft(shiftright(shard, w), w)")
    leveled = leveled.withColumn("w", wide).withColumn("first", first).withColumn(
        "shard", F.explode(F.sequence(F.col("first"), F.col("first") + F.expr("shiftleft(1L, w)") - 1))
    ).drop("w", "first")
    there = leveled.join(shards.select("tree", "shard", "blocks"), ["tree", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    there = stage(_query_blocks(there).select(*key, "query", "code", "level", "raw"))
    held = spread.select("tree", "shard", "block", "unit", "code", "raw").join(
        there.groupBy("tree", "shard", "block").agg(F.max("part").alias("parts")), ["tree", "shard", "block"]
    ).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts")))).drop("parts")
    found = held.groupBy(*key).cogroup(there.groupBy(*key)).applyInPandas(
        partial(_best, bits=bits, most=most), "query long, unit long, score double"
    )
    best = found.dropDuplicates(["query", "unit"]).join(units.select("unit", "ids"), "unit").select("query", "score", F.explode("ids").alias("vec_id"))
    by_score = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = best.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= most)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    each = asked.join(lists, asked.unit == lists.query).select("query_id", F.slice(F.filter("near", lambda s: s["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return each.select("query_id", F.posexplode("near").alias("pos", "s")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("s.vec_id").alias("vec_id"), F.col("s.score").alias("score")
    )


def _query_blocks(routed: DataFrame) -> DataFrame:
    """Add `part`: queries of one block are dealt so that no task holds many more than QUERY_BLOCK."""
    n = routed.groupBy("tree", "shard", "block").agg(F.count(F.lit(1)).alias("q"))
    parts = n.select("tree", "shard", "block", F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("q_parts"))
    return routed.join(parts, ["tree", "shard", "block"]).withColumn("part", F.pmod(F.xxhash64("query"), F.col("q_parts")).cast("int")).drop("q_parts")


def _fit(spark, hashed: DataFrame, queries: DataFrame, sums: DataFrame, k: int, recall: float) -> int:
    """Candidates, summed over trees, that find `recall` of the sample's true neighbours."""
    some = queries.join(sums, "query").orderBy(F.xxhash64("query")).limit(SAMPLE).toPandas()
    if some.empty:
        return 1
    sample = spark.sparkContext.broadcast((some["query"].to_numpy(np.int64), _vectors(some["raw"].to_numpy())))
    per = hashed.select("unit", "raw", "codes").mapInArrow(partial(_true, sample=sample, most=k + 1), "query long, unit long, score double, codes array<long>")
    w = Window.partitionBy("query").orderBy(F.desc("score"), "unit")
    near = per.where("query <> unit").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toPandas()
    if near.empty:
        return 1
    place = {q: i for i, q in enumerate(some["query"])}
    row = near["query"].map(place).to_numpy()
    differ = np.bitwise_xor(np.stack(near["codes"]), np.stack(some["codes"])[row])
    bits = int(len(some["sums"].iloc[0]) - 1)
    shared = bits - np.ceil(np.log2(np.maximum(differ, 0) + 1.0)).astype(int)
    shared = shared.max(axis=1)  # longest prefix that any tree shares with the true neighbour
    levels = np.stack(some["sums"])
    top = int(levels[:, 0].max())
    want = float(4 * k)
    while want < top:
        level = np.maximum((levels >= want).sum(1) - 1, 0)
        if (shared >= level[row]).mean() >= recall:
            return int(want)
        want *= 1.25
    return top + 1
