"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

Test items are taken in blocks of at most BLOCK_ITEMS, whose n-grams go to every task; the corpus is read in place, once
for each block, and its texts are never shuffled. Every n-gram of an item is a seed. Items that share a seed with a
document and enough of whose words are in it are aligned with the window around each hit, which is as wide as a copy
over the threshold can be. A copy counts if score / best possible score >= `threshold`, so insertions, deletions and
replaced words are tolerated, as long as one n-gram of the item is intact.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. Defined cases: null, empty and blank
texts are clean; items without words match nothing; items shorter than an n-gram are sought as a whole; repeated rows
give repeated results; ties between items go to the smaller id; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import slices
from tickloom.llm.words import grams, words
from tickloom.plans.lineage import stage

#: Test items whose n-grams a task holds at once; more items are taken in further blocks.
BLOCK_ITEMS = 20_000
GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
THRESHOLD = 0.5

_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class Items:
    """Words of a block of items, and their seeds: seed value -> the (item, place) pairs `at[bounds[i]:bounds[i + 1]]`.

    `word` has the distinct words of all items; those of item i are `word[own[first[i]:first[i + 1]]]`, in order.
    """

    ids: list
    value: list[np.ndarray]
    seed: np.ndarray
    bounds: np.ndarray
    at: np.ndarray
    word: np.ndarray
    own: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple]) -> Items:
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
        found = words(pa.array([r[1] for r in rows], pa.string()), _LETTERS)
        value = [found.value[a:b] for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)]
        every = np.concatenate([np.zeros(0, np.uint64), *[_grams(v) for v in value]])
        pairs = np.array([(i, p) for i, v in enumerate(value) for p in range(len(_grams(v)))], np.int64).reshape(-1, 2)
        order = np.argsort(every, kind="stable")
        seed, first = np.unique(every[order], return_index=True)
        word, own = np.unique(found.value, return_inverse=True)
        return cls([r[0] for r in rows], value, seed, np.append(first, len(order)), pairs[order], word, own, found.bounds)

    def places(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (item, place) pairs of some seeds, and for each the position of its seed in `seeds`."""
        flat, of = _ranges(self.bounds[seeds], self.bounds[seeds + 1])
        return self.at[flat], of

    def within(self, which: np.ndarray, text: np.ndarray) -> np.ndarray:
        """The share of each item's words that are among the words of a text. It bounds the score of any alignment."""
        at = np.minimum(np.searchsorted(self.word, text), len(self.word) - 1)
        held = np.zeros(len(self.word), bool)
        held[at[self.word[at] == text]] = True
        flat, of = _ranges(self.first[which], self.first[which + 1])
        return np.bincount(of, held[self.own[flat]], len(which)) / (self.first[which + 1] - self.first[which])


def _ranges(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all ranges start..end - 1 in a row, and the range of each."""
    size = end - start
    of = np.repeat(np.arange(len(size)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size - start, size), of


def _grams(value: np.ndarray) -> np.ndarray:
    return grams(value, min(GRAM, len(value))) if len(value) else np.zeros(0, np.uint64)


def _hits(found, items: Items, sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word place, seed) of the seeds in some documents' words."""
    rows, places, seeds = [], [], []
    for k in sizes:
        g = grams(found.value, k)
        if not len(g) or not len(items.seed):
            continue
        at = np.minimum(np.searchsorted(items.seed, g), len(items.seed) - 1)
        hit = np.flatnonzero(items.seed[at] == g)
        hit = hit[found.row[hit] == found.row[hit + k - 1]]
        rows.append(found.row[hit])
        places.append(hit)
        seeds.append(at[hit])
    cat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    return cat(rows), cat(places), cat(seeds)


def _sizes(items: Items) -> list[int]:
    return sorted({min(GRAM, len(v)) for v in items.value if len(v)})


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the place in `window` after its end."""
    n = len(item)
    ramp = np.arange(n) * -GAP
    same = {v: np.where(item == v, MATCH, MISMATCH) for v in np.unique(window[np.isin(window, item)]).tolist()}
    none = np.full(n, MISMATCH)
    h = np.zeros(n, np.int64)
    shifted = np.zeros(n, np.int64)
    best, end = 0, 0
    for j, v in enumerate(window.tolist()):
        shifted[1:] = h[:-1]
        h = np.maximum(np.maximum(shifted + same.get(v, none), h + GAP), 0)
        h = np.maximum.accumulate(h + ramp) - ramp
        if (top := int(h.max())) > best:
            best, end = top, j + 1
    return best, end


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Value, start and end of each run of equal values."""
    start = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[start], start, np.append(start, len(x))[1:]


def _copies(items: Items, text: np.ndarray, place: np.ndarray, seed: np.ndarray, threshold: float) -> list[tuple[float, int]]:
    """(score, item) of the copies in one text, whose words at `place` begin the seeds `seed`."""
    near = np.unique(items.places(np.unique(seed))[0][:, 0])
    near = near[items.within(near, text) >= threshold]
    if not len(near):
        return []
    pairs, of = items.places(seed)
    kept = np.isin(pairs[:, 0], near)
    item, diagonal = pairs[kept, 0], place[of[kept]] - pairs[kept, 1]
    order = np.lexsort((diagonal, item))
    item, diagonal = item[order], diagonal[order]
    out = []
    for i, a, b in zip(*(x.tolist() for x in _runs(item)), strict=True):
        v = items.value[i]
        # a copy with more words added is under the threshold even if no word of the item is lost
        slack = int(len(v) * MATCH * (1 - threshold) / -GAP + 1e-9) + 1
        cut = np.flatnonzero(np.diff(diagonal[a:b]) > slack) + a + 1
        for low, high in zip([a, *cut.tolist()], [*cut.tolist(), b], strict=True):  # hits whose diagonals are close
            window = text[max(0, int(diagonal[low]) - slack) : int(diagonal[high - 1]) + len(v) + slack]
            # a word of the item that is not in the window cannot match, which bounds the score
            if np.isin(v, window).mean() >= threshold:
                score = align(v, window)[0] / (MATCH * len(v))
                if score >= threshold:
                    out.append((score, i))
    return out


def _matches(batches: Iterator[pa.RecordBatch], items, threshold: float) -> Iterator[pa.RecordBatch]:
    items = items.value
    sizes = _sizes(items)
    for batch in batches:
        for part in slices(batch, "text"):
            found = words(part.column(1), _LETTERS)
            row, place, seed = _hits(found, items, sizes)
            order = np.argsort(row, kind="stable")
            row, place, seed = row[order], place[order], seed[order]
            best: dict[int, list] = {}
            for r, a, b in zip(*(x.tolist() for x in _runs(row)), strict=True):
                text = found.value[found.bounds[r] : found.bounds[r + 1]]
                best[r] = _copies(items, text, place[a:b] - found.bounds[r], seed[a:b], threshold)
            top = [min(best[r], key=lambda x: (-x[0], x[1])) if best.get(r) else None for r in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len({i for _, i in best.get(r, ())}) for r in range(part.num_rows)], pa.int64()),
                 pa.array([items.ids[t[1]] if t else None for t in top], pa.int64()), pa.array([t[0] if t else None for t in top], pa.float64())],
                names=["key", "n_items", "item_id", "score"],
            )


def blocks(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> list:
    """The benchmark's blocks with their seeds, as broadcast values of bounded size."""
    context = benchmark.sparkSession.sparkContext
    bench = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).cast("string").alias("t"))
    n = max(1, -(-bench.count() // BLOCK_ITEMS))
    parts = [bench if n == 1 else bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b) for b in range(n)]
    return [context.broadcast(Items.of([tuple(r) for r in part.collect()])) for part in parts]


def contaminated(held: list, threshold: float = THRESHOLD):
    """A column function for `arrow_udf`: whether a text holds a copy of an item."""

    def run(column: pa.Array) -> pa.Array:
        flags = np.zeros(len(column), bool)
        batch = pa.RecordBatch.from_arrays([pa.nulls(len(column), pa.int64()), column], names=["key", "text"])
        for items in held:
            found = [o.column(1).to_numpy() > 0 for o in _matches(iter([batch]), items, threshold)]
            if found:
                flags |= np.concatenate(found)
        return pa.array(flags)

    return run


def score(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: id, contaminated, the best matching item and its score, number of items matched."""
    held = blocks(benchmark)
    kept = docs.select(F.col(id_col).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    schema = "key long, n_items long, item_id long, score double"
    if len(held) == 1:
        found = kept.mapInArrow(partial(_matches, items=held[0], threshold=threshold), schema)
    else:
        numbered = stage(kept.withColumn("row", F.monotonically_increasing_id()))
        each = None
        for items in held:
            one = numbered.select(F.col("row").alias("key"), "text").mapInArrow(partial(_matches, items=items, threshold=threshold), schema)
            each = one if each is None else each.unionByName(one)
        best = each.groupBy("key").agg(
            F.sum("n_items").alias("n_items"), F.max(F.struct("score", -F.col("item_id"))).alias("top")
        ).select(F.col("key").alias("row"), "n_items", F.col("top.score").alias("score"), (-F.col("top.col2")).alias("item_id"))
        found = numbered.select("row", "key").join(best, "row").drop("row")
    return found.select(F.col("key").alias("doc_id"), (F.col("n_items") > 0).alias("contaminated"), "item_id", "score", "n_items")
