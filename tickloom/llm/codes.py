"""Vector codes by product quantisation whose nearest entry is found by slice-and-intersect bitmasks.

Components become integers floor(4096 * x); vectors are cut into equal parts; each part position has a codebook that starts
as that part of the first kept vectors and is refined by a fixed number of rounds. Everything is whole numbers, so results do
not depend on how rows are dealt out.

Nearest entry of a part: for every dimension the codebook's coordinates are sorted once, and prefix masks say which entries
come before each place (one uint64 word per 64 entries). An initial radius is the distance to a near entry, rounded up, so
the nearest entry lies within that radius in every dimension: two bisections per dimension give the range of entries inside,
the exclusive-or of two prefix masks its mask, and the masks of all dimensions ANDed the candidates. Distances are taken to
candidates only; of equal distances the lower index wins.

A round is one pass over the vectors: tasks add up their parts by entry and send at most parts x entries rows; the codebooks,
which do not grow with the data, come back to the driver. Nothing else is collected, and vectors are never shuffled.

Defined cases: vectors that are null, empty or hold null, NaN or infinite components are dropped, and so are those whose length
is not that of the first usable vector (by id, then components), a vector being usable if its length is a multiple of the
number of parts. Null ids are kept and come last. Repeated rows count each; with fewer kept vectors than entries the codebooks
are smaller; no kept vector gives an empty result. Components beyond 2 ** 40 / 4096 are held at that bound and errors that
exceed a long are held at its largest value. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.select import first_rows
from tickloom.plans.lineage import stage, unstage

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors that a task works on at once.
ROWS = 8_192
#: Components beyond this need whole numbers of any size; LIMIT is where they end.
WIDE, LIMIT = 1 << 24, 1 << 40
LARGEST = (1 << 63) - 1


def usable(vector: Column, parts: int) -> Column:
    """Not null, of a length that can be cut, and every component finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite, F.lit(False))


def whole(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of an array of doubles: int64, or Python integers where squares could pass 64 bits."""
    scaled = np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64)
    return scaled if not scaled.size or np.abs(scaled).max() <= WIDE else scaled.astype(object)


def _root_up(square: np.ndarray) -> np.ndarray:
    """A whole number whose square is at least the given one."""
    if square.dtype == object:
        return np.array([math.isqrt(int(s)) + 1 for s in square], object)
    return np.ceil(np.sqrt(square.astype(np.float64))).astype(np.int64) + 1


@dataclass
class Slices:
    """Sorted coordinates and prefix masks of one codebook, entries as rows."""

    entries: np.ndarray
    coordinates: list
    masks: np.ndarray

    @classmethod
    def of(cls, entries: np.ndarray) -> Slices:
        k, dims = entries.shape
        words = (k + 63) // 64
        coordinates, masks = [], np.zeros((dims, k + 1, words), np.uint64)
        for d in range(dims):
            order = np.argsort(entries[:, d], kind="stable")
            coordinates.append(entries[order, d])
            for place, e in enumerate(order):
                masks[d, place + 1] = masks[d, place]
                masks[d, place + 1, e // 64] |= np.uint64(1 << int(e) % 64)
        return cls(entries, coordinates, masks)

    def _squares(self, x: np.ndarray, entry: np.ndarray | int) -> np.ndarray:
        gap = x - self.entries[entry]
        return (gap * gap).sum(axis=1)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Masks (rows, words) of the entries within the radius in every dimension."""
        left = np.full((len(x), self.masks.shape[2]), ~np.uint64(0))
        for d, held in enumerate(self.coordinates):
            low = np.searchsorted(held, x[:, d] - radius, side="left")
            high = np.searchsorted(held, x[:, d] + radius, side="right")
            left &= self.masks[d, high] ^ self.masks[d, low]
        return left

    def start(self, x: np.ndarray) -> np.ndarray:
        """A near entry of each row: the one next to it along the dimension in which the entries differ most."""
        spread = [held[-1] - held[0] for held in self.coordinates]
        d = max(range(len(spread)), key=spread.__getitem__)
        order = np.argsort(self.entries[:, d], kind="stable")
        held = self.coordinates[d]
        right = np.searchsorted(held, x[:, d]).clip(1, max(len(held) - 1, 1))
        right = np.minimum(right, len(held) - 1)
        before = np.maximum(right - 1, 0)
        return order[np.where(x[:, d] - held[before] <= held[right] - x[:, d], before, right)]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row."""
        best = self._squares(x, self.start(x))
        masks = self.candidates(x, _root_up(best))
        index = np.full(len(x), len(self.entries), np.int64)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(masks[:, e // 64] & np.uint64(1 << e % 64))
            square = self._squares(x[rows], e)
            # entries come in rising order: an equal distance only replaces the bound that no entry holds yet
            better = (square < best[rows]) | ((square == best[rows]) & (index[rows] == len(self.entries)))
            index[rows[better]], best[rows[better]] = e, square[better]
        return index, best


def _rows(batches: Iterator[pa.RecordBatch], vector: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Runs of bounded length with their vectors as whole numbers (rows, length)."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            held = pc.list_flatten(part.column(vector)).to_numpy(zero_copy_only=False).astype(np.float64)
            yield part, whole(held.reshape(part.num_rows, -1))


def _sums(books: list[np.ndarray]):
    slices = [Slices.of(b) for b in books]
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("total", pa.decimal128(38, 0)), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = books[0].shape[1]
        totals = [[[0] * width for _ in b] for b in books]
        counts = np.zeros((len(books), len(books[0])), np.int64)
        for _, x in _rows(batches, 0):
            for p, book in enumerate(slices):
                piece = x[:, p * width : (p + 1) * width]
                index, _ = book.nearest(piece)
                counts[p] += np.bincount(index, minlength=counts.shape[1])
                order = np.argsort(index, kind="stable")
                first = np.flatnonzero(np.diff(index[order], prepend=-1))
                for e, added in zip(index[order][first], np.add.reduceat(piece[order], first), strict=True):
                    totals[p][e] = [a + int(b) for a, b in zip(totals[p][e], added, strict=True)]
        out = [(p, e, d, totals[p][e][d], int(counts[p, e])) for p in range(len(books)) for e in range(counts.shape[1]) if counts[p, e] for d in range(width)]
        if out:
            columns = [[row[i] for row in out] for i in range(5)]
            columns[3] = [Decimal(v) for v in columns[3]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def first_books(kept: DataFrame, id_col: str, vector: str, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, one array (entries, width) a part; empty without vectors."""
    rows = first_rows(kept.select(id_col, vector), id_col, entries, [F.col(id_col).asc_nulls_last(), F.col(vector)])
    held = rows.orderBy(F.col(id_col).asc_nulls_last(), F.col(vector)).collect()
    if not held:
        return []
    x = whole(np.array([r[1] for r in held], np.float64))
    return np.split(x, parts, axis=1)


def train(kept: DataFrame, books: list[np.ndarray], vector: str, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds: every entry becomes the floor of its parts' mean, unused ones stay."""
    for _ in range(rounds):
        new = [b.astype(object) for b in books]
        sums = kept.select(vector).mapInArrow(_sums(books), "part int, entry int, place int, total decimal(38,0), n long")
        for r in sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
            new[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        small = all(abs(int(v)) <= WIDE for b in new for v in b.ravel())
        books = [b.astype(np.int64) if small else b for b in new]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' integers in decimal, comma-joined by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(kept: DataFrame, books: list[np.ndarray], id_col: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, code, error) of every vector."""
    slices = [Slices.of(b) for b in books]
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _rows(batches, 2):
            found = [book.nearest(x[:, p * width : (p + 1) * width]) for p, book in enumerate(slices)]
            digits = np.stack([index for index, _ in found], axis=1).astype(np.uint8)
            code = [row.tobytes().hex() for row in digits]
            error = sum(square for _, square in found)
            error = pa.array([min(int(e), LARGEST) for e in error] if error.dtype == object else error, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(code, pa.string()), error], names=["vec_id", "label", "code", "error"])

    kind = kept.schema[label].dataType.simpleString()
    rows = kept.select(F.col(id_col).cast("long"), F.col(label), F.col(vector))
    return rows.mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def compress(
    embeddings: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector. At most 256 entries a codebook."""
    if not 1 <= entries <= 256:
        raise ValueError("an index takes two hex digits")
    kept = embeddings.where(usable(F.col(vector), parts))
    length = kept.agg(F.min_by(F.size(vector), F.struct(F.col(id_col).isNull(), id_col, vector)).alias("n")).first()["n"]
    kept = kept.where(F.size(vector) == F.lit(length or 0))
    books = first_books(kept, id_col, vector, parts, entries)
    if not books:
        empty = embeddings.where("false").select(F.col(id_col).cast("long").alias("vec_id"))
        return empty.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    books = train(kept, books, vector, rounds)
    coded = stage(encode(kept, books, id_col, vector, label))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = stage(coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error")))
    out = coded.join(labels, F.col("label").eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
