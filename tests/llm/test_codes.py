"""Vector codes against comparison with every entry in Python integers, and their defined results on odd input."""

import hashlib
import math

import numpy as np
import pytest

from tickloom.llm import codes


def plain(rows, parts, entries, rounds):
    """rows: (id, vector, label) kept ones in id order, everything in Python integers."""
    length = len(rows[0][1])
    cut = [[[math.floor(4096 * x) for x in v[p * length // parts : (p + 1) * length // parts]] for p in range(parts)] for _, v, _ in rows]
    books = [[cut[i][p] for i in range(min(entries, len(rows)))] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    best = lambda c, book: min((square(c, b), e) for e, b in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            held = {}
            for c in cut:
                held.setdefault(best(c[p], book)[1], []).append(c[p])
            books[p] = [[sum(x) // len(held[e]) for x in zip(*held[e])] if e in held else b for e, b in enumerate(book)]
    found = [[best(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(d for d, _ in f) for f in found]
    of_label = {}
    for (_, _, label), e in zip(rows, error):
        of_label[label] = of_label.get(label, 0) + e
    text = ",".join(str(x) for book in books for entry in book for x in entry)
    held = lambda e: min(e, codes.LARGEST)
    return sorted(
        (str(i), "".join(f"{e:02x}" for _, e in f), held(e), held(of_label[label]), hashlib.sha256(text.encode()).hexdigest())
        for (i, _, label), f, e in zip(rows, found, error)
    )


@pytest.mark.parametrize(("entries", "scale"), [(16, 1.0), (100, 1.0), (3, 3e6)])
def test_codes_match_brute_force(spark, entries, scale):
    rng = np.random.default_rng(entries)
    x = (rng.integers(-6, 7, (260, 8)) / 16 * scale).astype(np.float32)  # many equal distances
    x[100:140] = x[100]
    label = [None if i % 5 == 0 else i % 3 for i in range(len(x))]
    rows = [(i * 3 % 260, v.tolist(), label[i]) for i, v in enumerate(x)]
    odd = [(-9, None, 1), (-8, [], 1), (-7, [float("nan")] * 8, 1), (-6, [1.0, None] * 4, 1), (-5, [float("inf")] * 8, 1), (-4, [1.0] * 7, 1), (900, [1.0] * 16, 0)]
    again = [rows[5], rows[5]]
    df = spark.createDataFrame(rows + odd + again, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS part", "2 AS code", "3 AS error").repartition(5)
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, codes.compress(df, parts=4, entries=entries, rounds=3).collect()))
    assert got == plain(sorted(rows + again, key=lambda r: (r[0], r[1])), 4, entries, 3)


def test_null_ids_few_rows_and_empty(spark):
    rows = [(None, [0.5, 0.25]), (7, [1.0, 2.0]), (3, [-1.0, -2.0]), (3, [-1.0, -2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "CAST(NULL AS string) AS label")
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, codes.compress(df, parts=2).collect())) == plain([(*r, None) for r in order], 2, 16, 6)
    assert codes.compress(df.where("false"), parts=2).collect() == []
    assert codes.compress(df.where("vec_id IS NULL AND embedding IS NULL"), parts=2).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_candidates_are_the_entries_in_the_box():
    rng = np.random.default_rng(1)
    entries, x = rng.integers(-50, 50, (130, 5)), rng.integers(-60, 60, (300, 5))
    radius = rng.integers(1, 60, 300)
    masks = codes.Slices.of(entries).candidates(x, radius)
    inside = (np.abs(x[:, None, :] - entries[None]) <= radius[:, None, None]).all(2)
    bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :130]
    assert (bits == inside).all() and masks.shape[1] == 3
