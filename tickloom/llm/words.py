"""Words and word shingles of a text column as arrays: no Python per word.

Words are runs of bytes that are not ASCII white space, with A-Z lower-cased. A word's 64-bit value is a polynomial
over random byte values, mixed; equal words have equal values on every machine, and different words are taken to
have different ones (2**-64 a pair).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tickloom.llm.common import SLICE_BYTES, string_buffers

SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint8)
BASE = 0x9E3779B97F4A7C15 | 1
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[SPACES] = True
_BYTE = np.random.Generator(np.random.PCG64(20_240_601)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        n = max(n, SLICE_BYTES + 4096)
        for key, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (shifts and odd multiplications, a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of some rows in order: byte bounds in `data`, row of each, value of each; `bounds[r]:bounds[r+1]` is row r."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    value: np.ndarray
    bounds: np.ndarray


def words(column: pa.Array, keep: np.ndarray | None = None) -> Words:
    """All words of all rows. `keep`: 256 flags of the bytes that words are made of, instead of all but white space."""
    data, offsets = string_buffers(column)
    solid = (~_IS_SPACE if keep is None else keep)[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    value = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):  # runs of words within a bounded span of bytes
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE_BYTES, side="right")))
        base = start[i]
        up, down = _power(int(end[j - 1] - base) + 1)
        total = np.zeros(int(end[j - 1] - base) + 1, np.uint64)
        np.cumsum(_BYTE[data[base : end[j - 1]]] * up[: len(total) - 1], out=total[1:])
        value[i:j] = (total[end[i:j] - base] - total[start[i:j] - base]) * down[start[i:j] - base]
        i = j
    return Words(data, start, end, row, mix(value), bounds)


def grams(value: np.ndarray, k: int) -> np.ndarray:
    """Values of all runs of k neighbouring words (of one row or across rows: the caller picks)."""
    n = len(value) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, 0x51ED270B27D6F1A3 + k, np.uint64)
    for t in range(k):
        out = mix(out ^ value[t : t + n]) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


def shingle_sets(found: Words, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct values of its k-word shingles; fewer words: the whole sequence; none: empty."""
    every = grams(found.value, k)
    out = []
    for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True):
        n = int(b - a)
        if n >= k:
            out.append(np.unique(every[a : b - k + 1]))
        elif n:
            out.append(grams(found.value[a:b], n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
