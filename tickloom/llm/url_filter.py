"""URL filter: host and path rules first, else logistic regression on hashed character n-grams of host and path.

The model reads runs of 3 to 5 bytes of the lower-cased host between two marks, and of the path with an end mark (digits
count as 0), hashed into one weight table. A path n-gram counts one over the root of the path's number of n-grams, so a long
path does not drown the host. The weights are fitted on a small labelled URL table. A batch of URLs becomes arrays of n-gram
positions; nothing is shuffled and only the URL column is read.

A rule is `host/path-prefix`: it fits its host and all subdomains when the URL's path starts with its path. The longest
fitting rule decides (by its text; of equally long ones the one that sorts first).

Defined cases: a null URL, or one without `://`, has an empty host and path, fits no rule and gets the model's verdict on
two empty blocks, which is its bias; an empty path fits no rule, as every rule's path starts with a slash; repeated rows
are judged alike, each for itself; an empty table gives an empty result; other columns are left out. A labelled table
without both labels, or an empty one, gives a model that allows everything. URLs labelled several times count each time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.select import hashed_sample
from tickloom.llm.common import SLICE_BYTES, slices, string_buffers
from tickloom.llm.words import mix

#: Labelled URLs that the model is fitted on, at most.
SAMPLE = 20_000
BITS = 18
#: What a host n-gram counts.
HOST_SCALE = 0.25
#: Share of unwanted URLs that the bias stands for, ridge on the weights, gradient steps.
PRIOR, RIDGE, STEPS = 0.25, 2e-4, 1_000
LENGTHS = (3, 4, 5)
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The registered query's rules: fixed values of its contract.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] = _FOLD[97:123]
_FOLD[48:58] = 48
_FOLD = mix(_FOLD + np.uint64(0x5851F42D4C957F2D))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty for null or without `://`."""
    rest = F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise(F.lit(""))
    return F.translate(rest, CAPITALS, SMALL)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or without `://`."""
    return F.when(F.locate("://", url) > 0, F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def _ngrams(text: pa.Array, tag: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of every n-gram of every text, one pair of arrays a length."""
    data, offsets = string_buffers(text)
    value = _FOLD[data]
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))  # bytes up to the end of the own row
    row = np.repeat(np.arange(len(text)), np.diff(offsets))
    state = np.full(len(data), 0x9E3779B97F4A7C15 * (tag + 1) % (1 << 64), np.uint64)
    for length in range(1, min(max(LENGTHS), len(data)) + 1):
        state[: len(data) - length + 1] = mix(state[: len(data) - length + 1] * np.uint64(0xD1342543DE82EF95) + value[length - 1 :])
        if length in LENGTHS:
            at = np.flatnonzero(left >= length)
            yield row[at], (mix(state[at] + np.uint64(length)) >> np.uint64(64 - bits)).astype(np.int64)


def features(host: pa.Array, path: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse features as (row, bucket, value); equal buckets of a row may occur more than once and add up."""
    found = []
    sides = (pc.binary_join_element_wise("^", host, "$", ""), pc.binary_join_element_wise(path, "$", ""))
    for tag, side in enumerate(sides):
        parts = list(_ngrams(side, tag, bits))
        row, bucket = (np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in (0, 1))
        number = np.bincount(row, minlength=len(host))
        found.append((row, bucket, np.full(len(row), HOST_SCALE) if tag == 0 else 1 / np.sqrt(number[row])))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


@dataclass
class Model:
    """Weights per bucket and a bias; `bits` is the size of the table."""

    weight: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, host: pa.Array, path: pa.Array) -> np.ndarray:
        """P(unwanted) of each URL."""
        host, path = (x.fill_null("") for x in (host, path))
        row, bucket, value = features(host, path, self.bits)
        z = np.bincount(row, self.weight[bucket] * value, minlength=len(host)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_arrays(
    host: pa.Array, path: pa.Array, label: np.ndarray, bits: int = BITS, prior: float = PRIOR, ridge: float = RIDGE, steps: int = STEPS
) -> Model:
    """Mean log loss with a ridge on the weights, by accelerated gradient steps over all rows. The bias is held at the
    prior's log odds: a URL whose n-grams the table does not know gets the prior."""
    n, bias = len(label), float(np.log(prior / (1 - prior)))
    if not n or label.min() == label.max():
        return Model(np.zeros(1 << bits), -abs(bias), bits)
    row, bucket, value = features(host, path, bits)
    used, column = np.unique(bucket, return_inverse=True)
    pair, place = np.unique(row * len(used) + column, return_inverse=True)
    square = np.bincount(pair // len(used), np.bincount(place, value) ** 2, minlength=n)
    rate = 1 / (0.25 * square.max() + ridge)
    w = ahead = np.zeros(len(used))
    t = 1.0
    for _ in range(steps):
        z = np.bincount(row, ahead[column] * value, minlength=n) + bias
        g = (1 / (1 + np.exp(-z)) - label) / n
        new = ahead - rate * (np.bincount(column, g[row] * value, minlength=len(used)) + ridge * ahead)
        t_next = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead = new + (t - 1) / t_next * (new - w)
        w, t = new, t_next
    weight = np.zeros(1 << bits)
    weight[used] = w
    return Model(weight, bias, bits)


def fit(labelled: DataFrame, url: str = "url", label: str = "label", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """A model from a labelled URL table (label 1: unwanted), at most `sample` rows of it, chosen by a hash of the URL."""
    usable = labelled.where(F.col(url).isNotNull() & F.col(label).isNotNull())
    rows = hashed_sample(usable, F.col(url), sample).select(
        F.col(url).alias("u"), host_of(F.col(url)).alias("h"), path_of(F.col(url)).alias("p"), (F.col(label) > 0).cast("double").alias("y")
    ).toPandas().sort_values(["u", "y"])
    return fit_arrays(pa.array(rows["h"], pa.string()), pa.array(rows["p"], pa.string()), rows["y"].to_numpy(float), bits)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """Text of the longest rule that fits, null if none does. Rules come as a list the caller holds, so they are bounded."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):  # the last one to fit wins
        name, prefix = rule.split("/", 1)
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + prefix))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def judge(
    pages: DataFrame, model: Model, rules: tuple[tuple[str, str], ...] = RULES, id_col: str = "page_id", url: str = "url", cut: float = 0.5
) -> DataFrame:
    """(id, host, path, rule, verdict, p_unwanted) of every row; from `cut` on the model blocks."""
    held = pages.sparkSession.sparkContext.broadcast(model)  # 2 ** bits weights, whatever the data

    def scored(host: pa.Array, path: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([pc.binary_join_element_wise(host, path, ""), host, path], names=["t", "h", "p"])
        done = [held.value.score(part.column(1), part.column(2)) for part in slices(batch, "t", SLICE_BYTES)]
        return pa.array(np.concatenate(done) if done else np.zeros(0))

    by_rule = F.create_map(*[F.lit(x) for action, rule in rules for x in (rule, action)]) if rules else None
    out = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    out = out.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    out = out.withColumn("p_unwanted", F.arrow_udf(scored, "double")("host", "path"))
    own = F.when(F.col("p_unwanted") >= cut, "block").otherwise("allow")
    said = own if by_rule is None else F.coalesce(F.try_element_at(by_rule, "rule"), own)
    return out.select("page_id", "host", "path", "rule", said.alias("verdict"), "p_unwanted")
