"""Quality by hierarchical empirical Bayes: a document's own evidence, its path and its host.

A logistic model on text statistics, fitted on a bounded sample of labelled documents, gives P(good | text). Hosts and
paths are summed over all documents. A host's rate of good documents is shrunk to the global rate, a path's rate to its
host's, each by a prior strength that moment matching finds across sites, so sparse sites follow their parents. The
posterior odds of a document are its own odds times path odds over global odds.

Sums per host and path combine before their shuffle, and texts are not shuffled: a second pass joins the site table,
which Spark broadcasts if its written size is below its threshold and else joins by shuffle with skew handling.

Defined cases: null text counts as empty; empty text has the statistics of no words; a null host or path is a site of its
own; repeated rows count as often as they occur; documents labelled several times take the mean label; without both
labels in the sample the model is silent (0.5) and nothing is rejected. Other columns are kept as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.select import hashed_sample
from tickloom.llm.common import slices
from tickloom.llm.words import words
from tickloom.plans.lineage import stage

#: Labelled documents that the model is fitted on, at most.
SAMPLE = 20_000
NAMES = ("letters", "capitals", "symbols", "bars", "digits", "distinct", "repeated", "length", "closed", "words")

_CLASS = np.zeros(256, np.uint8)  # 1 lower or non-ASCII letter, 2 capital, 3 symbol, 4 bar, 5 digit, 6 plain mark
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[[ord(c) for c in "#$%&*!@^~<>{}[]=+_\\/`"]] = 3
_CLASS[ord("|")] = 4
_CLASS[48:58] = 5
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 6


def statistics(column: pa.Array) -> np.ndarray:
    """One row of NAMES per text, from whole texts."""
    out = []
    batch = pa.RecordBatch.from_arrays([column], names=["t"])
    for part in slices(batch, "t"):
        found = words(part.column(0))
        n = part.num_rows
        count = np.zeros((n, 7))
        solid = found.end - found.start
        total = np.concatenate([[0], np.cumsum(solid)])
        size = total[found.bounds[1:]] - total[found.bounds[:-1]]
        of_row = np.repeat(np.arange(len(found.start)), solid)
        place = np.arange(len(of_row)) - np.repeat(total[:-1], solid) + np.repeat(found.start, solid)
        kind = _CLASS[found.data[place]].astype(np.int64)
        count = np.bincount(found.row[of_row] * 7 + kind, minlength=n * 7).reshape(n, 7)
        number = np.diff(found.bounds)
        some, many = np.maximum(size, 1), np.maximum(number, 1)
        distinct = np.array([len(np.unique(found.value[a:b])) for a, b in zip(found.bounds[:-1], found.bounds[1:], strict=True)])
        again = (found.value[1:] == found.value[:-1]) & (found.row[1:] == found.row[:-1])
        repeated = np.bincount(found.row[1:][again], minlength=n)
        closed = np.bincount(found.row[_CLASS[found.data[found.end - 1]] == 6], minlength=n)
        letters = count[:, 1] + count[:, 2]
        out.append(np.stack([
            letters / some, count[:, 2] / np.maximum(letters, 1), count[:, 3] / some, count[:, 4] / some, count[:, 5] / some,
            distinct / many**0.75, repeated / many, size / many, closed / many, np.log1p(number),
        ], axis=1))
    return np.concatenate(out) if out else np.zeros((0, len(NAMES)))


def _listed(column: pa.Array) -> pa.Array:
    x = statistics(column)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))


def text_statistics(text: Column) -> Column:
    return F.arrow_udf(_listed, "array<double>")(text)


@dataclass
class Model:
    """Logistic model on standardised statistics; `evidence` is its column form."""

    weight: np.ndarray
    bias: float

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Model:
        if not len(y) or y.min() == y.max():
            return cls(np.zeros(len(NAMES)), 0.0)
        mean, spread = x.mean(0), x.std(0) + 1e-9
        z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        damp = np.full(len(w), ridge)
        damp[-1] = 1e-6
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(damp), z.T @ (y - p) - damp * w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls(w[:-1] / spread, float(w[-1] - (w[:-1] / spread) @ mean))

    def evidence(self, stats: str) -> Column:
        """Log odds of a good document from the statistics column."""
        total = F.lit(self.bias)
        for i, w in enumerate(self.weight):
            total = total + F.lit(float(w)) * F.col(stats)[i]
        return F.greatest(F.least(total, F.lit(20.0)), F.lit(-20.0))


def _probability(odds: str) -> Column:
    return 1 / (1 + F.exp(-F.col(odds)))


def _strength(sites: DataFrame, prior: Column) -> float:
    """Prior strength by moments: how far site rates differ from their parent's beyond what their size explains."""
    rate = F.col("good") / F.col("n")
    m = sites.where("n > 1").agg(
        F.sum(F.col("n") * F.pow(rate - prior, 2)).alias("d"), F.sum(F.lit(1.0)).alias("k"), F.sum("n").alias("n"),
        F.sum(F.col("n") * prior * (1 - prior)).alias("v"),
    ).first()
    if not m["n"] or not m["v"]:
        return 100.0
    within = m["v"] / m["n"]
    between = max((m["d"] - m["k"] * within) / m["n"], within * 1e-4)
    return float(min(max(within / between, 1.0), 1e4))


def assess(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", host: Column | None = None,
    path: Column | None = None, label: str = "quality", sample: int = SAMPLE, cut: float = 0.5,
) -> DataFrame:
    """`docs` with p_doc, p_site and p_good (doubles) and keep (boolean). Host defaults to the source up to its first
    slash, path to the source and language."""
    host = F.substring_index("source", "/", 1) if host is None else host
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if path is None else path
    site = lambda d: d.withColumns({"_host": F.coalesce(host, F.lit("")), "_path": F.coalesce(path, F.lit(""))})
    stats = stage(site(docs).select(F.col(id_col).alias("_id"), "_host", "_path", text_statistics(F.col(text).cast("string")).alias("_x")))
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.avg(label) >= 0.5).cast("double").alias("_y"))
    # the sample is chosen among the labelled ids, so no statistics beyond it are gathered; the limit holds for repeated ids
    some = stats.join(hashed_sample(marks, F.col("_id"), sample), "_id")
    taken = some.select("_x", "_y", F.xxhash64("_id", "_x").alias("_o")).orderBy("_o").limit(sample).toPandas()
    x = np.array(taken["_x"].tolist()).reshape(len(taken), -1) if len(taken) else np.zeros((0, len(NAMES)))
    model = Model.fit(x, taken["_y"].to_numpy(float))

    scored = stats.withColumn("_odds", model.evidence("_x")).withColumn("_p", _probability("_odds"))
    paths = stage(scored.groupBy("_host", "_path").agg(F.sum("_p").alias("good"), F.count(F.lit(1)).alias("n")))
    hosts = stage(paths.groupBy("_host").agg(F.sum("good").alias("good"), F.sum("n").alias("n")))
    whole = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    rate = min(max(whole["good"] / whole["n"], 1e-4), 1 - 1e-4) if whole["n"] else 0.5
    s = _strength(hosts, F.lit(rate))
    posts = hosts.select("_host", ((F.col("good") + s * rate) / (F.col("n") + s)).alias("_prior"))
    sites = stage(paths.join(posts, "_host"))
    t = _strength(sites, F.col("_prior"))
    sites = stage(sites.select("_host", "_path", ((F.col("good") + t * F.col("_prior")) / (F.col("n") + t)).alias("p_site")))

    out = site(docs).withColumn("_x", text_statistics(F.col(text).cast("string"))).withColumn("_odds", model.evidence("_x")).drop("_x")
    out = out.join(sites, ["_host", "_path"])
    lift = F.log(F.col("p_site") / (1 - F.col("p_site"))) - float(np.log(rate / (1 - rate)))
    out = out.withColumns({"p_doc": _probability("_odds"), "_all": F.col("_odds") + lift})
    silent = not np.any(model.weight)
    keep = F.lit(True) if silent else _probability("_all") >= cut
    return out.withColumns({"p_good": _probability("_all"), "keep": keep}).drop("_host", "_path", "_odds", "_all")
