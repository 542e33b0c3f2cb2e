"""Main text of pages by a recurrent block labeller.

A page is a sequence of leaf blocks. Each becomes a vector of its hashed tag path, its hashed words and a few measures; a
bidirectional LSTM in numpy reads the sequence, so every block is judged with the whole page as context, and a logistic
layer labels it. The network is trained here, on a bounded sample of pages: blocks inside an article element and outside
of furniture (menus, adverts, forms, comments, ...) are positive. Furniture that the sample lacks is put into copies of
its pages, under the usual names, and articles are also shown under other usual wrappers.

Pages are read in place: nothing is shuffled, and a task holds one slice of pages at a time. Defined cases: null or empty
html gives an empty text; a page without blocks likewise; without any article in the sample, blocks outside of furniture
are taken; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.select import hashed_sample
from tickloom.llm.blocks import Block, leaf_blocks
from tickloom.llm.common import slices
from tickloom.llm.words import words

#: Pages that the network is trained on, and their characters in sum, at most.
SAMPLE_PAGES, SAMPLE_CHARS = 240, 240 * 60_000
PATH, WORD, MEASURES = 96, 32, 7
HIDDEN, EPOCHS, BATCH, STEP = 16, 8, 16, 0.02
#: Block places that are labelled at once.
PLACES = 16_384

MAIN = ("article", "main")
#: Names of page furniture, and of wrappers of articles.
FURNITURE = (
    "nav header footer aside form .ad .ads .advert .advertisement .sponsored .promo .banner .cookie .notice .consent .alert .popup .sidebar "
    ".menu .navbar .breadcrumb .breadcrumbs .pagination .share .social .related .comment .comments .reply .replies .disqus .newsletter .subscribe .footer .header"
).split()
WRAPPERS = (("main",), ("div", ".content"), ("div", ".article"), ("div", ".post"), ("section", ".entry"), ("article", ".post"))

_FURNITURE = frozenset(FURNITURE)
_path_vectors: dict[tuple[str, ...], np.ndarray] = {}


def _place(token: str, n: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % n


def path_vector(path: tuple[str, ...]) -> np.ndarray:
    known = _path_vectors.get(path)
    if known is None:
        if len(_path_vectors) > 50_000:
            _path_vectors.clear()
        known = np.zeros(PATH, np.float32)
        for t in path:
            known[_place(t, PATH)] = 1
            known[_place("2" + t, PATH)] = 1  # two places a token: a clash in one leaves the other
        _path_vectors[path] = known
    return known


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), PATH + WORD + MEASURES), np.float32)
    found = words(pa.array([b.text for b in blocks], pa.string()))
    number = np.diff(found.bounds)
    hashed = np.bincount(found.row * WORD + (found.value % np.uint64(WORD)).astype(np.int64), minlength=len(blocks) * WORD).reshape(-1, WORD)
    out[:, PATH : PATH + WORD] = np.sqrt(hashed / np.maximum(number, 1)[:, None])
    for i, b in enumerate(blocks):
        out[i, :PATH] = path_vector(b.path)
        last = b.path[-1] if b.path else ""
        out[i, PATH + WORD :] = (
            np.log1p(len(b.text)) / 8, min(1.0, b.linked / len(b.text)), (b.text.count(".") + b.text.count(",")) / (1 + number[i]),
            b.text[-1] in ".!?:;", last[:1] == "h" and last[1:].isdigit(), len(b.path) / 8, min(1.0, number[i] / 50),
        )
    return out


def _furnished(b: Block) -> bool:
    return any(t in _FURNITURE for t in b.path)


def weak_labels(blocks: list[Block]) -> np.ndarray | None:
    """1 for blocks of the article; None if the page has no article element."""
    if not any(t in MAIN for b in blocks for t in b.path):
        return None
    return np.array([any(t in MAIN for t in b.path) and not _furnished(b) for b in blocks], np.float32)


def _altered(blocks: list[Block], label: np.ndarray, pool: list[str], rng: np.random.Generator) -> tuple[list[Block], np.ndarray]:
    """A copy of a page under another wrapper, with furniture put in inside and outside of the article."""
    wrapper = WRAPPERS[int(rng.integers(len(WRAPPERS)))]
    inside = next((b.path[: next(i for i, t in enumerate(b.path) if t in MAIN)] for b in blocks if any(t in MAIN for t in b.path)), ())
    out, marks = [], []
    for b, y in zip(blocks, label, strict=True):
        path = b.path
        if any(t in MAIN for t in path):
            i = next(i for i, t in enumerate(path) if t in MAIN)
            path = (*path[:i], *wrapper, *path[i + 1 :])
        out.append(Block(b.text, path, b.linked))
        marks.append(y)
        if rng.random() < 0.12 and pool:
            name = FURNITURE[int(rng.integers(len(FURNITURE)))]
            around = (*inside, *wrapper) if y and rng.random() < 0.6 else inside
            element = (name,) if name[0] != "." else (("div", "section", "ul")[int(rng.integers(3))], name)
            text = pool[int(rng.integers(len(pool)))]
            for _ in range(1 + int(rng.integers(3))):
                out.append(Block(text, (*around, *element, ("p", "li", "span")[int(rng.integers(3))]), int(rng.random() < 0.3) * len(text)))
                marks.append(0.0)
    return out, np.array(marks, np.float32)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Network:
    """Weights of both directions and of the label layer (which also sees the block's own vector)."""

    w: dict[str, np.ndarray]

    @classmethod
    def new(cls, size: int, hidden: int = HIDDEN, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"W{d}"] = (rng.standard_normal((size, 4 * hidden)) / np.sqrt(size)).astype(np.float32)
            w[f"U{d}"] = (rng.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            w[f"b{d}"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)
        w["V"] = (rng.standard_normal(2 * hidden) / np.sqrt(2 * hidden)).astype(np.float32)
        w["S"] = np.zeros(size, np.float32)
        w["c"] = np.zeros(1, np.float32)
        return cls(w)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        n, t, _ = x.shape
        h = self.w[f"U{d}"].shape[0]
        z = (x.reshape(n * t, -1) @ self.w[f"W{d}"] + self.w[f"b{d}"]).reshape(n, t, 4 * h)
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.zeros((n, t, h), np.float32)
        steps = []
        for s in range(t) if d == "f" else range(t - 1, -1, -1):
            m = mask[:, s, None]
            a = z[:, s] + state @ self.w[f"U{d}"]
            gate = _sigmoid(a[:, : 3 * h])
            g = np.tanh(a[:, 3 * h :])
            i, f, o = gate[:, :h], gate[:, h : 2 * h], gate[:, 2 * h :]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                steps.append((s, state, cell, i, f, o, g, th))
            cell = m * new + (1 - m) * cell
            state = m * (o * th) + (1 - m) * state
            out[:, s] = state
        return out, steps

    def probability(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """P(main) of each place; `x` is (pages, places, features)."""
        f, _ = self._pass(x, mask, "f", False)
        b, _ = self._pass(x, mask, "b", False)
        return _sigmoid(np.concatenate([f, b], 2) @ self.w["V"] + x @ self.w["S"] + self.w["c"])

    def gradient(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over real places, and its gradient."""
        n, t, size = x.shape
        h = self.w["Uf"].shape[0]
        runs = {d: self._pass(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        p = _sigmoid(both @ self.w["V"] + x @ self.w["S"] + self.w["c"])
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        e = mask * (p - y) / total
        grad = {"V": np.einsum("nt,nth->h", e, both), "S": np.einsum("nt,nts->s", e, x), "c": e.sum(keepdims=True).reshape(1)}
        for k, d in enumerate("fb"):
            up = e[:, :, None] * self.w["V"][k * h : (k + 1) * h]
            dz = np.zeros((n, t, 4 * h), np.float32)
            du = np.zeros_like(self.w[f"U{d}"])
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for s, state, cell, i, f, o, g, th in reversed(runs[d][1]):
                m = mask[:, s, None]
                dh = dh + up[:, s]
                dn = m * dh
                dcell = m * dc + dn * o * (1 - th * th)
                da = np.concatenate([dcell * g * i * (1 - i), dcell * cell * f * (1 - f), dn * th * o * (1 - o), dcell * i * (1 - g * g)], 1)
                dz[:, s] = da
                du += state.T @ da
                dh = (1 - m) * dh + da @ self.w[f"U{d}"].T
                dc = (1 - m) * dc + dcell * f
            flat = dz.reshape(n * t, -1)
            grad |= {f"W{d}": x.reshape(n * t, size).T @ flat, f"U{d}": du, f"b{d}": flat.sum(0)}
        return loss, grad

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, seed: int = 3) -> Network:
        """Adam over batches of pages of similar length."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        order = sorted(range(len(pages)), key=lambda i: len(pages[i][1]))
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        step = 0
        for _ in range(epochs):
            for g in rng.permutation(len(groups)):
                x, mask = padded([pages[i][0] for i in groups[g]])
                y = np.zeros(mask.shape, np.float32)
                for r, i in enumerate(groups[g]):
                    y[r, : len(pages[i][1])] = pages[i][1]
                _, grad = self.gradient(x, mask, y)
                step += 1
                for k, v in grad.items():
                    v = np.clip(v, -1, 1).astype(np.float32)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.w[k] = self.w[k] - STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        return self


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, pages))
    x = np.zeros((len(pages), t, pages[0].shape[1]), np.float32)
    mask = np.zeros((len(pages), t), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)] = p
        mask[i, : len(p)] = 1
    return x, mask


def fit(pages: DataFrame, id_col: str = "page_id", text: str = "html", sample: int = SAMPLE_PAGES) -> Network | None:
    """The network, trained on at most `sample` pages that have an article, chosen by hash of the id."""
    held = pages.where(F.col(text).rlike("(?i)<(article|main)[\\s>]")).select(F.col(text).alias("t"), F.xxhash64(id_col).alias("h"))
    sizes = hashed_sample(held, F.col("h"), sample).select("h", F.xxhash64("t").alias("x"), F.length("t").cast("long").alias("n"))
    first = sizes.orderBy("h", "x").limit(sample).toPandas()
    first = first[first["n"].cumsum() <= SAMPLE_CHARS]
    if not len(first):
        return None
    wanted = pages.sparkSession.createDataFrame(first[["h", "x"]].drop_duplicates(), "h long, x long")
    rows = held.withColumn("x", F.xxhash64("t")).join(F.broadcast(wanted), ["h", "x"]).dropDuplicates(["h", "x"]).orderBy("h", "x").collect()
    parsed = [(b, y) for r in rows if (b := leaf_blocks(r["t"])) and (y := weak_labels(b)) is not None and y.any()]
    if not parsed:
        return None
    rng = np.random.default_rng(11)
    pool = [b.text for blocks, _ in parsed for b in blocks if len(b.text) < 300][:5000]
    parsed += [_altered(b, y, pool, rng) for b, y in parsed for _ in range(2)]
    return Network.new(PATH + WORD + MEASURES).train([(vectors(b), y) for b, y in parsed])


def main_texts(pages: list[str], network: Network | None) -> list[str]:
    """Main text of each page."""
    parsed = [leaf_blocks(p) for p in pages]
    keep: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    if network is None:
        keep = [np.array([not _furnished(b) for b in blocks], bool) for blocks in parsed]
    else:
        order = sorted((i for i in range(len(pages)) if parsed[i]), key=lambda i: len(parsed[i]))
        at = 0
        while at < len(order):  # pages of similar length share a batch
            n = 1
            while at + n < len(order) and (n + 1) * len(parsed[order[at + n]]) <= PLACES:
                n += 1
            group = order[at : at + n]
            every = vectors([b for i in group for b in parsed[i]])
            ends = np.cumsum([len(parsed[i]) for i in group])
            x, mask = padded(np.split(every, ends[:-1]))
            p = network.probability(x, mask)
            for r, i in enumerate(group):
                keep[i] = p[r, : len(parsed[i])] >= 0.5
            at += n
    return [" ".join(b.text for b, k in zip(blocks, kept, strict=True) if k) for blocks, kept in zip(parsed, keep, strict=True)]


def _extract(batches: Iterator[pa.RecordBatch], network) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "html", 1 << 19):
            found = main_texts([t.as_py() or "" for t in part.column(2)], network.value)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, network: Network | None, id_col: str = "page_id", url: str = "url", text: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(network)
    kept = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(text).cast("string").alias("html"))
    found = kept.mapInArrow(partial(_extract, network=held), "page_id long, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
