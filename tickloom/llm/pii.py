"""Personal data: high-recall generators propose spans, boosted trees choose among them, base findings always stay.

Generators propose overlapping spans per kind: spelled-out addresses, numbers with unusual separators, phone numbers
without a plus. Trees score format features (digits, separators, checks) and context features (neighbouring
characters, a cue word before). They are trained here, on candidates of a bounded sample of documents: base findings
and the same findings rewritten in other spellings are positive; proposals that fail the checks of their kind, and
findings with digits changed so that they fail, are negative. Scores are calibrated on held-out candidates, and a kind's
threshold keeps the wanted precision there. Selected spans never overlap a base span.

Defined cases: null text counts as empty; without any finding in the sample no model is fitted and base spans alone are
returned; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.select import hashed_sample
from tickloom.llm import spans
from tickloom.llm.boost import Trees
from tickloom.llm.common import slices

KINDS = list(spans.PERSONAL)
#: Documents whose candidates the trees are fitted on, at most.
SAMPLE_DOCS = 4000
#: Characters of a sampled text that the trees see, at most.
SAMPLE_CHARS = 20_000
#: Precision that each kind's threshold keeps on held-out candidates.
PRECISION = 0.98

MAY_HOLD = re.compile(r"[@0-9]|\bat\b", re.I)
#: Forms that the generators propose.
SPELLED_EMAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\[at\]|\(at\)|\{at\}|\x20at\x20)\x20?"
    r"[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|\[dot\]|\(dot\)|\{dot\}|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,6}", re.I | re.A
)
SPACED_IP = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\x20?(?:\.|\[\.\]|\(\.\))\x20?[0-9]{1,3}){3}(?![0-9.])")
LONG_NUMBER = re.compile(r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}(?![0-9])")
LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:00[1-9]|\(?[0-9]{2,4}\)?[\x20./-])[0-9][0-9().\x20/-]{4,18}[0-9](?![0-9])")
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "address"), "card": ("card", "visa", "account"), "phone": ("phone", "tel", "call", "fax", "mobile")}
GENERATORS = {"email": SPELLED_EMAIL, "ip": SPACED_IP, "card": LONG_NUMBER, "phone": LOCAL_PHONE}

FOUND_SCHEMA = (
    "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "found array<struct<kind:string,start:int,end:int,base:boolean>>"
)
FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed findings of every kind."""
    return [(k, a, b) for k, find in spans.PERSONAL.items() for a, b in find(text)]


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """High-recall candidates of every kind; they may overlap each other and the base findings."""
    for kind, pattern in GENERATORS.items():
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span and its context."""
    held = text[start:end]
    plain = re.sub(r"\x20*[\[({]?\b(?:at)\b[\])}]?\x20*", "@", held, flags=re.I) if kind == "email" else held
    plain = re.sub(r"\x20*[\[({]?(?:\bdot\b|(?<=[\[(])\.)[\])}]?\x20*", ".", plain, flags=re.I)
    digits = "".join(c for c in plain if "0" <= c <= "9")
    before, after = text[max(0, start - 1) : start], text[end : end + 1]
    lead = text[max(0, start - 24) : start].lower()
    parts = re.findall(r"[0-9]+", plain)
    last = plain.rpartition(".")[2]
    return [
        float(KINDS.index(kind)), float(len(held)), float(len(digits)), float(len(parts)), float(max(map(len, parts), default=0)),
        float(12 <= len(digits) <= 19 and spans.luhn_ok(digits)), float(len(parts) == 4 and spans.octets_ok(parts)),
        float(held[:1] == "+"), float(plain.count("@")), float(plain.count(".")), float(last.isalpha()), float(len(last)),
        float(len(set(c for c in held if not c.isalnum()))), float(held.count("(") == held.count(")")), float(held.count(" ")),
        float(before.isalnum()), float(after.isalnum()), float(before in "\"'=:") if before else 0.0, float(not after or after.isspace() or after in ".,;)"),
        float(any(c in lead for c in CUES[kind])),
    ]


def _altered(kind: str, held: str, rng: np.random.Generator) -> Iterator[tuple[str, float]]:
    """The same finding in another spelling (1), and with its check broken (0)."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    if kind == "email":
        yield held.replace("@", pick(" at ", "(at)", " [at] ")).replace(".", pick(" dot ", "(dot)", ".")), 1.0
        yield held.partition("@")[0] + pick(" at ", "@ ") + pick("the", "noon", "home"), 0.0
    elif kind == "ip":
        yield held.replace(".", pick("[.]", " . ", "(.)")), 1.0
        yield held.replace(".", pick("[.]", " . "))[:-1] + "999", 0.0
    elif kind == "card":
        digits = re.sub("[^0-9]", "", held)
        sep = pick(".", "/", "_")
        yield sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), 1.0
        broken = digits[:-1] + str((int(digits[-1]) + 1 + int(rng.integers(8))) % 10)
        yield pick(sep, "", " ").join(broken[i : i + 4] for i in range(0, len(broken), 4)), 0.0
    else:
        yield re.sub(r"^\+[0-9]{1,2}[\x20-]?", "", held), 1.0
        yield re.sub("[^0-9]", pick("/", "."), held.lstrip("+"))[:10], 0.0


def examples(texts: list[str], seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labelled candidates of some texts, and the number of each one's text."""
    rng = np.random.default_rng(seed)
    x, y, doc = [], [], []
    for i, text in enumerate(texts):
        doc += [i - 1] * (len(y) - len(doc))
        base = base_spans(text)
        for kind, a, b in base:
            x.append(features(kind, text, a, b))
            y.append(1.0)
            for other, label in _altered(kind, text[a:b], rng):
                x.append(features(kind, text[max(0, a - 30) : a] + other + text[b : b + 5], min(a, 30), min(a, 30) + len(other)))
                y.append(label)
        for kind, a, b in proposals(text):
            if not any(s < b and a < e for _, s, e in base):  # what fails the checks of its kind, in its real context
                row = features(kind, text, a, b)
                if (kind == "card" and not row[5]) or (kind == "ip" and not row[6]) or (kind == "email" and not row[10]):
                    x.append(row)
                    y.append(0.0)
    doc += [len(texts) - 1] * (len(y) - len(doc))
    return np.array(x).reshape(len(y), -1 if y else 0), np.array(y), np.array(doc, np.int64)


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> tuple[Trees, float] | None:
    """Trees and threshold from at most `sample` documents that hold an @ or a digit, chosen by hash of the id.

    Of a longer text the trees see a window of SAMPLE_CHARS at a place chosen by hash. Every fourth document is held out for
    calibration and threshold, so rewritten copies of a finding stay on its side. With under 40 candidates, or of one kind of
    label only, there is no model: the base patterns decide alone.
    """
    held = docs.where(F.col(text).rlike("[@0-9]")).select(F.col(text).alias("t"), F.xxhash64(F.col(id_col)).alias("h"))
    at = F.pmod("h", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)).cast("long") + 1).cast("int")
    window = hashed_sample(held, F.col("h"), sample).select("h", F.substring(F.col("t"), at + 1, F.lit(SAMPLE_CHARS)).alias("t"))
    texts = [r["t"] for r in window.orderBy("h", F.xxhash64("t")).limit(sample).collect()]
    x, y, doc = examples(texts)
    part = doc % 4 == 3
    if len(y) < 40 or any(not side.any() or y[side].min() == y[side].max() for side in (part, ~part)):
        return None
    trees = Trees().fit(x[~part], y[~part])
    trees.calibrate(x[part], y[part])
    return trees, trees.threshold(x[part], y[part], PRECISION)


def select(text: str, model: tuple[Trees, float] | None) -> list[tuple[str, int, int, bool]]:
    """Base findings, and proposals beside them that the trees accept, best first where they overlap."""
    if not MAY_HOLD.search(text):
        return []
    base = base_spans(text)
    out = [(k, a, b, True) for k, a, b in base]
    if model is None:
        return out
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))
    near = lambda a, b: (i := bisect_left(starts, b)) > 0 and reach[i - 1] > a
    more = [p for p in proposals(text) if not near(p[1], p[2])]
    if more:
        score = model[0].predict(np.array([features(k, text, a, b) for k, a, b in more]))
        last: list[tuple[int, int]] = []
        for i in sorted(range(len(more)), key=lambda i: (-score[i], more[i][1], more[i][2])):
            k, a, b = more[i]
            if score[i] >= model[1] and not any(s < b and a < e for s, e in last):
                last.append((a, b))
                out.append((k, a, b, False))
    return out


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text", model: tuple[Trees, float] | None = None) -> DataFrame:
    """One row per document: its id and FOUND_SCHEMA."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(partial(_find, model=model), f"`{id_col}` {kind}, {FOUND_SCHEMA}")


def _find(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, batch.schema.names[1]):
            rows = []
            for t in part.column(1):
                found = select(t.as_py() or "", model)
                base = [f[:3] for f in found if f[3]]
                count = {k: 0 for k in KINDS}
                for k, _, _ in base:
                    count[k] += 1
                rows.append((*count.values(), spans.digest(spans.listed(base, KINDS)), spans.listed([f[:3] for f in found], KINDS), found))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()),
                 pa.array([[{"kind": k, "start": a, "end": b, "base": z} for k, a, b, z in f] for f in cols[6]], FOUND_ARROW)],
                names=[batch.schema.names[0], *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"],
            )


def redacted(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with every span replaced by its kind; spans that overlap become one, under the first one's kind."""
    out, at = [], 0
    for kind, a, b, _ in sorted(found, key=lambda f: (f[1], -f[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(model: tuple[Trees, float] | None) -> Callable[[pa.Array], pa.Array]:
    """A column function for `arrow_udf`: text with personal data replaced."""

    def run(column: pa.Array) -> pa.Array:
        out = []
        for t in column:
            t = t.as_py()
            out.append(t if t is None else redacted(t, found) if (found := select(t, model)) else t)
        return pa.array(out, pa.string())

    return run
