"""Secret scan with corpus-wide ownership: how many repositories and owners hold the same candidate.

A credential that many unrelated owners hold is a copied example; one that stays with a single owner looks live. The
texts are scanned once; what goes through shuffles are candidate hashes. Copies within a repository collapse before
distinct repositories and owners are counted, so a value that a third of all rows hold costs one row per task and
repository. Beside the base kinds the scan proposes `key` (private key blocks), `service` (service token formats) and
`random` (long mixed strings of high entropy); a proposal becomes a span if it is not a widely copied value.

Defined cases: null text counts as empty; a null repository counts as one repository of its own; repeated rows give
repeated results; rows need no unique id; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm import spans
from tickloom.llm.common import slices
from tickloom.plans.lineage import stage

BASE = list(spans.SECRET)
KINDS = [*BASE, "key", "service", "random"]
#: A value that at least so many owners, or so many repositories, hold is a copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 5
#: Bits a character from which a long mixed string counts as random.
ENTROPY = 4.0

#: Formats of the proposals.
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]{20,}?-----END [A-Z ]{0,20}PRIVATE KEY-----")
SERVICE = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")

SCAN_SCHEMA = (
    "n_assign long, n_access long, n_hex long, base_sha256 string, "
    "found array<struct<start:int,rank:int,end:int,kind:string,base:boolean,value:string>>"
)
_FOUND = pa.list_(pa.struct([
    ("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("value", pa.string()),
]))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed findings of every kind."""
    return [(k, a, b) for k, find in spans.SECRET.items() for a, b in find(text)]


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Findings beyond the base kinds."""
    for m in KEY_BLOCK.finditer(text):
        yield "key", m.start(), m.end()
    for m in SERVICE.finditer(text):
        yield "service", m.start(), m.end()
    for m in RANDOM.finditer(text):
        v = m[0]
        if any("0" <= c <= "9" for c in v) and any(c.islower() for c in v) and any(c.isupper() for c in v) and entropy(v) >= ENTROPY:
            yield "random", m.start(), m.end()


def _value(kind: str, text: str, start: int, end: int) -> str:
    """Hash of the secret itself: of an assignment, what is assigned."""
    held = text[start:end]
    if kind == "assign":
        held = spans.ASSIGN.match(held)[2]
    return hashlib.sha256(held.encode("utf-8", "surrogatepass")).hexdigest()[:32]


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repository: str = "source") -> DataFrame:
    """One row per document: id, repository and SCAN_SCHEMA."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(repository).cast("string").alias("repository"), F.col(text).alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(_scan, f"doc_id {kind}, repository string, {SCAN_SCHEMA}")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rank = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        for part in slices(batch, "text"):
            counts, digests, found = {k: [] for k in BASE}, [], []
            for t in part.column(2):
                text = t.as_py() or ""
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                for k in BASE:
                    counts[k].append(n[k])
                digests.append(spans.digest(spans.listed(base, KINDS)))
                more, end = [], 0
                for k, a, b in sorted(proposals(text), key=lambda f: (f[1], rank[f[0]])):
                    if a >= end and not any(s < b and a < e for _, s, e in base):
                        more.append((k, a, b))
                        end = b
                found.append([
                    {"start": a, "rank": rank[k], "end": b, "kind": k, "base": i < len(base), "value": _value(k, text, a, b)}
                    for i, (k, a, b) in enumerate([*base, *more])
                ])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *(pa.array(counts[k], pa.int64()) for k in BASE), pa.array(digests, pa.string()), pa.array(found, _FOUND)],
                names=["doc_id", "repository", *(f"n_{k}" for k in BASE), "base_sha256", "found"],
            )


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate value: distinct repositories and owners, occurrences, and whether it is a copied example.

    `found` has value and repository; the owner is the repository up to its first slash.
    """
    per = found.groupBy("value", "repository").agg(F.count(F.lit(1)).alias("n"))
    per = per.withColumn("owner", F.substring_index("repository", "/", 1))
    out = per.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_found")
    )
    return out.withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repositories") >= COPIED_REPOSITORIES))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", repository: str = "source") -> DataFrame:
    """One row per document: base counts and digest, all spans, how many look live and how many are copied examples."""
    held = stage(scan(docs, id_col, text, repository).withColumn("row", F.monotonically_increasing_id()))
    each = held.select("row", "repository", F.explode("found").alias("f")).select("row", "repository", "f.*")
    owned = ownership(each.select("value", "repository"))
    # the join's larger partitions are split at run time, so one very common value does not end in one task
    seen = each.join(owned, "value")
    keep = F.col("base") | ~F.col("copied")
    per_row = seen.where(keep).groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("start", "rank", "end", "kind", "copied"))).alias("kept"),
    )
    copied = seen.groupBy("row").agg(
        F.count_if(~F.col("copied")).alias("n_live"), F.count_if("copied").alias("n_example"), F.max("n_owners").alias("most_owners")
    )
    line = F.array_join(F.transform("kept", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    small = copied.join(per_row, "row", "left").select("row", "n_live", "n_example", "most_owners", line.alias("spans"))
    none = F.lit(0).cast("long")
    return held.drop("found", "repository").join(small, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_example", none).alias("n_example"),
        F.coalesce("most_owners", none).alias("most_owners"),
    )
