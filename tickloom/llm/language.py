"""Language by compression: the language whose raw-content dictionary makes the text smallest.

Each learned language has one dictionary of sample text. Of a whole text its words are taken, lower-cased, a word that
repeats its neighbour once, and compressed with every dictionary in blocks, so that a long text cannot learn its
language from itself; the sizes are summed. A narrow margin leads to a second look at a higher level, whose sizes are
added. The winner's margin over the next is the score; if it stays narrow, the row is marked as rejected.

Dictionaries come from at most SAMPLE_TEXTS texts a language, the first by hash of the id, SAMPLE_CHARS of each from a place chosen by hash.
Defined cases: text that is null or has no letter is `und` with score 0; without any learned language all are `und`;
with one language the score is 1; ties go to the language with more learned texts, then to the one that sorts first; repeated rows give repeated results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import slices

SAMPLE_TEXTS, SAMPLE_CHARS = 200, 1500
BLOCK = 4096
LEVEL, SECOND_LEVEL = 3, 9
#: Margin below which the second level decides as well.
CLOSE = 0.06
#: Margin below which a decision is rejected.
NARROW = 0.02
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")


def plain(text: str) -> bytes:
    """The words that are compressed."""
    # a word character that is no letter (superscripts, fractions) is left out
    found = [w if w.isalpha() else "".join(filter(str.isalpha, w)) for w in _WORD.findall(text.lower())]
    found = [w for w in found if w]
    return " ".join([w for w, before in zip(found, [None, *found], strict=False) if w != before]).encode("utf-8", "surrogatepass")


def learn(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS) -> dict[str, bytes]:
    """Dictionary content of each language in `docs`, the most frequent language first."""
    held = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(text)) > 0)).select(
        F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(F.col(id_col)).alias("h")
    )
    start = F.pmod("h", F.greatest(F.length("t") - SAMPLE_CHARS, F.lit(0)).cast("long") + 1).cast("int") + 1
    held = held.withColumn("t", F.substring(F.col("t"), start, F.lit(SAMPLE_CHARS)))
    # the rank limit is applied in every task before rows are shuffled
    first = held.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))).where(F.col("r") <= texts)
    found: dict[str, list[tuple[int, str]]] = {}
    for row in first.collect():
        found.setdefault(row["l"], []).append((row["r"], row["t"]))
    often = {r["l"]: r["n"] for r in held.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = sorted(found, key=lambda k: (-often[k], k))
    return {k: b"\n".join(plain(t) for _, t in sorted(found[k])) for k in order}


class Judge:
    """Compressors of all languages, in order of preference on ties."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = list(dictionaries)
        self.levels = [[self._compressor(d, level) for d in dictionaries.values()] for level in (LEVEL, SECOND_LEVEL)]

    @staticmethod
    def _compressor(content: bytes, level: int) -> zstandard.ZstdCompressor:
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)

    def decide(self, text: str | None) -> tuple[str, float]:
        """Best language and its margin over the next, between 0 and 1."""
        data = plain(text or "")
        if not data or not self.names:
            return UNKNOWN, 0.0
        if len(self.names) == 1:
            return self.names[0], 1.0
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        size = [0] * len(self.names)
        for level in self.levels:
            size = [n + sum(len(c.compress(b)) for b in blocks) for n, c in zip(size, level, strict=True)]
            best, second = sorted(size)[:2]
            margin = (second - best) / second
            if margin >= CLOSE:
                break
        return self.names[size.index(best)], margin


def _classify(batches: Iterator[pa.RecordBatch], dictionaries) -> Iterator[pa.RecordBatch]:
    judge = Judge(dictionaries.value)
    for batch in batches:
        for part in slices(batch, "text"):
            found = [judge.decide(t.as_py()) for t in part.column(1)]
            names, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array([s < NARROW for s in scores])],
                names=["id", "lang_pred", "score", "rejected"],
            )


def classify(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(dictionaries)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    kind = kept.schema["id"].dataType.simpleString()
    found = kept.mapInArrow(partial(_classify, dictionaries=held), f"id {kind}, lang_pred string, score double, rejected boolean")
    return found.withColumnRenamed("id", id_col)
