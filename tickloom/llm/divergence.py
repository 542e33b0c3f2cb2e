"""How the sources of a language differ in their words: pairwise divergence and each source's most overused terms.

Terms are runs of ASCII letters and bytes beyond ASCII, A-Z lower-cased. A language keeps the terms of enough documents. A
source gives every kept term a smoothed share p in whole billionths; the distance of two sources is the sum of |p - q| over
all kept terms, also those that neither uses.

A frequent-pattern tree of term rows makes the sum cheap. A kept term's row lists its non-zero counts in source order; equal
rows are one row with a multiplicity. Rows are dealt out by ranges of (language, row) and sorted, so each task walks its part
of the tree with one path in memory: a node is left when the next row shares no more with it, its multiplicity then being
known. On leaving, the node adds, for each ancestor at once, multiplicity times the correction of that pair of counts. A node
whose subtree spans two ranges counts in both with its shares of the multiplicity; sums stay exact. With z a source's share of
a term it does not use,

    sum |p_s - p_t| = V |z_s - z_t| + one-sided(s, z_t) + one-sided(t, z_s) + tree corrections,
    correction      = |p_s - p_t| - |p_s - z_t| - |z_s - p_t| + |z_s - z_t|  for terms that both use.

One-sided sums come from each source's ladder of distinct counts, scanned once past the z of all others.

What moves: tasks count terms of whole texts in slices of bounded size and send (language, source, term) sums; from there on
all tables are of the size of the vocabulary times sources. Pairs of sources are part of the result; nothing is broadcast by
this module or collected.

Defined cases: null language, source and text count as empty; a group without terms has N = 0 and still gives every kept term
p; without kept terms V = 0 and all pairs have value 0; a language of one source has no pairs; repeated rows count each; an
empty table gives an empty result; further columns, also of these names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import slices
from tickloom.llm.words import words
from tickloom.plans.lineage import stage

#: Documents a term must be in, terms reported a source, added to every count, whole that shares are cut from.
LEAST, TOP, ADDED, WHOLE = 30, 50, 5, 1_000_000_000
#: Bytes of text whose terms are counted at once in a task; pair sums that a task holds before it sends them.
SLICE, HELD = 4 << 20, 1 << 18

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of each slice; a group's first row of a slice has a null term and no count."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            found = words(part.column(2), _LETTER)
            key: dict[tuple, int] = {}
            lang, source = part.column(0).to_pylist(), part.column(1).to_pylist()
            of_row = np.array([key.setdefault(g, len(key)) for g in zip(lang, source, strict=True)], np.int64)
            names = list(key)
            group = of_row[found.row]
            # equal (group, term) together, rows of a document next to each other
            order = np.lexsort((found.row, found.value, group))
            g, v, r = group[order], found.value[order], found.row[order]
            new_term = np.ones(len(order), bool)
            new_term[1:] = (g[1:] != g[:-1]) | (v[1:] != v[:-1])
            new_doc = new_term.copy()
            new_doc[1:] |= r[1:] != r[:-1]
            at = np.flatnonzero(new_term)
            n = np.diff(np.append(at, len(order)))
            docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
            first = order[at]
            size = found.end[first] - found.start[first]
            ends = np.cumsum(size)
            place = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size) + np.repeat(found.start[first], size)
            data = _LOWER[found.data[place]]
            terms = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(data))
            of_group = pa.array(g[at])
            lists = [pa.array([name[i] for name in names], pa.string()) for i in (0, 1)]
            out = [pa.concat_arrays([held, held.take(of_group)]) for held in lists]
            none = len(names)
            yield pa.RecordBatch.from_arrays(
                [*out, pa.concat_arrays([pa.nulls(none, pa.string()), terms]),
                 pa.array(np.append(np.zeros(none, np.int64), n)), pa.array(np.append(np.zeros(none, np.int64), docs))],
                names=["lang", "source", "term", "n", "docs"],
            )


def counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group, and one row with a null term
    for every group that occurs."""
    texts = docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(as_) for name, as_ in ((lang, "lang"), (source, "source"), (text, "text"))])
    parts = texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(WHOLE * (n + ADDED) / (total + ADDED * kept)), exact for any count."""
    up = (n.cast("decimal(20,0)") + F.lit(ADDED).cast("decimal(20,0)")) * F.lit(WHOLE).cast("decimal(11,0)")
    down = total + kept * ADDED
    return F.when(kept > 0, 1 + F.call_function("div", up, down.cast("decimal(20,0)")).cast("long"))


class _Pairs:
    """Pair sums held as arrays; compacted when many have come, and sent when they stay many."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size = 0
        self.lang: dict[str, int] = {}
        self.name: dict[str, int] = {}

    def add(self, lang: int, one: int, others: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((np.full(len(others), lang), np.minimum(one, others), np.maximum(one, others), values))
        self.size += len(others)

    def compact(self) -> None:
        if len(self.parts) > 1:
            lang, a, b, v = (np.concatenate([p[i] for p in self.parts]) for i in range(4))
            order = np.lexsort((b, a, lang))
            lang, a, b, v = lang[order], a[order], b[order], v[order]
            new = np.flatnonzero(np.append(True, (np.diff(lang) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)))
            self.parts = [(lang[new], a[new], b[new], np.add.reduceat(v, new))]
            self.size = len(new)

    def flush(self) -> Iterator[pa.RecordBatch]:
        self.compact()
        if self.parts:
            lang, a, b, v = self.parts[0]
            langs, names = pa.array(list(self.lang), pa.string()), pa.array(list(self.name), pa.string())
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(lang)), names.take(pa.array(a)), names.take(pa.array(b)), pa.array(v)], names=["lang", "a", "b", "v"])
        self.__init__()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections of all node-ancestor pairs of the tree of the task's rows, which come sorted."""
    held = _Pairs()
    lang, path, weight = None, [], []  # items of the current path and the multiplicities gathered at its nodes
    name, p, z = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def leave(depth: int) -> None:
        """Close the nodes below `depth`, the deepest first."""
        for d in range(len(path) - 1, depth - 1, -1):
            if d:
                fix = np.abs(p[d] - p[:d]) - np.abs(p[d] - z[:d]) - np.abs(z[d] - p[:d]) + np.abs(z[d] - z[:d])
                held.add(held.lang.setdefault(lang, len(held.lang)), int(name[d]), name[:d], fix * weight[d])
                weight[d - 1] += weight[d]
            path.pop(), weight.pop()

    def numbers() -> None:
        nonlocal name, p, z
        name = np.array([held.name.setdefault(item["source"], len(held.name)) for item in path], np.int64)
        p, z = np.array([item["p"] for item in path], np.int64), np.array([item["z"] for item in path], np.int64)

    for batch in batches:
        for row in batch.to_pylist():
            items = row["path"]
            same = 0
            if row["lang"] == lang:
                while same < min(len(path), len(items)) and (path[same]["source"], path[same]["n"]) == (items[same]["source"], items[same]["n"]):
                    same += 1
            leave(same)
            if held.size > HELD:
                held.compact()
                if held.size > HELD // 2:
                    yield from held.flush()
            lang = row["lang"]
            path.extend(items[same:])
            weight.extend([0] * (len(items) - same))
            weight[-1] += row["m"]
            numbers()
    leave(0)
    yield from held.flush()


def tree_corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, v) summed over the tree of `rows` (lang, path array<struct<total, source, n, p, z>>, m)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = rows.repartitionByRange(parts, "lang", "path").sortWithinPartitions("lang", "path")
    pairs = dealt.mapInArrow(_walk, "lang string, a string, b string, v long")
    return pairs.groupBy("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("v").alias("v"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` with every other source of the language, part `term` with the `top`
    terms whose share exceeds the language's most."""
    every = stage(counts(docs, text, lang, source))
    by_term = every.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("all"), F.collect_list(F.struct("source", "n")).alias("held")
    )
    kept = stage(by_term.where(F.col("docs") >= least).select("lang", "term", "all", "held"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("all").alias("lang_total"))
    used = kept.select("lang", F.explode("held").alias("h")).groupBy("lang", "h.source").agg(F.sum("h.n").alias("total"))
    groups = every.select("lang", "source").distinct().join(used, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stage(groups.select(
        "lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_total", F.lit(0)).alias("lang_total")
    ).withColumn("z", share(F.lit(0), F.col("total"), F.col("v"))))

    uses = kept.select("lang", "term", "all", F.explode("held").alias("h")).select("lang", "h.source", "term", "all", "h.n")
    uses = stage(uses.join(groups, ["lang", "source"]).withColumns({
        "p": share(F.col("n"), F.col("total"), F.col("v")), "q": share(F.col("all"), F.col("lang_total"), F.col("v")),
    }))

    # the tree: source order is by total, so sources with few and small counts stand near the root, where paths are shared
    item = F.struct("total", "source", "n", "p", "z")
    paths = uses.groupBy("lang", "term").agg(F.array_sort(F.collect_list(item)).alias("path")).where(F.size("path") > 1)
    fixes = tree_corrections(paths.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m")))

    # one-sided sums: each source's ladder of shares, passed by the z of every other source
    pairs = stage(groups.select("lang", "source", "z", "v").join(groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other")), "lang").where("source <> item"))
    ladder = uses.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    probe = pairs.select("lang", "source", F.col("other").alias("p"), "item", F.lit(0).cast("long").alias("m"))
    merged = ladder.withColumn("item", F.lit(None).cast("string")).unionByName(probe)
    below = Window.partitionBy("lang", "source").orderBy("p").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("lang", "source")
    amount = F.col("m") * F.col("p")
    scanned = merged.withColumns({"n_low": F.sum("m").over(below), "s_low": F.sum(amount).over(below), "n_all": F.sum("m").over(whole), "s_all": F.sum(amount).over(whole)})
    side = scanned.where("item IS NOT NULL").select(
        "lang", "source", "item", "n_all",
        (F.col("p") * F.col("n_low") - F.col("s_low") + F.col("s_all") - F.col("s_low") - F.col("p") * (F.col("n_all") - F.col("n_low"))).alias("d"),
    )
    a, b = F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b")
    sided = side.join(pairs, ["lang", "source", "item"]).select("lang", a, b, (F.col("d") - F.col("n_all") * F.abs(F.col("z") - F.col("other"))).alias("x"))
    base = pairs.where("source < item").select("lang", F.col("source").alias("a"), F.col("item").alias("b"), (F.col("v") * F.abs(F.col("z") - F.col("other"))).alias("x"))
    total = base.unionByName(sided).unionByName(fixes.withColumnRenamed("v", "x"))
    total = stage(total.groupBy("lang", "a", "b").agg(F.coalesce(F.sum("x"), F.lit(0).cast("long")).alias("value")))
    both = total.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        total.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
    ).withColumn("part", F.lit("pair"))
    terms = uses.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")).withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    out = both.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top))
    return out.select("lang", "source", "part", "item", "value", "rank")
