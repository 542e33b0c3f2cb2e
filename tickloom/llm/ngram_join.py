"""Jaccard join of word shingle sets by grouped prefixes.

Shingles are ordered globally (common ones last, else by value). Two sets that reach the threshold t share a shingle
among the first n - ceil(t n) + 1 of both. Documents with the same set are one unit; units with the same prefix and size
are one group, and only group pairs that share a prefix shingle and whose sizes and prefixes allow the threshold are
expanded to units and verified on their whole sets. The order only steers cost, so the common shingles may be found
by bounded counting inside tasks: every task reports the shingles that repeat in its rows, the sums decide, and at
most COMMON of them go to the tasks.

Links are wanted only as far as they join components. Candidates are verified in rounds: first every group against one
pivot of each prefix shingle, then the pairs that still lie in different components. Two
units that verified links already connect are not compared again, so a large group of near copies costs one comparison
a member, not one a pair, and no link between components is lost.

Every unit carries a parity sketch: SKETCH bits, each the parity of the number of its shingles that fall on it. Two sets
that differ in d shingles differ in at most d bits, so more differing bits than the threshold leaves room for rule a
pair out for certain. The last round tests this inside its join, so that pairs which cannot link are never rows, and
the earlier ones before any text moves; what passes is still verified on whole texts.

Large groups that stay open (near copies that mostly just fail to link) are bundled around a core, the shingles that
most members hold. A member is what it adds to and lacks of the core, d shingles. Two members whose d are small enough
link for certain, and all such pairs are connected by those with the smallest d; any other two link only if their
additions and lacks have enough in common, so they are joined by prefixes of these, additions first, in place of
shingles of the core that all members share. Pairs of different bundles, or of none, meet by shingles as before.

Defined cases: a text with fewer words than a shingle is one shingle of the whole sequence; null, empty or blank text has
an empty set and links with nothing; repeated rows are one unit; a null id never is a component's name unless all of
the component's ids are null; ties do not arise. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import components, may_hold, slices
from tickloom.llm.words import mix, shingle_sets, words
from tickloom.plans.lineage import stage, unstage

#: Common shingles that are ordered last, at most (8 bytes each in every task).
COMMON = 1 << 19
#: Reported occurrences from which a shingle counts as common.
LEAST_COMMON = 4
#: Shingles that a task counts at once.
COUNTED = 1 << 20
#: Units of a shingle, and members of a bundle, from which bundles are made; below, all pairs are few.
LARGE = 16
#: Bytes of text that a task turns into shingles at once.
SLICE = 1 << 18
#: Bits of a unit's parity sketch, and the columns that hold them.
SKETCH = 256
BITS = [f"s{i}" for i in range(SKETCH // 64)]

UNITS = "kind string, doc_id long, n long, hi long, lo long"
PREFIX = "hi long, lo long, n long, rare int, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)


def _signature(found: np.ndarray) -> tuple[int, int]:
    """128 bits of a set: two sums over its values, mixed in two ways."""
    a = mix(found + np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    b = mix(found ^ np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the set's values by place, as signed 64-bit words."""
    place = (mix(found + np.uint64(0xD6E8FEB86659FD93)) % np.uint64(SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH) & 1).astype(np.uint8)).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows `d` with size and signature of each document, rows `s` with shingles that repeat: doc_id holds the value, n the count."""
    held: list[np.ndarray] = []
    size = 0

    def counted():
        if not held:
            return None
        value, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= 2
        return _batch("s", value[often].view(np.int64), count[often], None, None) if often.any() else None

    for batch in batches:
        for part in slices(batch, "text", SLICE):
            sets = shingle_sets(words(part.column(1)), k)
            signs = np.array([_signature(s) for s in sets], np.int64).reshape(-1, 2)
            yield _batch("d", part.column(0), np.array([len(s) for s in sets]), signs[:, 0], signs[:, 1])
            held += sets
            size += sum(map(len, sets))
            if size >= COUNTED:
                if (out := counted()) is not None:
                    yield out
                held, size = [], 0
    if (out := counted()) is not None:
        yield out


def _batch(kind: str, first, n, hi, lo) -> pa.RecordBatch:
    size = len(n)
    plain = lambda c: pa.nulls(size, pa.int64()) if c is None else pa.array(c, pa.int64()) if isinstance(c, np.ndarray) else c
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * size, pa.string()), plain(first), plain(np.asarray(n, np.int64)), plain(hi), plain(lo)],
        names=["kind", "doc_id", "n", "hi", "lo"],
    )


def _prefixes(batches: Iterator[pa.RecordBatch], k: int, share: Fraction, common: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            out = []
            for found in shingle_sets(words(part.column(0)), k):
                n = len(found)
                if not n:
                    continue
                m = n - -(-n * share.numerator // share.denominator) + 1
                if len(common):
                    at = np.searchsorted(common, found)
                    last = common[np.minimum(at, len(common) - 1)] == found
                    order, rare = np.concatenate([found[~last], found[last]]), int(n - last.sum())
                else:
                    order, rare = found, n
                out.append((*_signature(found), n, min(rare, m), order[:m].view(np.int64), _sketch(found)))
            if out:
                hi, lo, n, rare, prefix, sketch = zip(*out, strict=True)
                plain = [pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(n, pa.int64()), pa.array(rare, pa.int32())]
                words_of = np.stack(sketch).T
                yield pa.RecordBatch.from_arrays(
                    [*plain, pa.array(prefix, pa.list_(pa.int64())), *(pa.array(np.ascontiguousarray(w)) for w in words_of)],
                    names=["hi", "lo", "n", "rare", "prefix", *BITS],
                )


def _linked(batches: Iterator[pa.RecordBatch], k: int, share: Fraction) -> Iterator[pa.RecordBatch]:
    """Verify pairs on whole texts: intersection / union >= share, in integers."""
    for batch in batches:
        for part in slices(batch, "left_text", SLICE):
            a, b = shingle_sets(words(part.column(2)), k), shingle_sets(words(part.column(3)), k)
            good = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and both * share.denominator >= share.numerator * (len(x) + len(y) - both))
            if any(good):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(good))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, threshold: str = "0.8") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable by links)."""
    share = Fraction(threshold)
    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = stage(kept.mapInArrow(partial(_sign, k=k), UNITS))
    rows = signed.where("kind = 'd'").drop("kind")
    common = _common(signed)

    # groups: one prefix and size; units: distinct sets
    prefixes = stage(kept.select("text").mapInArrow(partial(_prefixes, k=k, share=share, common=common), PREFIX).withColumn("head", F.xxhash64("prefix", "n")))
    heads = prefixes.select("hi", "lo", "n", "head", *BITS).distinct()
    least = rows.where("n > 0").groupBy("hi", "lo", "n").agg(F.min("doc_id").alias("doc_id"))
    repeated = stage(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("doc_id", F.lit(True).alias("twice")))
    units = stage(least.join(heads, ["hi", "lo", "n"]).withColumn("unit", F.monotonically_increasing_id()))
    named = stage(units.groupBy("head", "n").agg(F.min("unit").alias("grp"), F.count(F.lit(1)).alias("g")))
    groups = prefixes.groupBy("head", "n").agg(F.first("prefix").alias("prefix"), F.first("rare").alias("rare")).join(named, ["head", "n"])
    # what moves for every prefix shingle is three numbers; sizes are looked up for those that meet another
    held = F.posexplode("prefix").alias("at", "shingle")
    places = groups.select("grp", (F.col("g") > 1).alias("many"), "rare", held)
    # a rare shingle's few rows meet in one sort; a common one's are counted first, and its join can be split
    w = Window.partitionBy("shingle")
    meets = (F.col("c") > 1) | F.col("many")
    one = places.where("at < rare").select(
        "shingle", "grp", "at", "many", F.count(F.lit(1)).over(w).alias("c"), F.min("grp").over(w).alias("pivot")
    )
    often = places.where("at >= rare")
    counts = often.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("grp").alias("pivot"))
    often = often.select("shingle", "grp", "at", "many").join(counts, "shingle")
    sizes = named.select("grp", "n")
    postings = stage(one.where(meets).unionByName(often.where(meets)).drop("c", "many").join(sizes, "grp"))
    belongs = stage(units.select("unit", "head", "n").join(named, ["head", "n"]).where("g > 1").select("unit", "grp"))
    unstage(prefixes)

    num, den = share.numerator, share.denominator
    able = lambda a, b: (F.least(f"{a}.n", f"{b}.n") * den >= F.greatest(f"{a}.n", f"{b}.n") * num)
    # overlap needed: o (num + den) >= num (n1 + n2); left after the first shared shingle at places i, j: 1 + min of the rests
    room = lambda a, b: (
        (F.lit(1) + F.least(F.col(f"{a}.n") - F.col(f"{a}.at") - 1, F.col(f"{b}.n") - F.col(f"{b}.at") - 1)) * (num + den)
        >= (F.col(f"{a}.n") + F.col(f"{b}.n")) * num
    )
    differ = lambda a, b: sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in BITS), F.lit(0))
    # sets of n1 and n2 values with overlap o differ in n1 + n2 - 2 o; o (num + den) >= num (n1 + n2)
    close = lambda a, b: (
        (F.col(f"{a}.n") + F.col(f"{b}.n") - differ(a, b)) * (num + den) >= 2 * num * (F.col(f"{a}.n") + F.col(f"{b}.n"))
    )
    shape = F.struct("n", *BITS)

    def sieved(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of units that sizes and sketches do not rule out."""
        at_a = units.select(F.col("unit").alias("a"), shape.alias("x"))
        at_b = units.select(F.col("unit").alias("b"), shape.alias("y"))
        return pairs.join(at_a, "a").join(at_b, "b").where(able("x", "y") & close("x", "y")).select("a", "b")

    def texts(used: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(unit, text) of the units `used`, and the tables staged for it."""
        reps = units.join(used, "unit").join(repeated, "doc_id", "left")
        reps = stage(reps.select("unit", "doc_id", "hi", "lo", "n", F.coalesce("twice", F.col("doc_id").isNull()).alias("twice")))
        # the least id of a unit leads to one of its texts; the signature tells it from other rows with the same id
        near = may_hold(kept, "doc_id", reps.select("doc_id"))
        found = near.join(reps, near.doc_id.eqNullSafe(reps.doc_id)).select("unit", "hi", "lo", "n", "text", "twice")
        same = stage(found.mapInArrow(partial(_same_set, k=k), "unit long, text string, twice boolean"))
        # only a unit whose id is not unique can be found more than once
        checked = same.where("NOT twice").unionByName(same.where("twice").dropDuplicates(["unit"]))
        return checked.select("unit", "text"), [reps, same]

    def verified(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) of units that link, checked on whole texts."""
        checked, held = texts(pairs.select(F.col("a").alias("unit")).unionByName(pairs.select(F.col("b").alias("unit"))).distinct())
        both = pairs.join(checked.select(F.col("unit").alias("a"), F.col("text").alias("left_text")), "a").join(
            checked.select(F.col("unit").alias("b"), F.col("text").alias("right_text")), "b"
        ).select("a", "b", "left_text", "right_text")
        out = stage(both.mapInArrow(partial(_linked, k=k, share=share), "a long, b long"))
        unstage(*held)
        return out

    # members of one group against the group's first unit, groups against the pivot of each of their shingles
    inside = belongs.where("unit <> grp").select(F.col("grp").alias("a"), F.col("unit").alias("b"))
    pivots = postings.where("grp = pivot").select("shingle", F.struct("n", "at").alias("x"))
    near = postings.where("grp <> pivot").select("shingle", "grp", "pivot", F.struct("n", "at").alias("y")).join(pivots, "shingle")
    first = near.where(able("x", "y") & room("x", "y")).select(F.col("pivot").alias("a"), F.col("grp").alias("b"))
    tried = stage(sieved(_ordered(first.unionByName(inside)).distinct()))
    links = verified(tried)
    labels = stage(components(links)).withColumnRenamed("node", "unit")

    many = stage(postings.select("grp").distinct().join(belongs, "grp", "left").select("grp", F.coalesce("unit", "grp").alias("unit")))

    def still_open() -> DataFrame:
        """Postings, by unit, of the shingles whose units lie in different components."""
        placed = stage(many.join(labels, "unit", "left").select("grp", "unit", F.coalesce("component", "unit").alias("comp")))
        spread = placed.groupBy("grp").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
        several = postings.join(spread, "grp").groupBy("shingle").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        several = several.where("low < high").select("shingle")
        out = stage(postings.select("shingle", "grp", "n", "at").join(several, "shingle").join(placed, "grp"))
        unstage(placed)
        return out

    # what is left: unit pairs of a shared shingle that lie in different components and have not been compared
    last = still_open()
    shapes = units.select("unit", *BITS)
    # sketches that differ in few bits tell who is near the head before any text moves
    alike = lambda a, b: differ(a, b) * 8 <= 3 * SKETCH
    bundles = stage(_bundles(last, shapes, alike))
    tables, inner, closed, of = [bundles], None, None, bundles
    if not bundles.isEmpty():
        checked, held = texts(bundles.select("unit"))
        sets = stage(checked.mapInArrow(partial(_sets, k=k), "unit long, n long, held array<long>"))
        unstage(*held)
        deltas = stage(_deltas(bundles.join(sets, "unit"), share))
        of = stage(deltas.select("unit", "bundle"))
        best = stage(deltas.groupBy("bundle").agg(F.min(F.struct("short", "unit")).alias("m")))
        # distances to the core add up: with the best member, and so with each other, these link for certain
        sure = deltas.join(best, "bundle").where((F.col("unit") != F.col("m.unit")) & (F.col("short") + F.col("m.short") <= 0))
        links, old = stage(links.unionByName(sure.select(F.col("m.unit").alias("a"), F.col("unit").alias("b")))), (links, labels)
        labels = stage(components(links)).withColumnRenamed("node", "unit")
        unstage(*old)
        placed = deltas.join(labels, "unit", "left").withColumn("comp", F.coalesce("component", "unit")).join(best, "bundle")
        # a shared value at place `at`, the first one, leaves d - at at most; two members need 2 (num + den) of it >= short + short
        some = placed.select("bundle", "unit", "comp", "n", "short", "d", "m", F.posexplode("delta").alias("at", "value"))
        some = some.withColumn("most", 2 * (num + den) * (F.col("d") - F.col("at"))).where(F.col("most") >= F.col("short") + F.col("m.short"))
        spread = some.groupBy("bundle", "value").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
        some = some.join(spread.select("bundle", "value"), ["bundle", "value"]).join(shapes, "unit")
        some = stage(some.select("bundle", "value", "unit", "comp", "n", "short", "most", *BITS))
        inner = some.alias("x").join(some.alias("y"), ["bundle", "value"]).where(
            (F.col("x.unit") < F.col("y.unit")) & (F.col("x.comp") != F.col("y.comp")) & able("x", "y")
            & (F.least("x.most", "y.most") >= F.col("x.short") + F.col("y.short")) & close("x", "y")
        ).select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"))
        # a large shingle that only members of one bundle hold is settled
        own = last.select("shingle", "unit").join(of, "unit", "left").withColumn("bundle", F.coalesce("bundle", -1 - F.col("unit")))
        own = own.groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("bundle").alias("low"), F.max("bundle").alias("high"))
        closed = stage(own.where((F.col("c") >= LARGE) & (F.col("low") == F.col("high"))).select("shingle"))
        tables += [sets, deltas, of, best, some, closed]
    left = last if closed is None else last.join(closed, "shingle", "left_anti")
    left = left.join(shapes.join(of, "unit", "left").withColumn("bundle", F.coalesce("bundle", -1 - F.col("unit"))), "unit")
    across = left.alias("x").join(left.alias("y"), "shingle").where(
        (F.col("x.unit") < F.col("y.unit")) & (F.col("x.comp") != F.col("y.comp")) & (F.col("x.bundle") != F.col("y.bundle"))
        & able("x", "y") & room("x", "y") & close("x", "y")
    )
    across = across.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"))
    rest = stage((across if inner is None else across.unionByName(inner)).distinct().join(tried, ["a", "b"], "left_anti"))
    unstage(*tables)
    more = verified(rest)
    labels = stage(components(links.unionByName(more))).withColumnRenamed("node", "unit")
    unstage(postings, last, many, tried, belongs, repeated)

    named = units.join(labels, "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    names = named.join(least, "component").select("hi", "lo", "n", F.col("component_id").alias("found_id"))
    # units with many copies: the join's larger partitions are split at run time
    out = rows.join(names, ["hi", "lo", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("found_id", "doc_id").alias("component_id"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _bundles(left: DataFrame, shapes: DataFrame, alike: Callable[[str, str], Column]) -> DataFrame:
    """(unit, bundle) of open postings (shingle, unit, comp): most units of a large group name the same head.

    Units unlike their head and bundles of one component are left out. This steers cost only.
    """
    wide = left.groupBy("shingle").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= LARGE)
    crowd = left.select("shingle", "unit", "comp").join(wide.select("shingle"), "shingle")
    # who has the most prefix shingles in common with others adds least of its own
    weight = crowd.groupBy("unit").agg(F.count(F.lit(1)).alias("w"))
    heads = crowd.join(weight, "unit").groupBy("shingle").agg(F.max(F.struct("w", "unit")).alias("head"))
    votes = crowd.join(heads, "shingle").groupBy("unit", "comp", F.col("head.unit").alias("bundle")).agg(F.count(F.lit(1)).alias("c"))
    named = votes.groupBy("unit", "comp").agg(F.max(F.struct("c", "bundle")).alias("v")).select("unit", "comp", "v.bundle")
    x, y = shapes.alias("x"), shapes.alias("y")
    named = named.join(x, named.unit == F.col("x.unit")).join(y, F.col("bundle") == F.col("y.unit")).where(alike("x", "y"))
    named = stage(named.select(F.col("x.unit").alias("unit"), "comp", "bundle"))
    large = named.groupBy("bundle").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    large = large.where((F.col("c") >= LARGE) & (F.col("low") < F.col("high")))
    return named.join(large.select("bundle"), "bundle").select("unit", "bundle")


def _deltas(members: DataFrame, share: Fraction) -> DataFrame:
    """Members (unit, bundle, n, held) as what they add to and lack of their bundle's core: `delta`, d values.

    Two sets that differ in d1 + d2 - 2 o values (o: shared values of the deltas) link if 2 o (num + den) >= short1 + short2.
    Sets far from the core are left out.
    """
    size = members.groupBy("bundle").agg(F.count(F.lit(1)).alias("c"))
    held = members.select("bundle", F.explode("held").alias("value")).groupBy("bundle", "value").agg(F.count(F.lit(1)).alias("m"))
    core = held.join(size, "bundle").where("2 * m > c").groupBy("bundle").agg(F.collect_list("value").alias("core"))
    added, lacking = F.array_sort(F.array_except("held", "core")), F.array_sort(F.array_except("core", "held"))
    out = members.join(core, "bundle").withColumn("delta", F.concat(added, lacking)).withColumn("d", F.size("delta").cast("long"))
    num, den = share.numerator, share.denominator
    short = F.col("d") * (num + den) - F.col("n") * (den - num)
    return out.where(3 * F.col("d") <= F.col("n") + F.size("core")).select("unit", "bundle", "n", "delta", "d", short.alias("short"))


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            sets = [s.view(np.int64) for s in shingle_sets(words(part.column(1)), k)]
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), n, pa.array(sets, pa.list_(pa.int64()))], names=["unit", "n", "held"])


def _same_set(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            sets = shingle_sets(words(part.column(4)), k)
            good = [
                (hi.as_py(), lo.as_py(), n.as_py()) == (*_signature(s), len(s))
                for s, hi, lo, n in zip(sets, part.column(1), part.column(2), part.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(4), part.column(5)], names=["unit", "text", "twice"]).filter(pa.array(good, pa.bool_()))


def _common(signed: DataFrame) -> np.ndarray:
    """The most frequent shingles, COMMON at most, in order of value."""
    sums = signed.where("kind = 's'").groupBy(F.col("doc_id").alias("shingle")).agg(F.sum("n").alias("c"))
    sums = stage(sums.where(F.col("c") >= LEAST_COMMON))
    n = sums.count()
    if not n:
        return np.zeros(0, np.uint64)
    if n > COMMON:
        edge = sums.agg(F.percentile_approx("c", F.lit(1 - 0.9 * COMMON / n), F.lit(10_000))).first()[0]
        sums = sums.where(F.col("c") > edge)
        if sums.count() > COMMON:  # the sketch was too far off
            sums = sums.where(F.col("c") > 2 * edge)
    held = sums.select("shingle").limit(COMMON).toArrow().column(0).to_numpy()
    return np.sort(held.astype(np.int64).view(np.uint64))
