"""Source divergence against plain sums over all terms, and the tree of rows against all pairs of each row."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickloom.llm import divergence


def plain(rows, least, top=50):
    """rows: (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang].add(source)
        n[lang, source].update(words)
        docs[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, of: 1 + 1_000_000_000 * (c + 5) // (of + 5 * len(kept))
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}
        for s in sources:
            pairs = [(u, sum(abs(share(n[lang, s][t], total[s]) - share(n[lang, u][t], total[u])) for t in kept)) for u in sources - {s}]
            terms = [(t, share(n[lang, s][t], total[s]) - share(whole[t], sum(total.values()))) for t in kept if n[lang, s][t]]
            for part, found, most in (("pair", pairs, None), ("term", [f for f in terms if f[1] > 0], top)):
                found.sort(key=lambda f: (-f[1], f[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize(("least", "held"), [(3, 1 << 18), (1, 8)])
def test_audit_matches_plain_sums(spark, monkeypatch, least, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rng = random.Random(least)
    vocabulary = ["the", "Of", "été", "naïve", "x1y", "don't", "A_B", "straße", "ÉTÉ", "ünder", "zoo", "kilo", "mega", "不是", "rare"]
    rows = [(" ".join(rng.choices(vocabulary, weights=range(15, 0, -1), k=rng.randrange(1, 60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None, ""])) for _ in range(120)]
    rows += [rows[0]] * 40 + [(None, "en", "only-null"), ("", "fr", "x"), ("123 ...", "fr", "y"), ("word", "es", "alone"), ("the " * 300_000, "en", "long"), ("zoo", None, None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(6)
    docs = docs.withColumns({c: F.lit("clash") for c in ("n", "term", "docs", "p", "q", "item", "value", "rank", "path", "total")})
    got = sorted(map(tuple, divergence.audit(docs, least=least).collect()))
    assert got == plain(rows, least)
    assert {r[2] for r in got if r[0] == "fr"} == {"pair"}


def test_defined_cases(spark, edge_docs, no_docs):
    assert divergence.audit(no_docs).collect() == []
    rows = [(r["text"], r["lang"], r["source"]) for r in edge_docs.select("text", "lang", "source").collect()]
    assert sorted(map(tuple, divergence.audit(edge_docs, least=2).collect())) == plain(rows, 2)
    kept_none = divergence.audit(edge_docs, least=10_000).collect()
    assert {r["value"] for r in kept_none} == {0} and {r["part"] for r in kept_none} == {"pair"}


def test_tree_adds_each_pair_of_a_row_once(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(300):
        sources = sorted(rng.sample(range(8), rng.randrange(2, 8)))
        rows.append((rng.choice("ab"), [(0, str(s), c, 100 + 7 * c * (s + 1), 90 + s) for s in sources for c in [rng.randrange(1, 4)]]))
    want = Counter()
    for lang, path in rows:
        for i, (_, s, _, p, z) in enumerate(path):
            for _, t, _, q, y in path[:i]:
                want[lang, t, s] += abs(p - q) - abs(p - y) - abs(z - q) + abs(z - y)
    df = spark.createDataFrame(rows, "lang string, path array<struct<total:long,source:string,n:long,p:long,z:long>>")
    got = divergence.tree_corrections(df.groupBy("lang", "path").agg(F.count(F.lit(1)).alias("m"))).collect()
    assert {(r["lang"], r["a"], r["b"]): r["v"] for r in got} == dict(want)
