"""The numbered operators against brute force on small tables, and their defined results on odd input."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import blocks, boost, common, decontaminate, extract, forest, language, ngram_join, pieces, pii, quality, secrets, spans, warc, words
from tickloom.llm.common import components, slices


def rows(df):
    return [tuple(r) for r in df.collect()]


# shared helpers


def test_word_arrays_match_a_plain_split():
    texts = ["Ab c\x0bD\x85e", None, "", " x ", "É é", "one two three four five"] * 3
    found = words.words(pa.array(texts))
    plain = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) for t in texts]
    assert np.diff(found.bounds).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    by_value = defaultdict(set)
    for w, v in zip(flat, found.value.tolist()):
        by_value[v].add(w)
    assert all(len(s) == 1 for s in by_value.values()) and len(by_value) == len(set(flat))
    batch = pa.RecordBatch.from_pydict({"t": pa.array(texts)})
    assert sum(p.num_rows for p in slices(batch, "t", 4)) == len(texts)


def test_components_are_exact(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(900 + i, 901 + i) for i in range(40)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    got = dict(rows(components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {x: top(x) for x in up}
    assert rows(components(spark.createDataFrame([], "a long, b long"))) == []


# 1


@pytest.mark.parametrize("scaled", [False, True])
def test_forest_finds_the_nearest(spark, scaled):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 12)).astype(np.float32)
    x *= (1 + rng.random((400, 1)) * 3 if scaled else 1 / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    x[50:90] = x[50]  # copies
    data = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1001, [], 0), (1002, [0.0] * 12, 0), (1003, [float("nan")] * 12, 0), (1004, [1.0, None], 0), (1005, [1.0], 0), (None, x[0].tolist(), 0), (20, x[20].tolist(), 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, unit int").repartition(3)
    got = defaultdict(list)
    for q, r, v, s in sorted(rows(forest.search(df, F.col("id") % 20 == 0, recall=0.99))):
        got[q].append((r, v, s))
    assert sorted(got) == list(range(0, 400, 20))
    d = x.astype(np.float64)
    hits = 0
    for q, found in got.items():
        score = d @ d[q]
        order = [i for i in np.lexsort((np.arange(400), -score)) if i != q][:20]
        assert [r for r, _, _ in found] == list(range(1, 21)) and q not in [v for _, v, _ in found]
        assert all(abs(s - score[v]) < 1e-12 for _, v, s in found)
        assert found == sorted(found, key=lambda f: (-f[2], f[1]))
        hits += len({v for _, v, _ in found} & set(order))
    assert hits / (20 * len(got)) >= 0.9


def test_forest_small_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert sorted(rows(forest.search(df, F.col("id") % 20 == 0))) == [(0, 1, 1, 1.0), (0, 2, 2, 0.5)]
    assert rows(forest.search(df.where("false"), F.col("id") % 20 == 0)) == []


# 2


def test_quality_rejects_junk_and_shrinks_sparse_sites(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    out = quality.assess(docs, labels)
    both = rows(out.join(labels, "doc_id").select("quality", "keep"))
    assert sum((q == 1) == k for q, k in both) / len(both) > 0.9
    p = sorted(r[0] for r in rows(out.select("p_site").distinct()))
    prior = out.agg(F.avg("p_doc")).first()[0]
    raw = [r[0] for r in rows(out.groupBy("source", "lang").agg(F.avg("p_doc")).select("avg(p_doc)"))]
    assert p[0] >= min(raw) - 1e-9 and p[-1] <= max(raw) + 1e-9 and p[0] <= prior <= p[-1]


def test_quality_on_odd_input(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(0, None), (4, 1), (4, 0), (12, 0)], "doc_id long, quality int")
    assert quality.assess(edge_docs, labels).count() == edge_docs.count()
    assert quality.assess(no_docs, labels).count() == 0
    silent = quality.assess(edge_docs, labels.where("false"))
    assert {r[0] for r in rows(silent.select("keep"))} == {True}


# 3


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "y" * 1200 + "</p>"
    nasty = ["a\r\n\r\nb", "\r\n\r\n", "x\r\n", "x\r", "x\r\n\r", "\r\n\r\n\r\n", "é" * 700 + "\r\n", "WARC/1.1\r\n\r\n", "", None]
    data = [(i, f"http://h/{i}\nx", t) for i, t in enumerate(nasty)] + [(20 + i, None, big) for i in range(6)] + [(25, "again", big), (None, "n", big), (40, "s", "short"), (41, "s", "short")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("body", F.lit("clash")).repartition(2)
    path = f"file://{tmp_path}/w"
    warc.write_archives(warc.records(pages), path)
    got = rows(warc.read_archives(spark, path).select("page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"))
    want = []
    for i, _, t in data:
        payload = (t or "").encode()
        revisit = t == big and i != 25
        want.append((i, "revisit" if revisit else "response", 25 if revisit else None, hashlib.sha1(payload).hexdigest(), len(payload), None if revisit else payload))
    key = lambda r: (r[0] is None, r[0] or 0, str(r))
    assert sorted(((*g[:5], None if g[5] is None else bytes(g[5])) for g in got), key=key) == sorted(want, key=key)
    warc.write_archives(warc.records(pages.where("false")), path + "0")
    assert rows(warc.read_archives(spark, path + "0")) == []


# 4


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_piece_ids_are_those_of_the_library(spark, sf_dir, vocabulary):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    encoder = pieces.Encoder(vocabulary)
    texts = [r[0] for r in rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))]
    rng = np.random.default_rng(2)
    bits = [" ", "  ", "a", "the", "\n", "é", "😀", "12", "    ", "import", "\t", "x" * 30, "不", "\r\n", "======", " " * 40]
    texts += ["".join(bits[i] for i in rng.integers(0, len(bits), 10)) for _ in range(3000)]
    texts += ["x" * 3000, "ab" * 3000, " " * 999, "thethe" * 900]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == library.encode(t), t[:80]
        assert pieces.decode(ids, vocabulary.text_of) == t


def test_streaming_commits_equal_the_whole_lattice():
    rng = np.random.default_rng(3)
    names = ["a", "b", "c", "ab", "bc", "abc", "ca", "bca", "cab", "▁"]
    scores = {c: -float(rng.random() * 5) for c in names}
    unigram = pieces.Encoder(pieces.Vocabulary({c: i for i, c in enumerate(names)}, scores, [0] * 256, [], "unigram"))

    def best(t):
        table = [0.0] + [-1e18] * len(t)
        for end in range(1, len(t) + 1):
            table[end] = max(table[end - n] + scores[t[end - n : end]] for n in range(1, min(3, end) + 1) if t[end - n : end] in scores)
        return table[-1]

    for size in (1, 5, 31, 32, 33, 400):
        t = "".join("abc"[i] for i in rng.integers(0, 3, size))
        found = list(unigram.committed(t))
        assert "".join(found) == t and abs(sum(scores[p] for p in found) - best(t)) < 1e-6


def test_piece_columns_on_odd_input(spark, edge_docs, no_docs, vocabulary):
    for docs in (edge_docs, no_docs):
        out = docs.select("text", pieces.encoded(spark, F.col("text"), vocabulary).alias("p")).select("text", "p.*")
        out = out.withColumn("back", pieces.decoded(spark, F.col("ids"), vocabulary))
        assert all(r["text"] == r["back"] and (r["ids"] is None) == (r["text"] is None) and r["exact"] is not False for r in out.collect())


# 5 and 10


def brute_personal(t):
    luhn = lambda d: sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    find = lambda p: re.finditer(p, t)
    return (
        [("email", *m.span()) for m in find(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")]
        + [("ip", *m.span()) for m in find(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)") if all(int(x) <= 255 for x in m[0].split("."))]
        + [("card", *m.span()) for m in find(r"[0-9]([\x20-]?[0-9])+") if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
        + [("phone", *m.span()) for m in find(r"\+[0-9][\x20().0-9-]+[0-9]") if 9 <= len(digits(m[0])) <= 15]
    )


def brute_secrets(t):
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    return (
        [("assign", *m.span()) for m in re.finditer(assign, t) if len(m[2]) >= 6]
        + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    )


def test_base_spans_match_the_plain_patterns():
    rng = np.random.default_rng(6)
    bits = ["a", "b", "@", ".", "1", "2", "9", "0", "+", "-", " ", "(", "_", "%", "é", "٣", "4000 0000 0000 0002", "x@y.z", "255", "token", "Token", "=", ":", '"', "AKIA", "abcdef0123456789", "A", "K", "\n", "ſ", "key", "api_"]
    for _ in range(20_000):
        t = "".join(bits[i] for i in rng.integers(0, len(bits), rng.integers(0, 25)))
        assert pii.base_spans(t) == brute_personal(t), t
        assert secrets.base_spans(t) == brute_secrets(t), t


def test_long_runs_stay_linear():
    for t in ("1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 100_000, "token" * 40_000, "+1" * 60_000, "f" * 200_000):
        pii.select(t, None)
        secrets.base_spans(t)


def personal_docs(spark):
    rng = np.random.default_rng(8)

    def card():
        d = "".join(map(str, rng.integers(0, 10, 15)))
        return d + next(c for c in "0123456789" if spans.luhn_ok(d + c))

    out = []
    for i in range(160):
        c = card()
        out.append((i, f"some words user{i}@site{i % 9}.example.com then {c} and 10.{i}.7.9 call +1 (212) 555-{1000 + i} not {c[:-1]}{(int(c[-1]) + 1) % 10} or 300.1.2.{i} done"))
    return spark.createDataFrame(out, "doc_id long, text string")


def test_trees_add_spelled_out_findings_and_keep_base(spark):
    docs = personal_docs(spark)
    model = pii.fit(docs)
    assert model is not None
    more = spark.createDataFrame([(1, "write to jane.doe (at) mail (dot) example (dot) com now"), (2, "meet me at the house. dot matrix"), (3, "plain words only")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find(more, model=model).collect()}
    assert "email" in got[1]["spans"] and got[2]["spans"] == "" and got[3]["spans"] == ""
    for r in pii.find(docs, model=model).collect():
        t = docs.where(F.col("doc_id") == r["doc_id"]).first()["text"] if r["doc_id"] < 2 else None
        base = [(f["kind"], f["start"], f["end"]) for f in r["found"] if f["base"]]
        assert r["base_sha256"] == hashlib.sha256(spans.listed(base, pii.KINDS).encode()).hexdigest()
        assert t is None or base == brute_personal(t)


def test_personal_data_on_odd_input(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        got = pii.find(docs, model=pii.fit(docs))
        assert got.count() == docs.count()
    email = [r for r in pii.find(edge_docs).collect() if r["doc_id"] == 9]
    assert len(email) == 2 and all((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == (1, 1, 1, 1) for r in email)


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2, (600, 4)).astype(float)
    y = ((x[:, 0] == 1) & (x[:, 1] == 0)).astype(float)
    trees = boost.Trees().fit(x[:400], y[:400])
    trees.calibrate(x[400:], y[400:])
    assert ((trees.predict(x[400:]) >= 0.5) == y[400:]).all()


def test_secrets_separate_copied_from_owned(spark, edge_docs, no_docs):
    own, copied, rand = "0123456789abcdef01234567a1", "feedfacefeedfacefeedface00", "aB3" + "xY7kQ9zLmN2pR4sT" * 2
    data = [(i, f"pad {copied} end", f"org{i}/repo") for i in range(6)] + [(10, f"pad {own} {own}", "org1/repo"), (11, f"pad {rand} end", "org2/a")]
    got = {r["doc_id"]: r for r in secrets.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert all(got[i]["n_example"] == 1 and got[i]["n_live"] == 0 and got[i]["most_owners"] == 6 for i in range(6))
    assert (got[10]["n_live"], got[10]["n_hex"], got[10]["spans"]) == (2, 2, "hex:4:30,hex:31:57")
    assert got[11]["spans"] == f"random:4:{4 + len(rand)}" and got[11]["n_hex"] == 0
    assert secrets.judge(edge_docs).count() == edge_docs.count() and secrets.judge(no_docs).count() == 0


# 6


def test_language_by_compression(spark, sf_dir, edge_docs, no_docs):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = language.classify(docs, language.learn(docs.where("doc_id % 2 = 0"))).join(docs.select("doc_id", "lang"), "doc_id")
    held = rows(found.where("doc_id % 2 = 1").select("lang", "lang_pred"))
    assert sum(a == b for a, b in held) / len(held) > 0.93
    odd = language.classify(edge_docs, language.learn(edge_docs)).collect()
    assert len(odd) == edge_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert {r["lang_pred"] for r in odd if r["doc_id"] in (0, 1, 12)} == {"und"}
    assert language.classify(no_docs, language.learn(no_docs)).count() == 0


# 7


def brute_links(data, k, share):
    sets = []
    for _, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(data)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= share * len(sets[i] | sets[j]) - 1e-12:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i in range(len(data)):
        if data[i][0] is not None:
            least[top(i)].append(data[i][0])
    return sorted((str(d), len(s), str(min(least[top(i)], default=None) if s else d)) for i, ((d, _), s) in enumerate(zip(data, sets)))


@pytest.mark.parametrize("k,threshold", [(4, "0.85"), (5, "0.8")])
def test_jaccard_join_is_exact(spark, k, threshold):
    rng = np.random.default_rng(12)
    base = [[f"w{i}" for i in rng.integers(0, 60, rng.integers(5, 80))] for _ in range(12)]
    common = [f"c{i}" for i in range(30)]
    data = []
    for i in range(260):
        w = list(base[i % 12])
        for _ in range(rng.integers(0, 3)):
            w[rng.integers(0, len(w))] = f"n{rng.integers(0, 9)}"
        data.append((i * 3, " ".join(common + w if i % 3 else w)))
    data += [(9000, None), (9001, ""), (9002, "one two"), (9003, "ONE  two"), (9004, "one"), data[5], (9005, data[7][1])]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("unit", "n", "hi", "head", "grp")})
    got = sorted((str(a), b, str(c)) for a, b, c in rows(ngram_join.join(docs.repartition(3), k=k, threshold=threshold)))
    assert got == brute_links(data, k, float(threshold))


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (1, 5, 60, 400, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for out in (0, n // 12, n // 3):
            b = np.concatenate([a[out:], rng.integers(0, 2**63, out // 2, dtype=np.uint64)])
            x, y = ngram_join._sketch(a), ngram_join._sketch(b)
            assert len(x) == len(ngram_join.BITS)
            assert int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) <= len(np.setxor1d(a, b))


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(8)
    base = [f"b{i}" for i in range(60)]
    data = []
    for i in range(300):
        w = list(base)
        for at in rng.choice(60, rng.integers(1, 4), replace=False):
            w[at] = f"n{i}_{at}" if i % 2 else f"m{rng.integers(0, 3)}"
        data.append((i, " ".join(w)))
    data += [(i, data[i % 7][1]) for i in range(280, 310)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = sorted((str(a), b, str(c)) for a, b, c in rows(ngram_join.join(docs.repartition(3), k=4, threshold="0.85")))
    assert got == brute_links(data, 4, 0.85)


@pytest.mark.parametrize("with_base", [True, False])
def test_near_copies_that_fail_to_link_are_not_compared_in_pairs(spark, monkeypatch, with_base):
    rng = np.random.default_rng(21)
    base = [f"b{i}" for i in range(150)]
    texts = [list(base)] * with_base
    for i in range(500):
        w = list(base)
        for at in rng.choice(150, 1 + i % 6, replace=False):  # from three words on, most copies link with nothing
            w[at] = f"n{i}_{at}" if i % 5 else f"m{at % 7}"
        texts.append(w[: 150 - (i % 4) * 5] + ([f"tail{i % 9} of a few words"] if i % 3 == 0 else []))
    data = [(i, " ".join(w)) for i, w in enumerate(texts)]
    staged, stage = [], ngram_join.stage

    def counted(df):
        out = stage(df)
        staged.append(out.count() if out.columns == ["a", "b"] else 0)
        return out

    monkeypatch.setattr(ngram_join, "stage", counted)
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted((str(a), b, str(c)) for a, b, c in rows(ngram_join.join(docs, k=4, threshold="0.85")))
    assert got == brute_links(data, 4, 0.85)
    assert 100 < len({c for _, _, c in got}) < 450
    assert sum(staged) < 40 * len(data), staged


def test_bitmaps_lose_no_key(spark):
    docs = spark.range(5000).select(F.when(F.col("id") != 7, F.col("id")).alias("doc_id"), F.lit("x").alias("text"))
    keys = docs.where("doc_id % 3 = 0 OR doc_id IS NULL").select("doc_id")
    some, none = common.may_hold(docs, "doc_id", keys), common.may_hold(docs, "doc_id", keys, "left_anti")
    wanted = {r[0] for r in keys.collect()}
    assert wanted <= {r[0] for r in some.collect()} and some.count() + none.count() == 5000 and some.count() < 2500
    assert "Python" not in some._jdf.queryExecution().toString()


def test_jaccard_join_on_odd_input(spark, edge_docs, no_docs):
    got = rows(ngram_join.join(edge_docs))
    assert len(got) == edge_docs.count()
    by_id = defaultdict(set)
    for i, n, c in got:
        by_id[i].add((n, c))
    assert by_id[4] == by_id[5] == {(4, 4)} or {c for _, c in by_id[4] | by_id[5] | by_id[6]} == {4}
    assert by_id[1] == {(0, 1)}
    assert rows(ngram_join.join(no_docs)) == []


# 8


def test_alignment_matches_the_textbook_form():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 5, rng.integers(1, 14)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
                h[i, j] = max(0, h[i - 1, j - 1] + s, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
        assert decontaminate.align(a, b)[0] == h.max()


def test_decontamination_catches_edited_copies(spark, edge_docs, no_docs):
    rng = np.random.default_rng(9)
    word = lambda: "".join("abcdefghij"[i] for i in rng.integers(0, 10, 6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(90, None), (91, ""), (92, "two words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    data, want = [], {}
    for i in range(60):
        noise = [word() for _ in range(80)]
        copy = items[i % 12][1].split()
        if i % 3 == 1:  # edited: some words replaced, dropped and added
            copy = [w for j, w in enumerate(copy) if j % 11]
            copy[4] = copy[17] = word()
            copy.insert(9, word())
        data.append((i, " ".join(noise[:40] + (copy if i % 3 else []) + noise[40:]).upper()))
        want[i] = i % 3 != 0
    got = decontaminate.score(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()
    assert {r["doc_id"]: r["contaminated"] for r in got} == want
    assert all(r["item_id"] == r["doc_id"] % 12 for r in got if r["contaminated"])
    assert decontaminate.score(edge_docs, bench).count() == edge_docs.count()
    assert decontaminate.score(no_docs, bench).count() == 0
    assert {r["contaminated"] for r in decontaminate.score(edge_docs, bench.where("false")).collect()} == {False}


def test_decontamination_finds_what_full_alignment_finds(spark):
    item = [f"w{j}" for j in range(40)]
    swapped = [w if j % 5 else f"z{j}" for j, w in enumerate(item)]
    texts = [item, swapped, item[:12] + [f"y{j}" for j in range(28)] + item[12:], ["a"] * 30 + swapped + ["b"] * 30, item[:15], swapped[:20]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    number = {w: i for i, w in enumerate({w for t in texts for w in t})}
    plain = {i: decontaminate.align(*(np.array([number[w] for w in t]) for t in (item, text)))[0] / 80 for i, text in enumerate(texts)}
    got = {r["doc_id"]: r["score"] for r in decontaminate.score(docs, bench).collect()}
    assert got == {i: s if s >= 0.5 else None for i, s in plain.items()}
    assert [i for i, s in got.items() if s is None] == [4, 5]


def test_decontamination_in_blocks_gives_the_same(spark, monkeypatch):
    items = [(i, " ".join(f"q{i}x{j}" for j in range(20))) for i in range(40)]
    data = [(i, f"pre text {items[i % 40][1]} and {items[(i * 7) % 40][1]} post" if i % 2 else "nothing here at all") for i in range(80)]
    docs, bench = spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(rows(decontaminate.score(docs, bench)), key=str)
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 9)
    assert sorted(rows(decontaminate.score(docs, bench)), key=str) == one


# 9


def test_blocks_of_untidy_pages():
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><ul><li><a href=x>One<li>Two</ul></nav>"
        "<article><h1>Head &amp; more</h1><p>a<b>b</b>c<br>d<p>second   line\n<!-- no --> end</article><table><tr><td>x<td>y</table><p>cut &am"
    )
    got = [(b.text, b.path[-1]) for b in blocks.leaf_blocks(page)]
    assert [t for t, _ in got] == ["One", "Two", "Head & more", "abc", "d", "second line end", "x", "y", "cut &am"]
    assert blocks.leaf_blocks("") == [] and blocks.leaf_blocks("<p") == [] and blocks.leaf_blocks("a < b")[0].text == "a < b"
    assert blocks.leaf_blocks("<div>" * 5000 + "x" + "</div>" * 5000)[0].text == "x"


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = extract.Network.new(6, 3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, mask = extract.padded([rng.standard_normal((n, 6)) for n in (4, 2, 5)])
    x, y = x.astype(np.float64), (rng.random(mask.shape) < 0.5).astype(float)
    _, grad = net.gradient(x, mask, y)
    for k, g in grad.items():
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        old = net.w[k][at]
        loss = []
        for d in (1e-4, -1e-4):
            net.w[k][at] = old + d
            loss.append(net.gradient(x, mask, y)[0])
        net.w[k][at] = old
        assert abs((loss[0] - loss[1]) / 2e-4 - g[at]) < 1e-4 * max(1, abs(g[at])), k


def test_main_text_of_the_given_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/pages.parquet")
    more = spark.createDataFrame([(-1, "u", None), (-2, "u", ""), (-3, None, "<p></p>")], "page_id long, url string, html string")
    both = pages.unionByName(more).withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in extract.extract(both, extract.fit(pages)).collect()}

    def plain(h):
        m = re.search(r"<article>(.*?)(</article>|$)", h or "", re.S)
        t = re.sub(r"<(/?)(\w+)[^>]*(>|$)", lambda m: " " if m[2] in ("p", "h1", "br") else "", m[1] if m else "")
        return " ".join(html.unescape(re.sub(r"<[^>]*$", "", t)).split())

    for i, _, h, _ in rows(both):
        assert got[i]["text"] == plain(h) and got[i]["n_chars"] == len(got[i]["text"])
    assert extract.extract(pages.where("false"), None).count() == 0
