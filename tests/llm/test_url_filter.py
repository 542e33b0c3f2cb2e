"""URL filter against plain loops, held-out accuracy of its table, defined results on odd input."""

import re

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import url_filter, url_labels
from tickloom.llm.words import mix

URLS = [
    None, "", "no scheme/en/", "http://", "http://A.Example.NET", "https://a.example.net/en/x?q#f", "http://EXAMPLE.net/en/", "http://badexample.net/en/",
    "http://x.example.com/de/1", "http://example.com/de", "http://y.org/fr/2#t", "http://y.org/FR/2", "http://org/fr/", "ftp://u@h:80?x=1://z/", "a://b://c/d",
    "http://\n.net/\n/é?", "http://casino-win.example.org/en/1", "http://casino-win.example.org/en/1", "http://É.net/", "https://garden.example.org/" + "long/" * 40_000,
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    found = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in found[1]), found[2]


def rule(host, path):
    fits = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fits, key=len, default=None)


def plain_score(model, host, path):
    """Every n-gram by itself, in Python integers where the operator uses arrays."""
    total = model.bias
    for tag, text in ((0, f"^{host}$"), (1, f"{path}$")):
        data = [48 if 48 <= b <= 57 else b + 32 if 65 <= b <= 90 else b for b in text.encode()]
        grams = [(i, n) for n in url_filter.LENGTHS for i in range(len(data) - n + 1)]
        for i, n in grams:
            state = 0x9E3779B97F4A7C15 * (tag + 1) % 2**64
            for b in data[i : i + n]:
                code = int(mix(np.array([b + 0x5851F42D4C957F2D], np.uint64))[0])
                state = int(mix(np.array([(state * 0xD1342543DE82EF95 + code) % 2**64], np.uint64))[0])
            bucket = int(mix(np.array([(state + n) % 2**64], np.uint64))[0]) >> (64 - model.bits)
            total += model.weight[bucket] * (url_filter.HOST_SCALE if tag == 0 else len(grams) ** -0.5)
    return 1 / (1 + np.exp(-total))


@pytest.fixture(scope="module")
def model(spark):
    return url_filter.fit(spark.createDataFrame(url_labels.labelled(), "url string, label int"))


def test_hosts_paths_rules_and_verdicts(spark, model):
    rows = [(i if i % 7 else None, u, "clash", "clash") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").repartition(3)
    got = sorted(map(tuple, url_filter.judge(pages, model).collect()), key=str)
    want = []
    for i, u in enumerate(URLS):
        host, path = parts(u)
        fits = rule(host, path)
        p = float(model.score(pa.array([host]), pa.array([path]))[0])
        verdict = dict((r, a) for a, r in url_filter.RULES)[fits] if fits else "block" if p >= 0.5 else "allow"
        want.append((i if i % 7 else None, host, path, fits, verdict, p))
    assert got == sorted(want, key=str)
    assert [rule(*parts(u)) for u in URLS[4:13]] == [None, "example.net/en/", "example.net/en/", "net/", "example.com/de/", None, "org/fr/", None, "org/fr/"]


def test_scores_match_a_plain_loop(model):
    for u in [*URLS[:-1], "https://free-bets.example.com/en/77"]:
        host, path = parts(u)
        assert abs(plain_score(model, host, path) - model.score(pa.array([host]), pa.array([path]))[0]) < 1e-9


def test_held_out_accuracy():
    table = url_labels.labelled()
    host, path = (pa.array([parts(u)[i] for u, _ in table]) for i in (0, 1))
    y = np.array([label for _, label in table], float)
    fold = np.random.default_rng(0).permutation(len(y)) % 5
    right = []
    for k in range(5):
        seen = pa.array(fold != k)
        fitted = url_filter.fit_arrays(host.filter(seen), path.filter(seen), y[fold != k])
        hidden = pa.array(fold == k)
        right += list((fitted.score(host.filter(hidden), path.filter(hidden)) >= 0.5) == y[fold == k])
    assert np.mean(right) > 0.95


def test_unseen_hosts(model):
    bad = ["casino-win.example.net", "m.cheap-pills.example.com", "ads-track.example.org", "free-bets.example.com", "poker-jackpot.com"]
    good = ["www.example.org", "intranet.example.com", "blog.smith-family.net", "stadtwerke.example.com", "lindqvist.org"]
    p = model.score(pa.array(bad + good), pa.array(["/en/12"] * 10))
    assert (p[:5] >= 0.5).all() and (p[5:] < 0.5).all()


def test_empty_tables_and_labels(spark, model):
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(none, model).collect() == []
    silent = url_filter.fit(spark.createDataFrame([("http://a/b", 1), (None, 0), ("http://c/d", None)], "url string, label int"))
    assert {r["verdict"] for r in url_filter.judge(spark.createDataFrame([(1, "http://casino.com/"), (2, None)], "page_id long, url string"), silent, rules=()).collect()} == {"allow"}
