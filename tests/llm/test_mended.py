"""Losses that were found in reading: unclosed elements, letters, spelled findings, samples of long texts."""

import re

import pytest

from tickloom.llm import language, pii
from tickloom.llm.blocks import leaf_blocks


@pytest.mark.parametrize(("page", "want"), [
    ("<article><p>a <svg><path d=x> one</p><p>two</p></article>", "a two"),
    ("<article><p>a <svg><path d=x></svg> one</p><p>two</p></article>", "a one two"),
    ("<article><p>a <button>x</p><p>two</p></article>", "a two"),
    ("<article><p>a <select><option>x</p><p>two <select><option>y</select></p></article>", "a two"),
    ("<p>x <math><mi>y</mi></math> z</p>", "x y z"),
    ("<p>x <object>y</object> z</p>", "x y z"),
    ("<p>x <svg/> z</p>", "x z"),
    ("text <svg> on", "text on"),
    ("<p>a<script>never closed", "a"),
])
def test_unclosed_elements_keep_the_rest(page, want):
    assert " ".join(" ".join(b.text for b in leaf_blocks(page)).split()) == want


def test_only_letters_count_as_words():
    assert language.plain("² ½ 12 ³") == b"" and language.plain("m² und x²y") == "m und xy".encode()


def test_at_in_any_spelling_is_looked_at():
    assert pii.MAY_HOLD.search("bob At example dot org") and not pii.MAY_HOLD.search("nothing whatever")


def test_proposals_near_any_base_span_are_left_out():
    text = "card 4111 1111 1111 1111 " + "1.2.3.4 " * 12 + "mail a@b.co"
    spans = pii.select(text, None)
    assert spans and all(base for *_, base in spans)


def test_examples_know_their_document():
    texts = ["mail a.b@c.org", "nothing", "ip 10.1.2.3 and call +1 212 555 0100 0"]
    x, y, doc = pii.examples(texts)
    assert len(x) == len(y) == len(doc) and set(doc.tolist()) == {0, 2}


def test_long_texts_train_too(spark):
    long = "filler words " * 4_000
    rows = [(i, (long if i % 2 else "") + f" mail user{i}@host{i}.example.org call +1 (212) 555-01{i:02d} ip 10.0.0.{i} " + (long if i % 2 else "")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pii.fit(docs, sample=50) is not None
    assert re.search("@", rows[0][1])
