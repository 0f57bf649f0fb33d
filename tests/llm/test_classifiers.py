import random
import zlib

import numpy as np
import pytest

from allelic.llm import html_extract, lang_id, toxicity

SYLLABLES = {"aa": "la mi so re do", "bb": "krü schtz ung ße", "cc": "éau que ion ç ré"}
BAD = ["vexum", "gorrip", "plonkers"]


def text(lang, n, r):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(8)
    rows = []
    for i in range(900):
        lang = r.choice(list(SYLLABLES))
        words = text(lang, r.randint(3, 120), r).split()
        toxic = r.random() < 0.15
        if toxic:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randint(0, len(words)), r.choice(BAD) + r.choice(["", "s"]))
        rows.append((i, " ".join(words), lang, int(toxic)))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(4)


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_language(spark, docs):
    rows, df = docs
    model = lang_id.fit(df)
    lang = {i: lang for i, _, lang, _ in rows}
    got = lang_id.identify(df.select("doc_id", "text"), model).collect()
    hits = [r["lang_pred"] == lang[r["doc_id"]] for r in got if held(r["doc_id"])]
    assert np.mean(hits) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(spark, docs):
    _, df = docs
    model = lang_id.fit(df)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 %%% 456", "x"), (4, "la mi so", "x"), (None, "la mi " * 200000, None)], "doc_id long, text string, score string")
    got = {r["doc_id"]: r for r in lang_id.identify(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert got[4]["lang_pred"] == got[None]["lang_pred"] == "aa"
    assert lang_id.identify(odd.limit(0), model).count() == 0
    assert lang_id.fit(df.where("lang is null")) is None
    assert {r["lang_pred"] for r in lang_id.identify(odd, None).collect()} == {"und"}


def test_toxicity(spark, docs):
    rows, df = docs
    labels = df.select("doc_id", "toxic")
    model = toxicity.train(df.select("doc_id", "text"), labels)
    toxic = {i: t for i, _, _, t in rows}
    got = [r for r in toxicity.score(df.select("doc_id", "text"), model).collect() if held(r["doc_id"])]
    assert np.mean([r["predicted"] for r in got if toxic[r["doc_id"]]]) >= 0.9
    assert np.mean([r["predicted"] for r in got if not toxic[r["doc_id"]]]) <= 0.03


def test_toxicity_edges(spark, docs):
    _, df = docs
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "vexum " * 50000)], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(odd, model).collect()}
    assert got == {1: 0, 2: 0, None: 1}
    none = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic").where("toxic = 0"))
    assert none is None and {r["score"] for r in toxicity.score(odd, None).collect()} == {0.0}


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy these nine things now and save some money.</div><article><h1>A&amp;B  title</h1><p><b>Lead.<br>more<p>Some <i>in</i>line text&nbsp;here.<p>One.</article><div id="comments"><p>First comment of a reader who has much to say about it.</p></div><form><p>Your e-mail address please</p></form><footer>&copy; us</footer>"""


def test_html():
    tree = html_extract.grow(*html_extract.labelled())
    assert html_extract.main_text(PAGE, tree) == "A&B title Lead. more Some inline text here. One."
    assert html_extract.main_text(None, tree) == html_extract.main_text("", tree) == ""
    assert html_extract.main_text("<script>never closed <p>x</p>", tree) == ""
    x, y = html_extract.labelled()
    assert all(html_extract.classify(tree, r) == t for r, t in zip(x.tolist(), y, strict=True))


def test_html_pages(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "c"), (2, None, None, None), (2, None, None, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract(df).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, 48] and got[0].__fields__ == ["page_id", "url", "text", "n_chars"]
    assert html_extract.extract(df.limit(0)).count() == 0
