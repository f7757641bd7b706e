"""Main text: the given pages by an independent reading of them, other markups, and what the network learned."""

import html
import re

import numpy as np
import pytest

from pagevault.llm import pages
from pagevault.llm.queries import QUERIES


def article(page):
    """Text of the one article of a given page, by string operations."""
    start = page.find("<article>")
    if start < 0:
        return ""
    end = page.find("</article>", start)
    body = page[start + 9 : end] if end >= 0 else re.sub(r"<[^>]*\Z", "", page[start + 9 :])
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(x for x in parts if x)


@pytest.fixture(scope="module")
def model(spark):
    return pages.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_query_gives_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    given = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = QUERIES["op6_main_text"](spark, sf).collect()
    assert len(got) == len(given)
    for r in got:
        assert (r.url, r.text, r.n_chars) == (given[r.page_id].url, article(given[r.page_id].html), len(r.text))


OTHER = """<!DOCTYPE html><html><head><title>No</title><style>p {}</style></head><body class="home"><div id="page-header"><a href="/">Site name</a>
<ul class="menu"><li><a href=/a>One</a><li><a href=/b>Two</a></ul></div><div class="cookie-banner">We use cookies <button>OK</button></div>
<main><h1>A title &amp; more</h1><p>First&nbsp;paragraph,  with <b>bold</b>
words<br>and a break.<div class="advert"><p>Buy this now, it is cheap and good.</p></div><p>Second paragraph: 1 &lt; 2.<script>if (a</b>) {}</script>
<form><input name=q><label>Search</label></form><section class="comments"><h3>Comments</h3><p>I liked this text a lot, thank you.</p></section></main>
<aside><p>Other stories that you may like to read.</p></aside><footer>&copy; 2024</footer><!-- <p>no</p> --></body></html>"""


def test_other_markup(model):
    b = pages.blocks(OTHER)
    keep = pages.predict([b], model)[0]
    assert [x[1] for x, k in zip(b, keep) if k] == ["A title & more", "First paragraph, with bold words and a break.", "Second paragraph: 1 < 2."]


def test_variants_are_learned(spark, model):
    rows = [pages.blocks(r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    many, labels = pages.variants(rows, seed=77)
    wrong = [np.mean(np.array(y) != p) for y, p in zip(labels, pages.predict(many, model)) if y]
    assert np.mean(wrong) < 0.01


def test_the_whole_page_matters(model):
    """A block's state depends on blocks far before and after it."""
    page = [((("html",), ("div",), ("p",)), f"Some words of text number {i}.", 0.0) for i in range(12)]
    data = pages.inputs([page])
    x, _, _ = pages._embed(data, model)
    fwd, bwd, there = pages._layout(data["sizes"])
    for order, w, u, b in ((fwd, "wf", "uf", "bf"), (bwd, "wb", "ub", "bb")):
        changed = x.copy()
        changed[order[0, 0]] += 3
        one, two = (pages._run(v[order], there, model[w], model[u], model[b], False)[0][0, 4] for v in (x, changed))
        assert np.abs(one - two).max() > 1e-6


def test_odd_rows(spark, model):
    texts = [None, "", "no markup at all", "<p", "<article><p>a &am", "<article>" + "<p>word word. </p>" * 20_000 + "</article>", "<div>" * 3000 + "deep", "<script>never closed <p>x", "&#0; &bogus; <3 & 4"]
    df = spark.createDataFrame([(None, t, "x") for t in texts] * 2, "page_id long, html string, text string").coalesce(1)
    got = pages.main_text(df, model, "page_id").collect()
    assert len(got) == 2 * len(texts) and all(r.page_id is None and r.n_chars == len(r.text) for r in got)
    assert got[0].text == got[1].text == "" and got[4].text == "a &am"
    assert pages.main_text(df.limit(0), model, "page_id").count() == 0
