"""HTML jobs on hand-made pages."""

import datetime as dt
import random

from pyspark.sql import functions as F

from pagevault.operators import html as H
from pagevault.operators import metadata as M

LONG = "Some words that make this paragraph long enough to count. " * 3


def page(spark, html, url="https://site.org/a/b?c"):
    return spark.createDataFrame([(1, url, html)], "page_id long, url string, html string")


def text_of(spark, html, **kw):
    return H.page_text(page(spark, html, **kw)).first()


def test_unclosed_and_void_elements(spark):
    els = H.html_elements(page(spark, "<ul><li>a<li>b</ul><p>x<p>y<br>z<div>q</div><b>open")).orderBy("pos").collect()
    starts = [(e["tag"], e["path"]) for e in els if e["tag"] != "#text"]
    assert starts == [
        ("ul", "/ul"), ("li", "/ul/li"), ("li", "/ul/li"), ("p", "/p"), ("p", "/p"), ("br", "/p/br"), ("div", "/div"), ("b", "/b"),
    ]
    assert all(e["end_pos"] >= e["pos"] for e in els)


def test_strip_and_links(spark):
    html = (
        "<body><script>var a='<p>no</p>';</script><style>x</style><!-- c --><div onclick='f()'><p>gone</p></div>"
        "<p>kept <a href='x/y'>one</a><a href='//cdn/z'>two</a><img src='/i.png' alt='pic'></p></body>"
    )
    rows = H.element_rows(H.clean_tokens(page(spark, html))).collect()
    texts = [r["text"] for r in rows if r["tag"] == "#text"]
    assert texts == ["kept ", "one", "two"]
    links = [(r["attrs"].get("href"), r["attrs"].get("src")) for r in rows if r["tag"] in ("a", "img")]
    assert links == [("https://site.org/x/y", None), ("https://cdn/z", None), (None, "https://site.org/i.png")]


def test_markdown(spark):
    html = (
        f"<body><nav>menu</nav><article><h1>Top</h1><p>{LONG}<b>bold</b> and <em>it</em> <a href='/l'>link</a></p>"
        "<ul><li>one</li><li>two<ol><li>in</li><li>ner</li></ol></li></ul><h2>Sub</h2><pre>code  here</pre><p>a_b</p></article><footer>foot</footer></body>"
    )
    md = text_of(spark, html)["markdown"]
    assert md.startswith("# Top\n\nSome words")
    assert "**bold** and *it* [link](https://site.org/l)" in md
    assert "\n* one\n* two" in md and "\n  1. in\n  2. ner" in md
    assert "## Sub" in md and "```\ncode  here\n```" in md and "a\\_b" in md
    assert "menu" not in md and "foot" not in md


def test_container_choice(spark):
    html = f"<body><div class='post'><p>{LONG}</p><p>x</p><p>y</p></div><main><p>{LONG}</p><p>{LONG}</p><h2>h</h2></main></body>"
    parsed = H.clean_tokens(page(spark, html))
    scores = H.container_score(parsed)
    assert {r["selector"] for r in scores.collect()} == {"main", ".post"}
    assert H.best_container(scores).first()["selector"] == "main"
    main = H.main_content(parsed).select("main.*").first()
    best = H.best_container(scores).first()
    assert (main["pos"], main["end_pos"]) == (best["pos"], best["end_pos"])


def test_tie_keeps_earlier_selector(spark):
    block = f"<p>{LONG}</p><p>{LONG}</p><p>x</p>"
    html = f"<body><div class='content'>{block}</div><div class='post'>{block}</div></body>"
    assert H.best_container(H.container_score(H.clean_tokens(page(spark, html)))).first()["selector"] == ".post"


def test_paragraph_fallback_and_body(spark):
    html = f"<body><div><p>a</p></div><div><p>{LONG}</p><p>{LONG}</p><p>end</p></div><span>side</span></body>"
    found = H.para_fallback(H.clean_tokens(page(spark, html))).first()
    assert found is not None
    md = text_of(spark, html)["markdown"]
    assert "end" in md and "side" not in md
    assert text_of(spark, "<body><span>only a few words</span></body>")["markdown"] == "only a few words"
    assert text_of(spark, "<body></body>")["markdown"] is None
    assert text_of(spark, None)["markdown"] is None


def test_good_container(spark):
    good = f"<article><p>{LONG}</p><p>{LONG}</p></article>"
    bad = f"<article><p>{LONG}</p></article>"
    df = spark.createDataFrame([(1, good), (2, bad), (3, "<p>none</p>")], "page_id long, html string")
    got = {r["page_id"]: r["is_good"] for r in H.good_container(H.parse_pages(df)).collect()}
    assert got == {1: True, 2: False}


def test_page_type(spark):
    row = text_of(spark, "<p>x</p>", url="https://x.com/home?a=1")
    assert row["page_type"] == "twitter_home"
    assert text_of(spark, "<p>x</p>", url="http://x.com/home")["page_type"] == "generic"


def meta(spark, head):
    return M.page_metadata(H.parse_pages(page(spark, f"<html><head>{head}</head><body><p>b</p></body></html>"))).first()


def test_metadata_precedence(spark):
    m = meta(
        spark,
        "<title> Plain </title><meta property='og:title' content=' Shared '><meta name='description' content='d'>"
        "<meta property='og:author' content=' '><meta name='author' content='Ann'><meta name='keywords' content='a, ,b'>"
        "<meta property='og:image' content='/i.png'><link rel='apple-touch-icon' href='/t'><link rel='shortcut icon' href='/f'>"
        "<meta property='article:published_time' content='soon'><meta name='date' content='2024-03-04T05:06:07Z'>",
    )
    assert (m["title"], m["description"], m["author"], m["keywords"]) == ("Shared", "d", "Ann", ["a", "b"])
    assert (m["og_image"], m["favicon"], m["published_at"]) == ("/i.png", "/f", dt.datetime(2024, 3, 4, 5, 6, 7))


def test_metadata_fallbacks(spark):
    assert meta(spark, "<title>T &amp; U</title>")["title"] == "T & U"
    assert meta(spark, "<span itemprop='author'><b itemprop='name'>In Ner</b></span>")["author"] == "In Ner"
    assert meta(spark, "<p class='x byline'>By Some One</p>")["author"] == "Some One"
    assert meta(spark, "<meta name='twitter:creator' content='@h'>")["author"] == "h"
    assert meta(spark, "<meta property='article:tag' content='a'><meta property='article:tag' content='b'>")["keywords"] == ["a", "b"]
    ld = meta(spark, "<script type='application/ld+json'>[{\"author\":{\"name\":\"L\"},\"keywords\":[\"k\"],\"datePublished\":\"2024-01-02\"}]</script>")
    assert (ld["author"], ld["keywords"], ld["published_at"]) == ("L", ["k"], dt.datetime(2024, 1, 2))
    assert meta(spark, "<script type='application/ld+json'>{bad</script>")["author"] is None
    assert meta(spark, "<time datetime='2024-05-06'>x</time>")["published_at"] == dt.datetime(2024, 5, 6)


def test_doc_from_page(spark):
    df = M.page_metadata(H.parse_pages(page(spark, "<title></title><link rel=icon href=/f>").withColumn("tab_title", F.lit("Tab")))).drop("tokens")
    row = M.doc_from_page(df).first()
    assert (row["title"], row["metadata"], row["source"]) == ("Tab", {"favicon": "/f"}, "chrome")


def test_sums_against_loops(spark):
    """Counts, paragraph sums and places of all elements, with holes where tokens were dropped."""
    rng = random.Random(5)

    def some(depth):
        parts = []
        for _ in range(rng.randint(0, 4)):
            tag = rng.choice(["div", "p", "h2", "span", "ul", "script", "br"])
            parts.append(f"text {rng.randrange(99)} " if depth > 5 or rng.random() < 0.4 else f"<{tag}>{some(depth + 1)}</{tag}>")
        return "".join(parts)

    rows = [(i, f"<body>{some(0)}<div>{some(0)}</div></body>") for i in range(40)] + [(100, ""), (101, None)]
    df = H.strip_nodes(H.parse_pages(spark.createDataFrame(rows, "page_id long, html string").repartition(3)))
    for r in H.with_starts(df).collect():
        tokens = r["tokens"] or []
        starts = [(i, t) for i, t in enumerate(tokens) if t["kind"] == "start"]
        assert [t["pos"] for _, t in starts] == [t["pos"] for t in r["starts"] or []]
        length = lambda some: sum(len(t["text"].strip()) for t in some if t["text"])
        for (i, t), got in zip(starts, r["starts"] or []):
            inner = [x for x in tokens if t["pos"] < x["pos"] < t["end_pos"]]
            whole = [x for x in tokens if t["pos"] <= x["pos"] <= t["end_pos"]]
            paras = [x for x in whole if x["kind"] == "start" and x["tag"] == "p"]
            s = got["s"]
            assert (s["n_elements"], s["n_p"], s["n_h"]) == tuple(sum(x["kind"] == "start" and x["tag"] in tags for x in inner) for tags in (("div", "p", "h2", "span", "ul", "script", "br", "body"), ("p",), ("h2",)))
            assert s["text_len"] == length(inner) and (s["from"], s["size"]) == (i + 1, len(whole))
            assert s["paras"] == len(paras) and s["para_len"] == sum(length([x for x in tokens if p["pos"] <= x["pos"] <= p["end_pos"]]) for p in paras)


def test_time_grows_with_the_page(spark):
    """16 times the tokens take well under 16 x 16 times the time."""
    import time

    def seconds(n):
        html = "<body>" + "".join(f"<div><p>sentence {i} of this page</p><ul><li>item</li></ul></div>" for i in range(n)) + "</body>"
        df = spark.createDataFrame([(i, html) for i in range(4)], "page_id long, html string").coalesce(1)
        run = lambda: H.content_fallbacks(H.main_content(H.parse_pages(df)).withColumn("markdown", F.lit(""))).agg(F.sum(F.length("markdown"))).collect()
        run()
        start = time.perf_counter()
        run()
        return time.perf_counter() - start

    small, large = seconds(60), seconds(960)
    assert large < 40 * max(small, 0.1)
