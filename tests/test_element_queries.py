"""The registered element queries give every element and text of every page."""

import html as entities
import re
from collections import Counter

import pytest

from conftest import SF
from pagevault.plans import all_queries


def brute(html):
    """(tag, text) of all elements and texts in page order, by one regular expression."""
    out = []
    for comment, raw, inner, tag, text in re.findall(r"(<!.*?>)|<(script|style)\b[^>]*>(.*?)</(?:script|style)>|<(/?[a-zA-Z][a-zA-Z0-9]*)[^>]*>|([^<]+)", html, re.S):
        if raw:
            out += [(raw, None)] + [("#text", inner)] * bool(inner)
        elif tag and not tag.startswith("/"):
            out.append((tag, None))
        elif text:
            out.append(("#text", entities.unescape(text)))
    return out


@pytest.fixture(scope="module")
def want(spark):
    return {r.page_id: brute(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def found(spark, name, sf=SF):
    pages = {}
    for r in all_queries()[name](spark, sf).orderBy("page_id", "pos").collect():
        pages.setdefault(r.page_id, []).append((r.tag, r.text))
    return pages


def test_elements_and_texts(spark, want):
    assert found(spark, "html_elements") == want


def test_stripped_elements_and_texts(spark, want):
    kept = {}
    for page, rows in want.items():
        raw = [i for i, r in enumerate(rows) if r[0] in ("script", "style")]
        gone = {*raw, *(i + 1 for i in raw if rows[i + 1][0] == "#text")}
        kept[page] = [r for i, r in enumerate(rows) if i not in gone]
    assert found(spark, "strip_nodes") == kept


def test_histogram_counts_all(spark, want):
    got = {r.tag: r.n_elements for r in all_queries()["element_histogram"](spark, SF).collect()}
    assert got == Counter(tag for rows in want.values() for tag, _ in rows)


def test_depth_and_places(spark, tmp_path):
    html = "<div><p>a<b>c</b></p><script>x</script><br>d</div>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = lambda name: [tuple(r)[1:] for r in all_queries()[name](spark, str(tmp_path)).orderBy("pos").collect()]
    every = [
        (0, 12, "div", 1, None), (1, 6, "p", 2, None), (2, 2, "#text", 3, "a"), (3, 5, "b", 3, None), (4, 4, "#text", 4, "c"),
        (7, 9, "script", 2, None), (8, 8, "#text", 3, "x"), (10, 10, "br", 2, None), (11, 11, "#text", 2, "d"),
    ]
    assert rows("html_elements") == every
    assert rows("strip_nodes") == [r for r in every if r[0] not in (7, 8)]


def test_banner_texts_are_stripped(spark, tmp_path):
    banners = ["🥦 Reading 3 pages", "x 🥦\u00a0READING, y ... z", "&#129382;reading all...", "🥦 reading some PaGeS"]
    others = ["🥦 Reading", "Reading 3 pages", "🥦 Reading\n3 pages", "🥦 x reading pages", "no"]
    html = "".join(f"<p>{t}</p>" for t in [*banners[:2], *others, *banners[2:]]) + "<p>🥦 Reading <b>3 pages</b></p><div>a<!-- 🥦 Reading ... -->b</div>"
    spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    texts = [t for tag, t in found(spark, "strip_nodes", str(tmp_path))[1] if tag == "#text"]
    assert texts == [*others, "🥦 Reading ", "3 pages", "a", "b"]
    assert [t for t, _ in found(spark, "strip_nodes", str(tmp_path))[1]].count("p") == 10
    markdown = all_queries()["page_text"](spark, str(tmp_path)).first().markdown
    assert "🥦 x reading pages" in markdown and not any(t in markdown for t in ("READING, y", "some PaGeS"))


def test_posts_are_made_in_one_pass(spark):
    df = all_queries()["segment_by_image"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("Window [sum") == 1
