"""Registered queries: HTML jobs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagevault.functions import base_url
from pagevault.operators import docs as D
from pagevault.operators import html as H
from pagevault.operators import metadata as M
from pagevault.operators import noise as N
from pagevault.plans import inputs as I

QUERIES, ORACLE = {}, {}


def _q(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _pages(spark, d):
    return I.heavy(spark, d, "pages")


def _clean(spark, d):
    return H.clean_tokens(_pages(spark, d))


_TAGS_SQL = """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS n, tag FROM (
  SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS i FROM (SELECT page_id, regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)[^>]*>', 1) AS t FROM pages)) WHERE %s"""


def _in_order(elements):
    """The elements of each page, numbered in page order."""
    n = F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    return elements.filter("tag not like '#%'").select("page_id", n.cast("long").alias("n"), "tag")


def _stripped(spark, d):
    return H.element_rows(H.strip_nodes(H.parse_pages(_pages(spark, d).select("page_id", "html"))))


@_q("html_elements")
def _(spark, d):
    return H.html_elements(_pages(spark, d)).select("page_id", "pos", "end_pos", "tag", "depth", "text")


@_q("strip_nodes")
def _(spark, d):
    return _stripped(spark, d).select("page_id", "pos", "end_pos", "tag", "depth", "text")


@_q("html_elements_tags", _TAGS_SQL % "true")
def _(spark, d):
    return _in_order(H.html_elements(_pages(spark, d)))


@_q("strip_nodes_tags", _TAGS_SQL % "tag NOT IN ('script', 'style')")
def _(spark, d):
    return _in_order(_stripped(spark, d))


_LINKS_SQL = """links AS (SELECT page_id, url, unnest(l) AS href, unnest(range(len(l))) AS n FROM (SELECT page_id, url, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS l FROM pages)),
  b AS (SELECT *, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base FROM links)"""


@_q("absolutize_links", f"""WITH {_LINKS_SQL} SELECT page_id, n::BIGINT AS n, CASE WHEN regexp_matches(href, '^(https?://|mailto:|tel:|#|javascript:)') THEN href
  WHEN href LIKE '/%' OR href LIKE '?%' THEN base || href WHEN href = '' THEN base ELSE base || '/' || regexp_replace(href, '^(\\.{{1,2}}/)+', '') END AS href FROM b""")
def _(spark, d):
    parsed = H.absolutize_links(H.parse_pages(_pages(spark, d)), base_url(F.col("url")))
    links = F.filter("tokens", lambda t: (t["kind"] == "start") & (t["tag"] == "a"))
    rows = parsed.select("page_id", F.posexplode(links).alias("n", "t"))
    return rows.select("page_id", F.col("n").cast("long").alias("n"), F.element_at("t.attrs", "href").alias("href"))


# the article of a page by string operations: tokens before it, and what lies in it. Ends that the page leaves out (of b, and of the p around it) are tokens too.
_ARTICLE_SQL = """parts AS (
  SELECT page_id, split_part(html, '<article>', 1) AS pre, split_part(split_part(html, '<article>', 2), '</article>', 1) AS inside FROM pages WHERE contains(html, '<article>')),
  tokens AS (
  SELECT page_id, len(regexp_extract_all(regexp_replace(replace(pre, '"</p>"', ''), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<[^>]*>|[^<]+'))::INTEGER AS pos,
    regexp_extract_all(inside, '<[^>]*>|[^<]+') AS t FROM parts),
  counted AS (
  SELECT page_id, pos, len(t) AS n_tokens, len(list_filter(t, lambda x: regexp_matches(x, '^<[a-zA-Z]')))::INTEGER AS n_elements,
    len(list_filter(t, lambda x: regexp_matches(x, '^<p[ >]')))::INTEGER AS n_p, len(list_filter(t, lambda x: regexp_matches(x, '^<h[1-6][ >]')))::INTEGER AS n_h,
    len(list_filter(t, lambda x: x = '</p>')) AS n_end_p, len(list_filter(t, lambda x: x = '<b>')) AS n_b,
    COALESCE(list_sum(list_transform(list_filter(t, lambda x: x[1] <> '<'), lambda x: length(regexp_replace(
      replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')))), 0)::INTEGER AS text_len FROM tokens),
  scored AS (
  SELECT *, (pos + 1 + n_tokens + (n_p - n_end_p) + n_b)::INTEGER AS end_pos, text_len + n_elements * 5 + n_p * 10 + n_h * 20 AS score FROM counted
  WHERE text_len >= 50 AND n_elements >= 3)"""


@_q("container_score", f"WITH {_ARTICLE_SQL} SELECT page_id, 'article' AS selector, n_elements, n_p, n_h, text_len, score FROM scored")
def _(spark, d):
    return H.container_score(_clean(spark, d)).select("page_id", "selector", "n_elements", "n_p", "n_h", "text_len", "score")


@_q("best_container", f"WITH {_ARTICLE_SQL} SELECT page_id, 'article' AS selector, pos, end_pos, score FROM scored")
def _(spark, d):
    return H.best_container(H.container_score(_clean(spark, d)))


@_q("para_fallback", f"""WITH {_ARTICLE_SQL}, h AS (SELECT page_id, regexp_extract(inside, '<h1>([^<]*)</h1>', 1) AS h FROM parts),
  n AS (SELECT page_id, length(regexp_replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '^\\s+|\\s+$', '', 'g')) AS n FROM h)
SELECT c.page_id, c.pos, (c.pos + 1 + c.n_tokens + (c.n_p - c.n_end_p) + c.n_b)::INTEGER AS end_pos FROM counted c JOIN n ON c.page_id = n.page_id
WHERE c.n_p > 2 AND c.text_len - n.n > 200""")
def _(spark, d):
    # the pages' paragraphs sit in an article: look at them as if it were a plain div
    pages = _pages(spark, d)
    as_div = F.replace(F.replace("html", F.lit("<article>"), F.lit("<div>")), F.lit("</article>"), F.lit("</div>"))
    return H.para_fallback(H.clean_tokens(pages.withColumn("html", as_div)))


@_q("main_content", f"""WITH {_ARTICLE_SQL}, plain AS (SELECT page_id, regexp_replace(replace(html, '"</p>"', ''), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g') AS h FROM pages),
  rest AS (SELECT page_id, len(regexp_extract_all(split_part(h, '<body>', 1), '<[^>]*>|[^<]+'))::INTEGER AS pos,
    regexp_extract_all(split_part(split_part(h, '<body>', 2), '</body>', 1), '<[^>]*>|[^<]+') AS t FROM plain WHERE page_id NOT IN (SELECT page_id FROM scored))
SELECT page_id, pos, end_pos FROM scored UNION ALL
SELECT page_id, pos, (pos + 1 + len(t) + len(list_filter(t, lambda x: regexp_matches(x, '^<p[ >]'))) - len(list_filter(t, lambda x: x = '</p>')) + len(list_filter(t, lambda x: x = '<b>')))::INTEGER FROM rest""")
def _(spark, d):
    rows = H.main_content(_clean(spark, d))
    return rows.select("page_id", F.col("main.pos").alias("pos"), F.col("main.end_pos").alias("end_pos"))


@_q("good_container", f"WITH {_ARTICLE_SQL} SELECT page_id, n_elements > 1 AND text_len >= 100 AND n_p >= 2 AS is_good FROM counted")
def _(spark, d):
    return H.good_container(_clean(spark, d))


@_q("to_markdown")
def _(spark, d):
    return H.to_markdown(H.main_content(_clean(spark, d))).select("page_id", "markdown")


@_q("content_fallbacks")
def _(spark, d):
    # as if nothing had been found yet, so that every page falls back
    rows = H.main_content(_clean(spark, d)).withColumn("markdown", F.lit(""))
    return H.content_fallbacks(rows).select("page_id", "markdown")


@_q("page_text")
def _(spark, d):
    return H.page_text(_pages(spark, d)).select("page_id", "url", "page_type", "markdown", "error")


@_q("element_histogram", """WITH t AS (SELECT unnest(regexp_extract_all(regexp_replace(replace(html, '"</p>"', ''), '<!--.*?-->|<!DOCTYPE[^>]*>', '', 'g'), '<[^>]*>|[^<]+')) AS x FROM pages)
SELECT CASE WHEN x[1] = '<' THEN lower(regexp_extract(x, '^<([a-zA-Z][a-zA-Z0-9]*)', 1)) ELSE '#text' END AS tag, count(*) AS n_elements FROM t WHERE NOT starts_with(x, '</') GROUP BY 1""")
def _(spark, d):
    return D.element_histogram(H.html_elements(_pages(spark, d)))


@_q("element_histogram_tags", """WITH t AS (SELECT unnest(['article', 'nav', 'footer', 'script', 'style', 'title']) AS tag)
SELECT tag, (SELECT sum(len(regexp_extract_all(html, '<' || t.tag || '[ >]'))) FROM pages)::BIGINT AS n_elements FROM t""")
def _(spark, d):
    rows = H.html_elements(_pages(spark, d))
    return D.element_histogram(rows.filter(F.col("tag").isin("article", "nav", "footer", "script", "style", "title")))


@_q("node_noise_filter")
def _(spark, d):
    rows = H.html_elements(_pages(spark, d).select("page_id", F.replace("html", F.lit('class="ad"'), F.lit('class="ad-banner"')).alias("html")))
    return N.node_noise_filter(rows, ["cookie notice", "/the"]).select("page_id", "pos", "tag", "text")


_TITLE_SQL = r"""replace(replace(replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"""


@_q("page_title", f"SELECT page_id, {_TITLE_SQL} AS title FROM pages")
def _(spark, d):
    return H.parse_pages(_pages(spark, d)).select("page_id", M.title_of(F.col("tokens")).alias("title"))


_META_SQL = f"""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Shared ' || page_id ELSE {_TITLE_SQL} END AS title,
  CASE WHEN page_id % 4 = 1 THEN 'Shared words ' || page_id WHEN page_id % 2 = 0 THEN 'Plain words ' || page_id END AS description,
  CASE page_id % 5 WHEN 0 THEN 'Og Author ' || page_id WHEN 1 THEN 'Meta Author ' || page_id WHEN 2 THEN 'tw' || page_id WHEN 3 THEN 'Ld Author ' || page_id END AS author,
  CASE WHEN page_id % 6 = 0 THEN 'k1|k' || page_id WHEN page_id % 6 = 1 THEN 't1|t' || page_id WHEN page_id % 5 = 3 THEN 'a|b ' || page_id ELSE 'none' END AS keywords,
  CASE WHEN page_id % 7 = 0 THEN '2024-01-0' || (page_id % 9 + 1) || ' 10:00' WHEN page_id % 7 = 1 THEN '2023-05-06 00:00' WHEN page_id % 5 = 3 THEN '2024-02-0' || (page_id % 9 + 1) || ' 00:00' END AS published,
  CASE WHEN page_id % 3 = 1 THEN '/img/' || page_id || '.png' END AS og_image, CASE WHEN page_id % 3 = 2 THEN '/icon' || page_id || '.ico' END AS favicon FROM pages"""


@_q("page_metadata", _META_SQL)
def _(spark, d):
    rows = M.page_metadata(H.parse_pages(I.meta_pages(spark, d)))
    return rows.select(
        "page_id", "title", "description", "author", F.coalesce(F.array_join("keywords", "|"), F.lit("none")).alias("keywords"),
        F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published"), "og_image", "favicon",
    )


@_q("meta_pick", f"""SELECT page_id, 'title' AS field, CASE WHEN page_id % 3 = 0 THEN 'Shared ' || page_id ELSE {_TITLE_SQL} END AS value FROM pages
UNION ALL SELECT page_id, 'description', CASE WHEN page_id % 4 = 1 THEN 'Shared words ' || page_id ELSE 'Plain words ' || page_id END FROM pages WHERE page_id % 4 = 1 OR page_id % 2 = 0
UNION ALL SELECT page_id, 'og_image', '/img/' || page_id || '.png' FROM pages WHERE page_id % 3 = 1""")
def _(spark, d):
    return M.meta_pick(M.meta_rows(H.parse_pages(I.meta_pages(spark, d))))


@_q("doc_from_page", f"""WITH m AS ({_META_SQL}) SELECT m.page_id, p.url, m.title, m.author AS contact_name, 'chrome' AS source, m.published AS created,
  CASE WHEN og_image IS NOT NULL THEN 'og_image=' || og_image WHEN favicon IS NOT NULL THEN 'favicon=' || favicon ELSE '' END AS metadata FROM m JOIN pages p ON m.page_id = p.page_id""")
def _(spark, d):
    docs = M.doc_from_page(M.page_metadata(H.parse_pages(I.meta_pages(spark, d).withColumn("tab_title", F.lit("tab")))).drop("tokens"))
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return docs.select(
        "page_id", "url", "title", "contact_name", "source", F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("created"),
        F.array_join(pairs, "|").alias("metadata"),
    )
