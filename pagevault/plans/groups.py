"""Registered queries: joins, aggregates, set operations, ordered work."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault import functions as fn
from pagevault.functions import fixed
from pagevault.operators import chunks as C
from pagevault.operators import docs as D
from pagevault.operators import elements as E
from pagevault.operators import search as S
from pagevault.operators import tabs as T
from pagevault.operators import versions as V
from pagevault.plans import inputs as I

QUERIES, ORACLE = {}, {}


def _q(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


# --- joins --------------------------------------------------------------------------------------------------


@_q("chunk_doc_join", f"WITH {I.DOCS_SQL}, {I.LINE_CHUNKS_SQL} SELECT c.doc_id, chunk_index, title, source FROM line_chunks c JOIN docs d ON c.doc_id = d.doc_id")
def _(spark, d):
    docs = I.docs(spark, d).select("doc_id", "title", "source")
    return D.chunk_doc_join(I.line_chunks(spark, d), docs).select("doc_id", "chunk_index", "title", "source")


@_q("match_existing", f"""WITH {I.DOCS_SQL}, stored AS (SELECT * FROM docs WHERE doc_id % 4 <> 3),
  newest AS (SELECT url, id FROM (SELECT url, id, row_number() OVER (PARTITION BY url ORDER BY ingested_at DESC, id DESC) AS rn FROM stored) WHERE rn = 1)
SELECT i.id, coalesce(s.id, n.id) AS match_id, CASE WHEN s.id IS NOT NULL THEN 'id' WHEN n.id IS NOT NULL THEN 'url' END AS match_by
FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'new' || id ELSE id END AS id, url FROM docs) i LEFT JOIN stored s ON i.id = s.id LEFT JOIN newest n ON i.url = n.url""")
def _(spark, d):
    docs = I.docs(spark, d).select("doc_id", "id", "url", "ingested_at")
    stored = docs.filter("doc_id % 4 <> 3").drop("doc_id")
    incoming = docs.select(F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("new"), F.col("id"))).otherwise(F.col("id")).alias("id"), "url")
    return D.match_existing(incoming, stored).select("id", "match_id", "match_by")


@_q("seen_urls_anti", "SELECT page_id, url FROM pages WHERE page_id % 4 <> 0")
def _(spark, d):
    pages = I.table(spark, d, "pages").select("page_id", "url")
    return D.seen_urls_anti(pages, pages.filter("page_id % 4 = 0")).select("page_id", "url")


_TWO_POLLS_SQL = I.POLLS_SQL + """, prev AS (SELECT tab_id, poll + 1 AS poll, url FROM polls WHERE poll < (SELECT max(poll) FROM polls)), cur AS (SELECT tab_id, poll, url FROM polls)"""


def _two_polls(spark, d):
    """Each poll, and beside it (under its number) the poll before it."""
    polls = I.polls(spark, d)
    last = polls.agg(F.max("poll").alias("_last"))
    before = polls.join(F.broadcast(last), F.col("poll") < F.col("_last"))  # one row
    return before.select("tab_id", (F.col("poll") + 1).alias("poll"), "url"), polls.select("tab_id", "poll", "url")


_TAB = ["poll", "tab_id"]


@_q("snapshot_diff", f"""WITH {_TWO_POLLS_SQL} SELECT coalesce(c.tab_id, p.tab_id) AS tab_id, coalesce(c.poll, p.poll) AS poll,
  CASE WHEN p.tab_id IS NULL THEN 'new' WHEN c.tab_id IS NULL THEN 'closed' WHEN c.url <> p.url THEN 'navigated' ELSE 'kept' END AS change_type,
  c.url, p.url AS old_url FROM cur c FULL OUTER JOIN prev p ON c.tab_id = p.tab_id AND c.poll = p.poll""")
def _(spark, d):
    return T.snapshot_diff(*_two_polls(spark, d), _TAB)


_CHANGES_SQL = I.POLLS_SQL + """, m AS (SELECT max(poll) AS last FROM polls),
  j AS (SELECT coalesce(c.tab_id, p.tab_id) AS tab_id, coalesce(c.poll, p.poll + 1) AS poll,
    CASE WHEN p.tab_id IS NULL THEN 'new' WHEN c.tab_id IS NULL THEN 'closed' WHEN c.url <> p.url THEN 'navigated' ELSE 'kept' END AS change_type,
    c.url AS url, p.url AS old_url
  FROM polls c FULL OUTER JOIN polls p ON c.tab_id = p.tab_id AND c.poll = p.poll + 1),
  changes AS (SELECT * FROM j WHERE poll <= (SELECT last FROM m))"""


@_q("poll_changes", f"WITH {_CHANGES_SQL} SELECT tab_id, poll, change_type, url, old_url FROM changes")
def _(spark, d):
    return T.poll_changes(I.polls(spark, d))


@_q("chunks_equal", f"""WITH {I.LINE_CHUNKS_SQL} SELECT doc_id, NOT (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND chunk_total > 1)) AS chunks_equal FROM line_chunks GROUP BY doc_id, chunk_total""")
def _(spark, d):
    stored = I.line_chunks(spark, d)
    n, i = F.col("doc_id"), F.col("chunk_index")
    new = stored.filter((n % 3 != 1) | (i == 0)).withColumn(
        "content", F.when((n % 3 == 0) & (i == 0), F.array(fn.jsoncols.item("text", F.lit("other")))).otherwise(F.col("content"))
    )
    return D.chunks_equal(stored, new)


def _route_sql(url):
    from pagevault.plans.columns import _sql_str

    parts = " ".join(f"WHEN regexp_matches({url}, {_sql_str('^(?:' + p + ')')}) THEN '{n}'" for p, n in fixed.PAGE_TYPE_RULES)
    return f"CASE {parts} ELSE 'generic' END"


_SITES = [
    "https://www.instagram.com/explore/search/x", "https://www.instagram.com/someone/", "https://bsky.app/profile/a/follows?x=1",
    "https://www.linkedin.com/company/acme/posts/?p=2", "https://x.com/home", "https://twitter.com/a/status/123", "https://www.youtube.com/",
    "https://mail.google.com/mail/u/0/#inbox?compose=1", "https://www.threads.net/activity",
]


@_q("route_pages", f"""WITH u AS (SELECT page_id, coalesce((['{"', '".join(_SITES)}'])[(page_id % 12 + 1)::INT], url) AS url FROM pages) SELECT page_id, url, {_route_sql('url')} AS page_type FROM u""")
def _(spark, d):
    site = F.try_element_at(F.array(*[F.lit(s) for s in _SITES]), (F.col("page_id") % 12 + 1).cast("int"))
    pages = I.table(spark, d, "pages").select("page_id", F.coalesce(site, F.col("url")).alias("url"))
    return T.route_pages(pages)


@_q("route_pages_rules", """SELECT page_id, url, CASE WHEN regexp_matches(url, '^http://') THEN 'plain' WHEN regexp_matches(url, '^https://m\\.') THEN 'mobile' ELSE 'generic' END AS page_type FROM pages""")
def _(spark, d):
    # the rules come as a table: one of each nation, of which the first two match
    n = F.col("n_nationkey")
    rules = I.table(spark, d, "nation").select(
        n.alias("prio"),
        F.when(n == 0, F.lit("http://")).when(n == 1, F.lit(r"https://m\.")).otherwise(F.concat(F.lit("https?://never"), F.lower("n_name"))).alias("pattern"),
        F.when(n == 0, F.lit("plain")).when(n == 1, F.lit("mobile")).otherwise(F.lit("late")).alias("page_type"),
    )
    return T.route_pages(I.table(spark, d, "pages").select("page_id", "url"), rules)


# --- set operations -----------------------------------------------------------------------------------------


@_q("tabs_added", f"WITH {_TWO_POLLS_SQL} SELECT tab_id, poll, url FROM cur ANTI JOIN prev USING (tab_id, poll)")
def _(spark, d):
    return T.tabs_added(*_two_polls(spark, d), _TAB)


@_q("tabs_removed", f"WITH {_TWO_POLLS_SQL} SELECT tab_id, poll, url FROM prev ANTI JOIN cur USING (tab_id, poll)")
def _(spark, d):
    return T.tabs_removed(*_two_polls(spark, d), _TAB)


@_q("tabs_common", f"WITH {_TWO_POLLS_SQL} SELECT tab_id, poll, url FROM cur SEMI JOIN prev USING (tab_id, poll)")
def _(spark, d):
    return T.tabs_common(*_two_polls(spark, d), _TAB)


@_q("fetch_list", f"WITH {_CHANGES_SQL} SELECT tab_id, poll, url FROM changes WHERE change_type IN ('new', 'navigated')")
def _(spark, d):
    return T.fetch_list(T.poll_changes(I.polls(spark, d))).select("tab_id", "poll", "url")


@_q("items_concat", f"""WITH {I.LINE_CHUNKS_SQL} SELECT doc_id, chunk_index, CASE WHEN chunk_index % 2 = 0 THEN 'head ' || doc_id ELSE 'head ' || doc_id || '|' || item_value END AS items FROM line_chunks""")
def _(spark, d):
    rows = I.line_chunks(spark, d)
    bad = F.array(fn.jsoncols.item("video", F.lit(None).cast("string")))
    content = F.when(F.col("chunk_index") % 2 == 0, bad).otherwise(F.col("content"))
    items = fn.items_concat(F.concat(F.lit("head "), F.col("doc_id").cast("string")), content)
    return rows.select("doc_id", "chunk_index", F.array_join(F.transform(items, lambda x: F.coalesce(x["text"], x["image_url"])), "|").alias("items"))


# --- aggregates ---------------------------------------------------------------------------------------------


@_q("table_counts", f"WITH {I.LINE_CHUNKS_SQL} SELECT 'docs' AS table_name, count(*) AS n_rows FROM documents UNION ALL SELECT 'chunks', count(*) FROM line_chunks UNION ALL SELECT 'search_rows', count(*) FROM embeddings")
def _(spark, d):
    return D.table_counts(I.table(spark, d, "documents"), I.line_chunks(spark, d), I.table(spark, d, "embeddings"))


@_q("distinct_urls", f"WITH {I.DOCS_SQL} SELECT DISTINCT url FROM docs WHERE source = 'src2'")
def _(spark, d):
    return D.distinct_urls(I.docs(spark, d), "src2")


@_q("chunk_totals", f"WITH {I.LINES_SQL} SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM lines")
def _(spark, d):
    return C.chunk_totals(I.lines(spark, d).select("doc_id", "pos"), "doc_id")


@_q("reconstruct_text", f"""WITH {I.LINE_CHUNKS_SQL} SELECT doc_id, string_agg(item_value, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM line_chunks WHERE item_type = 'text' AND item_value <> '' GROUP BY doc_id""")
def _(spark, d):
    return C.reconstruct_text(I.line_chunks(spark, d))


_RATIO_SQL = I.VERSIONS_SQL + ", " + I.BLOCKS_SQL + """, cnt AS (SELECT doc_id, ver, b, count(*) AS n FROM vblocks GROUP BY ALL),
  n_new AS (SELECT v.doc_id, v.ver, coalesce(sum(c.n), 0) AS n FROM versions v LEFT JOIN cnt c ON v.doc_id = c.doc_id AND v.ver = c.ver GROUP BY ALL),
  common AS (SELECT a.doc_id, a.ver, sum(least(a.n, p.n)) AS n FROM cnt a JOIN cnt p ON a.doc_id = p.doc_id AND p.ver = a.ver - 1 AND a.b = p.b GROUP BY ALL),
  bag AS (SELECT n.doc_id, n.ver, coalesce(c.n, 0)::BIGINT AS n_common, n.n::BIGINT AS n_new, CASE WHEN n.n > 0 THEN coalesce(c.n, 0) / n.n::DOUBLE ELSE 0.0::DOUBLE END AS bag_overlap
    FROM n_new n LEFT JOIN common c ON n.doc_id = c.doc_id AND n.ver = c.ver WHERE n.ver > 0)"""


@_q("bag_overlap", f"WITH {_RATIO_SQL} SELECT doc_id, ver, n_common, n_new, round(bag_overlap, 9) AS bag_overlap FROM bag")
def _(spark, d):
    out = V.bag_overlap(I.versions(spark, d), "doc_id", ["ver"], "text", I.SEP)
    return out.select("doc_id", "ver", "n_common", "n_new", F.round("bag_overlap", 9).alias("bag_overlap"))


# versions 0-4 are built so that the bag bound and the match ratio decide alike (FIXTURES.md); the chain itself uses the ratio
_CHAIN_SQL = _RATIO_SQL + """, chained AS (SELECT v.doc_id, v.ver, sum(CASE WHEN b.bag_overlap >= 0.3 THEN 0 ELSE 1 END) OVER (PARTITION BY v.doc_id ORDER BY v.ver) - 1 AS chain,
  coalesce(b.bag_overlap >= 0.3, false) AS same_doc, v.text FROM versions v LEFT JOIN bag b ON v.doc_id = b.doc_id AND v.ver = b.ver)"""


@_q("version_chain", f"WITH {_CHAIN_SQL} SELECT doc_id, ver, chain::BIGINT AS chain, same_doc FROM chained")
def _(spark, d):
    return V.version_chain(I.versions(spark, d), "doc_id", ["ver"], "text", I.SEP).select("doc_id", "ver", "chain", "same_doc")


@_q("merge_state", f"""WITH {_CHAIN_SQL} SELECT doc_id, ver, CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'KEPT_EMPTY' WHEN same_doc THEN 'MERGED' ELSE 'KEPT_NEW' END AS merge_type,
  CASE WHEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN CASE WHEN text = '' THEN '' END WHEN same_doc THEN array_to_string(list_filter(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\n+'), lambda x: regexp_matches(x, '\\S')), chr(10) || chr(10)) ELSE text END AS content FROM chained""")
def _(spark, d):
    return V.merge_state(I.versions(spark, d), "doc_id", ["ver"], "text", I.SEP).select("doc_id", "ver", "merge_type", "content")


@_q("match_ratio", """WITH n AS (SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n FROM documents)
SELECT doc_id, 'turned' AS kind, greatest(n // 2, n - n // 2) / n::DOUBLE AS match_ratio FROM n
UNION ALL SELECT doc_id, 'reversed', 1 / n::DOUBLE FROM n UNION ALL SELECT doc_id, 'moved on', (n - 1) / n::DOUBLE FROM n""")
def _(spark, d):
    """Numbered lines against their second half before their first (all blocks are there, about half of them match), in reverse,
    and without the first but with a new last one."""
    numbered = F.transform(F.split("text", "\n"), lambda x, i: F.concat(i.cast("string"), F.lit(":"), x))
    rows = I.table(spark, d, "documents").select("doc_id", numbered.alias("l")).withColumn("h", (F.size("l") / 2).cast("int"))
    n = F.size("l")
    turned = F.concat(F.slice("l", F.col("h") + 1, n), F.slice("l", F.lit(1), F.col("h")))
    moved = F.concat(F.slice("l", F.lit(2), n), F.array(F.lit("new")))
    cases = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("v")) for k, v in (("turned", turned), ("reversed", F.reverse("l")), ("moved on", moved))))
    text = lambda c: V.block_hashes(F.array_join(c, "\n"), I.SEP)
    pairs = rows.select("doc_id", text(F.col("l")).alias("old"), F.explode(cases).alias("c")).select("doc_id", "old", "c.kind", text(F.col("c.v")).alias("new"))
    return V.match_ratio(pairs, "old", "new").select("doc_id", "kind", "match_ratio")


@_q("change_counts", f"""WITH {_CHANGES_SQL} SELECT poll, count(*) FILTER (change_type = 'new') AS n_new, count(*) FILTER (change_type = 'closed') AS n_closed,
  count(*) FILTER (change_type = 'navigated') AS n_navigated, count(*) FILTER (change_type = 'kept') AS n_kept FROM changes GROUP BY poll""")
def _(spark, d):
    return T.change_counts(T.poll_changes(I.polls(spark, d)))


@_q("post_hashtags", """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '#a|#' || lang || '|#' || source ELSE '' END AS hashtags FROM documents""")
def _(spark, d):
    text = F.when(
        F.col("doc_id") % 2 == 0,
        F.concat(F.lit("#"), F.col("source"), F.lit(" #"), F.col("lang"), F.lit(" #a #"), F.col("source")),
    ).otherwise(F.lit("none"))
    rows = E.post_hashtags(I.table(spark, d, "documents").withColumn("post", text), "doc_id", "post")
    return rows.select("doc_id", F.array_join("hashtags", "|").alias("hashtags"))


@_q("embed_batches", """SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch_id FROM documents""")
def _(spark, d):
    return S.embed_batches(I.table(spark, d, "documents").select("doc_id"), 100, ["doc_id"]).select("doc_id", "batch_id")


@_q("embed_batches_by_kind", """SELECT doc_id, (row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) - 1) // 100 AS batch_id FROM documents""")
def _(spark, d):
    rows = I.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("kind"))
    return S.embed_batches(rows, 100, ["doc_id"], "kind").select("doc_id", "batch_id")


# --- ordered work -------------------------------------------------------------------------------------------


@_q("number_chunks", f"WITH {I.LINES_SQL} SELECT doc_id, pos, pos AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total FROM lines")
def _(spark, d):
    return C.number_chunks(I.lines(spark, d).select("doc_id", "pos"), "doc_id", ["pos"])


@_q("latest_doc", """SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def _(spark, d):
    return D.latest_doc(I.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@_q("merge_text_runs", """WITH r AS (SELECT *, sum(CASE WHEN role <> 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id // 2 ORDER BY conv_id, turn) AS g FROM conversations),
  k AS (SELECT conv_id // 2 AS doc, conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t, text, g FROM r)
SELECT doc, min(conv_id * 1000 + turn) AS pos, role, CASE WHEN role = 'assistant' THEN string_agg(t, ' ' ORDER BY conv_id, turn) ELSE min(text) END AS text
FROM k WHERE role <> 'assistant' OR t <> '' GROUP BY doc, g, role""")
def _(spark, d):
    c = I.table(spark, d, "conversations")
    rows = c.select(F.floor(F.col("conv_id") / 2).alias("doc"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"), "role", "text")
    return E.merge_text_runs(rows, "doc", ["pos"], "role", "text", ["assistant"])


@_q("segment_posts", """SELECT * FROM (SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS post_index FROM conversations) WHERE post_index > 0""")
def _(spark, d):
    rows = I.table(spark, d, "conversations")
    return E.segment_posts(rows, "conv_id", ["turn"], F.col("role") == "user").select("conv_id", "turn", "post_index")


_FEED_SQL = I.LINES_SQL + """, feed AS (SELECT doc_id AS doc, pos, CASE pos % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'list_item' ELSE 'text' END AS kind,
  CASE pos % 4 WHEN 0 THEN 'Photo of ' || line WHEN 1 THEN CASE WHEN pos % 8 = 1 THEN '1,2' || pos % 100 || 'K' ELSE '@user' || doc_id END ELSE line || ' #tag' || pos % 3 || ' and more words' END AS text,
  CASE WHEN pos % 4 = 0 THEN 'http://img/' || (pos // 8) END AS image_url FROM lines)"""


def _feed(spark, d):
    p, line, doc = F.col("pos"), F.col("line"), F.col("doc_id").cast("string")
    text = (
        F.when(p % 4 == 0, F.concat(F.lit("Photo of "), line))
        .when(p % 8 == 1, F.concat(F.lit("1,2"), (p % 100).cast("string"), F.lit("K")))
        .when(p % 4 == 1, F.concat(F.lit("@user"), doc))
        .otherwise(F.concat(line, F.lit(" #tag"), (p % 3).cast("string"), F.lit(" and more words")))
    )
    return I.lines(spark, d).select(
        F.col("doc_id").alias("doc"), "pos",
        F.when(p % 4 == 0, F.lit("image")).when(p % 4 == 1, F.lit("list_item")).otherwise(F.lit("text")).alias("kind"),
        text.alias("text"),
        F.when(p % 4 == 0, F.concat(F.lit("http://img/"), F.floor(p / 8).cast("string"))).alias("image_url"),
    )


@_q("segment_by_image", f"""WITH {_FEED_SQL}, f AS (SELECT *, CASE WHEN kind = 'image' AND row_number() OVER (PARTITION BY doc, image_url ORDER BY pos) = 1 THEN 1 ELSE 0 END AS is_new FROM feed),
  s AS (SELECT *, sum(is_new) OVER (PARTITION BY doc ORDER BY pos)::BIGINT AS post_index, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM f),
  b AS (SELECT doc, post_index, t, min(pos) AS pos FROM s WHERE kind <> 'list_item' AND length(t) > 3 GROUP BY ALL)
SELECT p.doc, p.post_index, p.image_url, p.n AS count, p.u AS "user", x.text FROM (
  SELECT doc, post_index, max(CASE WHEN is_new = 1 THEN image_url END) AS image_url, max(CASE WHEN kind = 'list_item' AND pos % 8 = 1 THEN pos END) AS cp,
    arg_max(CASE WHEN kind = 'list_item' AND pos % 8 = 1 THEN t END, CASE WHEN kind = 'list_item' AND pos % 8 = 1 THEN pos END) AS n,
    arg_max(CASE WHEN kind = 'list_item' AND pos % 8 <> 1 THEN t END, CASE WHEN kind = 'list_item' AND pos % 8 <> 1 THEN pos END) AS u FROM s GROUP BY doc, post_index) p
LEFT JOIN (SELECT doc, post_index, string_agg(t, chr(10) ORDER BY pos) AS text FROM b GROUP BY ALL) x ON p.doc = x.doc AND p.post_index = x.post_index""")
def _(spark, d):
    return E.segment_by_image(_feed(spark, d)).select("doc", "post_index", "image_url", "count", "user", "text")


_TITLED_SQL = I.LINES_SQL + """, titled AS (SELECT doc_id AS doc, pos, CASE WHEN pos % 4 = 0 THEN 'title' ELSE 'text' END AS kind,
  CASE WHEN pos % 12 = 4 THEN 'About the people' WHEN pos % 12 = 8 THEN 'Short title' WHEN pos % 12 = 0 THEN 'A title that is much longer than thirty' ELSE line END AS text FROM lines)"""


def _titled(spark, d):
    p = F.col("pos")
    text = (
        F.when(p % 12 == 4, F.lit("About the people")).when(p % 12 == 8, F.lit("Short title"))
        .when(p % 12 == 0, F.lit("A title that is much longer than thirty")).otherwise(F.col("line"))
    )
    return I.lines(spark, d).select(
        F.col("doc_id").alias("doc"), "pos", F.when(p % 4 == 0, F.lit("title")).otherwise(F.lit("text")).alias("kind"), text.alias("text")
    )


@_q("section_by_title", f"""WITH {_TITLED_SQL} SELECT doc, pos, text FROM titled WHERE pos > 4 AND pos < 8""")
def _(spark, d):
    return E.section_by_title(_titled(spark, d), "about").select("doc", "pos", "text")


@_q("title_sections", f"""WITH {_TITLED_SQL} SELECT doc, pos, (sum(CASE WHEN kind = 'title' THEN 1 ELSE 0 END) OVER w)::BIGINT AS section_id,
  last_value(CASE WHEN kind = 'title' THEN text END IGNORE NULLS) OVER w AS section_title FROM titled WINDOW w AS (PARTITION BY doc ORDER BY pos)""")
def _(spark, d):
    return E.title_sections(_titled(spark, d), "doc", ["pos"], "kind", "text").select("doc", "pos", "section_id", "section_title")


@_q("first_seen_dedup", f"WITH {I.LINES_SQL} SELECT doc_id, min(pos) AS pos, line FROM lines GROUP BY doc_id, line")
def _(spark, d):
    return E.first_seen_dedup(I.lines(spark, d), "doc_id", ["pos"], "line")


_PROFILES_SQL = """el AS (SELECT conv_id AS doc, turn AS pos, CASE turn % 7 WHEN 1 THEN '@h' || turn WHEN 4 THEN 'site' || turn || '.com' WHEN 5 THEN 'x' ELSE text END AS text FROM conversations)"""


def _profiles(spark, d):
    t = F.col("turn")
    text = (
        F.when(t % 7 == 1, F.concat(F.lit("@h"), t.cast("string"))).when(t % 7 == 4, F.concat(F.lit("site"), t.cast("string"), F.lit(".com")))
        .when(t % 7 == 5, F.lit("x")).otherwise(F.col("text"))
    )
    return I.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), t.alias("pos"), text.alias("text"))


@_q("name_handle_bio", f"""WITH RECURSIVE {_PROFILES_SQL}, n AS (SELECT doc, pos, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM el),
  s AS (SELECT *, lead(t, 1) OVER w AS h, lead(t, 2) OVER w AS b, lead(t, 3) OVER w AS x FROM n WINDOW w AS (PARTITION BY doc ORDER BY pos)),
  f AS (SELECT *, coalesce(h LIKE '%@%' OR h LIKE '%.com', false) AS pair, coalesce(length(b) > 10 AND b NOT LIKE '@%', false) AND NOT coalesce(x LIKE '%@%', false) AS bio FROM s),
  walk AS (SELECT DISTINCT doc, 0::BIGINT AS i FROM f UNION ALL SELECT w.doc, w.i + CASE WHEN pair AND bio THEN 3 WHEN pair THEN 2 ELSE 1 END FROM walk w JOIN f ON f.doc = w.doc AND f.i = w.i)
SELECT f.doc, f.pos, f.t AS name, CASE WHEN h LIKE '@%' OR h NOT LIKE '%.%' THEN h ELSE '@' || h END AS handle, CASE WHEN bio THEN b END AS bio FROM walk w JOIN f ON f.doc = w.doc AND f.i = w.i WHERE pair""")
def _(spark, d):
    return E.name_handle_bio(_profiles(spark, d))


@_q("nearby_date", f"""WITH {I.LINES_SQL}, t AS (SELECT doc_id AS doc, pos, CASE WHEN pos % 6 = 2 THEN 'Apr ' || (pos % 28 + 1) || ' Apr ' || (pos % 28 + 1) ELSE 'word ' || pos END AS text FROM lines),
  s AS (SELECT doc, pos, text, CASE WHEN text LIKE 'Apr%' THEN string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] END AS day FROM t)
SELECT doc, pos, coalesce(lead(day, 1) OVER w, lead(day, 2) OVER w, lag(day, 2) OVER w, lag(day, 1) OVER w) AS nearby_date FROM s WINDOW w AS (PARTITION BY doc ORDER BY pos)""")
def _(spark, d):
    p = F.col("pos")
    day = F.concat(F.lit("Apr "), (p % 28 + 1).cast("string"))
    text = F.when(p % 6 == 2, F.concat(day, F.lit(" "), day)).otherwise(F.concat(F.lit("word "), p.cast("string")))
    rows = I.lines(spark, d).select(F.col("doc_id").alias("doc"), "pos", text.alias("text"))
    return E.nearby_date(rows).select("doc", "pos", "nearby_date")


@_q("slug_unique", r"""WITH s AS (SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(translate(lower(u), ' _/?=&.', '-------'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), 1, 150), ''), 'unknown') AS slug
  FROM (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS u FROM pages)), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS rn FROM s)
SELECT page_id, CASE WHEN rn > 1 THEN slug || '_' || rn ELSE slug END AS slug FROM n""")
def _(spark, d):
    rows = I.table(spark, d, "pages").select("page_id", fn.base_url(F.col("url")).alias("u"))
    return T.slug_unique(rows, "u", ["page_id"]).select("page_id", "slug")


@_q("prefix_dedup_lines", f"""WITH {I.LINES_SQL}, sz AS (SELECT doc_id, sum(length(line)) + count(*) - 1 AS c FROM lines GROUP BY doc_id),
  g AS (SELECT l.doc_id, l.pos, l.line, sz.c, min(l.pos) OVER (PARTITION BY l.doc_id, substr(line, 1, 10)) AS first_pos,
    row_number() OVER (PARTITION BY l.doc_id, substr(line, 1, 10) ORDER BY length(line) DESC, l.pos) AS rn FROM lines l JOIN sz ON l.doc_id = sz.doc_id)
SELECT doc_id, CASE WHEN c < 100 THEN pos ELSE first_pos END AS pos, line FROM g WHERE c < 100 OR rn = 1""")
def _(spark, d):
    return E.prefix_dedup_lines(I.lines(spark, d), prefix=10)


@_q("containment_dedup", f"""WITH {I.LINES_SQL}, n AS (SELECT doc_id, pos, line, regexp_replace(regexp_replace(line, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM lines),
  o AS (SELECT doc_id, min(pos) AS pos, arg_min(line, pos) AS line, t FROM n WHERE t <> '' GROUP BY doc_id, t)
SELECT doc_id, pos, line FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE b.doc_id = a.doc_id AND length(b.t) > length(a.t) AND instr(b.t, a.t) > 0)""")
def _(spark, d):
    out = E.containment_dedup(I.heavy(spark, d, "documents"))
    return out.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@_q("image_dedup", """WITH l AS (SELECT page_id AS doc_id, unnest(range(12)) AS pos, url FROM pages), u AS (SELECT doc_id, pos, regexp_replace(url, '[?#].*$', '') || '/' || (pos % 3) || '?v=' || pos AS url FROM l)
SELECT doc_id, pos, url FROM u WHERE pos < 3""")
def _(spark, d):
    links = I.table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), "url", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    url = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/"), (F.col("pos") % 3).cast("string"), F.lit("?v="), F.col("pos").cast("string"))
    return E.image_dedup(links.select("doc_id", F.col("pos").cast("long").alias("pos"), url.alias("url")))


_CONTACT_SQL = I.LINES_SQL + """, c AS (SELECT doc_id, pos, CASE pos % 6 WHEN 1 THEN 'Call (555) ' || pos WHEN 2 THEN 'www.site' || pos || '.org' WHEN 3 THEN 'me@' || pos WHEN 4 THEN 'Main Street, ' || doc_id WHEN 5 THEN '(5) www.b' || pos ELSE 'nothing' END AS line FROM lines)"""


@_q("contact_fields", f"""WITH {_CONTACT_SQL}, m AS (SELECT doc_id, max(pos) AS n FROM c GROUP BY doc_id)
SELECT doc_id, CASE WHEN n >= 2 THEN 'www.site2.org' END AS website, 'Call (555) 1' AS phone, CASE WHEN n >= 3 THEN 'me@3' END AS email, CASE WHEN n >= 4 THEN 'Main Street, ' || doc_id END AS address FROM m WHERE n >= 1""")
def _(spark, d):
    p = F.col("pos")
    s = p.cast("string")
    line = (
        F.when(p % 6 == 1, F.concat(F.lit("Call (555) "), s)).when(p % 6 == 2, F.concat(F.lit("www.site"), s, F.lit(".org")))
        .when(p % 6 == 3, F.concat(F.lit("me@"), s)).when(p % 6 == 4, F.concat(F.lit("Main Street, "), F.col("doc_id").cast("string")))
        .when(p % 6 == 5, F.concat(F.lit("(5) www.b"), s)).otherwise(F.lit("nothing"))
    )
    return E.contact_fields(I.lines(spark, d).select("doc_id", "pos", line.alias("line")))


@_q("funding_fields", f"""WITH {I.LINES_SQL}, m AS (SELECT doc_id, max(pos) AS n FROM lines GROUP BY doc_id)
SELECT doc_id, 'Series A $5M' AS stage, CASE WHEN n >= 1 THEN 'Series B $9M' END AS amount, CASE WHEN n >= 2 THEN '3 Investors' END AS investors FROM m""")
def _(spark, d):
    p = F.col("pos")
    line = F.when(p % 3 == 0, F.lit("Series A $5M")).when(p % 3 == 1, F.lit("Series B $9M")).otherwise(F.lit("3 Investors"))
    return E.funding_fields(I.lines(spark, d).select("doc_id", "pos", line.alias("line")))


@_q("nearest_candidates", f"""WITH {I.LINES_SQL}, k AS (SELECT doc_id, pos, line, length(line) % 3 + 1 AS prio FROM lines) SELECT doc_id, arg_min(line, prio * 1000000 + pos) AS line FROM k GROUP BY doc_id""")
def _(spark, d):
    rows = I.lines(spark, d).withColumn("prio", F.length("line") % 3 + 1)
    return D.nearest_candidates(rows, "doc_id", "prio", "pos", "line")
