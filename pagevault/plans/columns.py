"""Registered queries: column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault import functions as fn
from pagevault.functions import fixed
from pagevault.plans import inputs as I

QUERIES, ORACLE = {}, {}


def _q(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


def _sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WS = r"^\s+|\s+$"

_URLS_SQL = """u AS (SELECT page_id, CASE page_id % 6
  WHEN 0 THEN '  ' || url || '/' WHEN 1 THEN upper(url) WHEN 2 THEN 'ftp://host/' || page_id
  WHEN 3 THEN replace(url, '://', '://www.') || '//' WHEN 4 THEN regexp_replace(url, '^https?://', '') ELSE url END AS raw FROM pages)"""


def _raw_urls(spark, d):
    p, url, n = I.table(spark, d, "pages"), F.col("url"), F.col("page_id")
    raw = (
        F.when(n % 6 == 0, F.concat(F.lit("  "), url, F.lit("/")))
        .when(n % 6 == 1, F.upper(url))
        .when(n % 6 == 2, F.concat(F.lit("ftp://host/"), n.cast("string")))
        .when(n % 6 == 3, F.concat(F.replace(url, F.lit("://"), F.lit("://www.")), F.lit("//")))
        .when(n % 6 == 4, F.regexp_replace(url, "^https?://", ""))
        .otherwise(url)
    )
    return p.select("page_id", raw.alias("raw"))


@_q("normalize_url", f"""WITH {_URLS_SQL}, s AS (SELECT page_id, trim(raw) AS t FROM u),
  r AS (SELECT page_id, t, regexp_replace(CASE WHEN instr(t, '://') > 0 THEN substr(t, instr(t, '://') + 3) ELSE t END, '^www\\.', '') AS rest FROM s)
SELECT page_id, CASE WHEN instr(t, '://') > 0 AND NOT regexp_matches(lower(t), '^https?://') THEN NULL
  ELSE rtrim(CASE WHEN instr(rest, '/') > 0 THEN lower(substr(rest, 1, instr(rest, '/') - 1)) || substr(rest, instr(rest, '/')) ELSE lower(rest) END, '/') END AS normalized
FROM r""")
def _(spark, d):
    return _raw_urls(spark, d).select("page_id", fn.normalize_url(F.col("raw")).alias("normalized"))


@_q("base_url", f"WITH {_URLS_SQL} SELECT page_id, nullif(regexp_extract(raw, '^(https?://[^/?#]*)', 1), '') AS base FROM u")
def _(spark, d):
    return _raw_urls(spark, d).select("page_id", fn.base_url(F.col("raw")).alias("base"))


@_q("absolute_url", """WITH links AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages),
  b AS (SELECT *, nullif(regexp_extract(url, '^(https?://[^/?#]*)', 1), '') AS base FROM links)
SELECT page_id, href, CASE WHEN base IS NULL OR regexp_matches(href, '^(https?://|mailto:|tel:|#|data:|//|javascript:)') THEN href
  WHEN href = '' THEN base WHEN href LIKE '/%' OR href LIKE '?%' THEN base || href
  ELSE base || '/' || regexp_replace(href, '^(\\.{1,2}/)+', '') END AS absolute FROM b""")
def _(spark, d):
    p = I.table(spark, d, "pages")
    links = p.select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    return links.select("page_id", "href", fn.absolute_url(F.col("href"), fn.base_url(F.col("url"))).alias("absolute"))


@_q("same_resource", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE true END AS same FROM pages""")
def _(spark, d):
    p, n = I.table(spark, d, "pages"), F.col("page_id")
    plain = F.regexp_replace("url", r"[?#].*$", "")
    other = F.when(n % 3 == 0, F.concat(plain, F.lit("?q=1"))).when(n % 3 == 1, F.concat(plain, F.lit("/more"))).otherwise(F.concat(plain, F.lit("#top")))
    return p.select("page_id", fn.same_resource(F.col("url"), other).alias("same"))


@_q("strip_query", "SELECT page_id, string_split(url, '?')[1] AS stripped FROM pages")
def _(spark, d):
    return I.table(spark, d, "pages").select("page_id", fn.strip_query(F.col("url")).alias("stripped"))


@_q("is_url", f"WITH {_URLS_SQL} SELECT page_id, regexp_matches(raw, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+|(?i:file):)') AS is_url FROM u")
def _(spark, d):
    return _raw_urls(spark, d).select("page_id", fn.is_url(F.col("raw")).alias("is_url"))


@_q("is_plain_text", f"WITH {_URLS_SQL} SELECT page_id, NOT (raw LIKE 'http://%' OR raw LIKE 'https://%' OR raw LIKE 'file://%') AS plain FROM u")
def _(spark, d):
    return _raw_urls(spark, d).select("page_id", fn.is_plain_text(F.col("raw")).alias("plain"))


@_q("slugify", r"""SELECT page_id, coalesce(nullif(substr(regexp_replace(regexp_replace(translate(lower(url), ' _/?=&.', '-------'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), 1, 150), ''), 'unknown') AS slug FROM pages""")
def _(spark, d):
    return I.table(spark, d, "pages").select("page_id", fn.slugify(F.col("url")).alias("slug"))


@_q("clean_whitespace", rf"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate('  ' || text || chr(9), chr(9) || chr(13) || chr(160), '   '), '{_WS}', '', 'g'), ' +', ' ', 'g'), '{_WS}', '', 'g') AS cleaned FROM documents""")
def _(spark, d):
    padded = F.concat(F.lit("  "), F.col("text"), F.lit("\t"))
    return I.table(spark, d, "documents").select("doc_id", fn.clean_whitespace(padded).alias("cleaned"))


@_q("normalize_text", rf"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '{_WS}', '', 'g') AS normalized FROM documents")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", fn.normalize_text(F.col("text")).alias("normalized"))


@_q("clip_text", rf"""WITH c AS (SELECT doc_id, regexp_replace(replace(text, '·', ''), '{_WS}', '', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 280 THEN substr(t, 1, 280) || '...' ELSE t END AS clipped FROM c""")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", fn.clip_text(F.col("text"), 280).alias("clipped"))


@_q("dedup_words", rf"""WITH w AS (SELECT doc_id, unnest(s) AS word, unnest(range(len(s))) AS pos FROM
  (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '{_WS}', '', 'g'), ' ') AS s FROM documents)),
  f AS (SELECT doc_id, word, min(pos) AS pos FROM w GROUP BY ALL)
SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS deduped FROM f GROUP BY doc_id""")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", fn.dedup_words(F.col("text")).alias("deduped"))


@_q("strip_affixes", """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN c_name ELSE c_name END AS stripped FROM customer""")
def _(spark, d):
    n, name = F.col("c_custkey"), F.col("c_name")
    dressed = (
        F.when(n % 4 == 0, F.concat(F.lit("By "), name))
        .when(n % 4 == 1, F.concat(F.lit("Written by "), name))
        .when(n % 4 == 2, F.concat(F.lit("Watched "), name))
        .otherwise(F.concat(name, F.lit("'s profile picture")))
    )
    out = fn.strip_affixes(dressed, [*fixed.BYLINE_PREFIXES, fixed.HISTORY_PREFIX], [fixed.AVATAR_SUFFIX])
    return I.table(spark, d, "customer").select("c_custkey", out.alias("stripped"))


@_q("trim_code_head", r"""WITH v AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN chr(10) || '  ' || chr(10) || text
    WHEN 1 THEN 'var x = {};' || chr(10) || 'foo();' || chr(10) || text ELSE text END AS t FROM documents),
  a AS (SELECT doc_id, string_split(t, chr(10)) AS l FROM v),
  b AS (SELECT doc_id, l[coalesce(list_position(list_transform(l, lambda x: regexp_matches(x, '\S')), true), len(l) + 1):] AS l FROM a)
SELECT doc_id, coalesce(array_to_string(CASE WHEN len(l) > 0 AND regexp_matches(l[1], 'function|document|window|\{|\}|var|const|let|==|=>|\(self|\[0\]')
  THEN l[coalesce(nullif(list_position(list_transform(l, lambda x: regexp_matches(x, '^\s*(#|[A-Z]|[*>-])')), true), 0), 1):] ELSE l END, chr(10)), '') AS trimmed FROM b""")
def _(spark, d):
    n, t = F.col("doc_id"), F.col("text")
    dressed = F.when(n % 3 == 0, F.concat(F.lit("\n  \n"), t)).when(n % 3 == 1, F.concat(F.lit("var x = {};\nfoo();\n"), t)).otherwise(t)
    return I.table(spark, d, "documents").select("doc_id", fn.trim_code_head(dressed).alias("trimmed"))


@_q("drop_banner", "SELECT page_id, 'before  after ' || url AS dropped FROM pages")
def _(spark, d):
    dressed = F.concat(F.lit("before << Reading 12 PAGES after "), F.col("url"))
    return I.table(spark, d, "pages").select("page_id", fn.drop_banner(dressed, r"(?i)<<\s*reading.*?(pages|\.\.\.)").alias("dropped"))


@_q("caption_clean", rf"""WITH f AS (SELECT doc_id, text AS t FROM documents),
  v AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN t || ' Puede ser una imagen de dos' WHEN 1 THEN 'No photo description available.'
    WHEN 2 THEN 'Photo by Ana Li on May 4, 2024.' WHEN 3 THEN 'ab·' ELSE t END AS t FROM f),
  c AS (SELECT doc_id, t, CASE WHEN regexp_matches(t, 'Puede ser una imagen de|No photo description available|No hay ninguna descripción')
    THEN CASE WHEN length(regexp_replace(string_split_regex(t, 'Puede ser una imagen de|No photo description available|No hay ninguna descripción')[1], '{_WS}', '', 'g')) > 10
      THEN regexp_replace(string_split_regex(t, 'Puede ser una imagen de|No photo description available|No hay ninguna descripción')[1], '{_WS}', '', 'g') ELSE 'Image' END ELSE t END AS k FROM v),
  e AS (SELECT doc_id, t, CASE WHEN regexp_matches(trim(k), '(?i)^Photo by [\p{{L}}\p{{N}}_\s]+ on [\p{{L}}\p{{N}}_]+ \d+, \d{{4}}\.?$') THEN 'Image'
    ELSE regexp_replace(replace(k, '·', ''), '{_WS}', '', 'g') END AS r FROM c)
SELECT doc_id, CASE WHEN length(t) >= 5 AND length(r) > 3 THEN r END AS caption FROM e""")
def _(spark, d):
    n = F.col("doc_id")
    t = F.col("text")
    dressed = (
        F.when(n % 5 == 0, F.concat(t, F.lit(" Puede ser una imagen de dos")))
        .when(n % 5 == 1, F.lit("No photo description available."))
        .when(n % 5 == 2, F.lit("Photo by Ana Li on May 4, 2024."))
        .when(n % 5 == 3, F.lit("ab·"))
        .otherwise(t)
    )
    return I.table(spark, d, "documents").select("doc_id", fn.caption_clean(dressed).alias("caption"))


@_q("resolve_image_path", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/base/img/' || page_id || '.png' WHEN 1 THEN '/base/pic' || page_id ELSE url END AS resolved FROM pages""")
def _(spark, d):
    n = F.col("page_id")
    raw = F.when(n % 3 == 0, F.concat(F.lit("/img/"), n.cast("string"), F.lit(".png"))).when(n % 3 == 1, F.concat(F.lit("./pic"), n.cast("string"))).otherwise(F.col("url"))
    return I.table(spark, d, "pages").select("page_id", fn.resolve_image_path(raw, F.lit("/base")).alias("resolved"))


@_q("parse_metric", f"""WITH {I.METRIC_SQL}, p AS (SELECT o_orderkey, replace(trim(txt), ',', '') AS t FROM metrics)
SELECT o_orderkey, coalesce(CAST(trunc(TRY_CAST(regexp_replace(t, '[KM]$', '') AS DOUBLE) *
  CASE WHEN t LIKE '%K' THEN 1000 WHEN t LIKE '%M' THEN 1000000 ELSE 1 END) AS BIGINT), 0) AS metric FROM p""")
def _(spark, d):
    return I.metrics(spark, d).select("o_orderkey", fn.parse_metric(F.col("txt")).alias("metric"))


@_q("counts_from_text", """SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS replies, o_orderkey % 900 AS reposts,
  CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE -1 END AS followers FROM orders""")
def _(spark, d):
    o = I.table(spark, d, "orders")
    n = F.floor("o_totalprice")
    text = F.concat(
        F.format_number(n, 0), F.lit(" replies, "), (F.col("o_orderkey") % 900).cast("string"), F.lit(" reposts, "),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.col("o_custkey").cast("string"), F.lit(" Followers"))).otherwise(F.lit("none")),
    )
    return o.select(
        "o_orderkey",
        fn.counts_from_text(text, "repl(?:y|ies)").alias("replies"),
        fn.counts_from_text(text, "reposts").alias("reposts"),
        F.coalesce(fn.counts_from_text(text, "Followers"), F.lit(-1)).alias("followers"),
    )


@_q("digits_only", "SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def _(spark, d):
    return I.table(spark, d, "documents").select("doc_id", fn.digits_only(F.col("text")).alias("digits"))


@_q("parse_date", f"""WITH {I.DATES_SQL}
SELECT d.o_orderkey, CASE d.o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d 00:00:00')
  WHEN 2 THEN strftime(TRY_CAST('2024' || strftime(o_orderdate, '-%m-%d') AS DATE), '%Y-%m-%d 00:00:00') END AS parsed
FROM dates d JOIN orders o ON d.o_orderkey = o.o_orderkey""")
def _(spark, d):
    return I.dates(spark, d).select(
        "o_orderkey", F.date_format(fn.parse_date(F.col("txt"), 2024), "yyyy-MM-dd HH:mm:ss").alias("parsed")
    )


_CANDIDATES_SQL = ", ".join("nullif(regexp_extract(txt, " + _sql_str(p) + ", 0), '')" for p in fixed.DATE_PATTERNS)


@_q("date_candidates", f"""WITH {I.DATES_SQL}, v AS (SELECT o_orderkey, CASE o_orderkey % 9 WHEN 0 THEN 'seen 3 hours ago' WHEN 1 THEN 'at 10:45 PM' WHEN 2 THEN 'on 3/14/22'
  WHEN 3 THEN 'Yesterday' ELSE txt END AS txt FROM dates) SELECT o_orderkey, trim(coalesce({_CANDIDATES_SQL})) AS candidate FROM v""")
def _(spark, d):
    n = F.col("o_orderkey")
    txt = (
        F.when(n % 9 == 0, F.lit("seen 3 hours ago")).when(n % 9 == 1, F.lit("at 10:45 PM")).when(n % 9 == 2, F.lit("on 3/14/22"))
        .when(n % 9 == 3, F.lit("Yesterday")).otherwise(F.col("txt"))
    )
    return I.dates(spark, d).select("o_orderkey", fn.date_candidates(txt).alias("candidate"))


@_q("is_relative_time", f"""WITH {I.LINES_SQL}, v AS (SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN (pos % 60) || 'm' WHEN 1 THEN 'now ' WHEN 2 THEN pos || ' hours ago' ELSE line END AS t FROM lines)
SELECT doc_id, pos, regexp_matches(trim(t), '(?i)^(?:\\d+\\s?[smhd]|now|\\d+\\s+(?:second|minute|hour|day)s?\\s+ago)$') AS relative FROM v""")
def _(spark, d):
    p = F.col("pos")
    t = (
        F.when(p % 4 == 0, F.concat((p % 60).cast("string"), F.lit("m"))).when(p % 4 == 1, F.lit("now "))
        .when(p % 4 == 2, F.concat(p.cast("string"), F.lit(" hours ago"))).otherwise(F.col("line"))
    )
    return I.lines(spark, d).select("doc_id", "pos", fn.is_relative_time(t).alias("relative"))


@_q("month_day_clean", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%b %-d') WHEN 1 THEN strftime(o_orderdate, '%b %-d,')
  ELSE 'ordered in ' || strftime(o_orderdate, '%B') END AS cleaned, o_orderkey % 3 <> 2 AS dated FROM orders""")
def _(spark, d):
    n, day = F.col("o_orderkey"), F.date_format("o_orderdate", "MMM d")
    t = (
        F.when(n % 3 == 0, F.concat(day, F.lit(" "), day)).when(n % 3 == 1, F.concat(day, F.lit(", "), F.date_format("o_orderdate", "yyyy")))
        .otherwise(F.concat(F.lit("ordered in "), F.date_format("o_orderdate", "MMMM")))
    )
    return I.table(spark, d, "orders").select("o_orderkey", fn.month_day_clean(t).alias("cleaned"), fn.is_month_day(t).alias("dated"))


@_q("founded_year", """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y') END AS founded FROM orders""")
def _(spark, d):
    n, year = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy")
    t = F.when(n % 3 == 0, F.concat(F.lit("Founded in "), year, F.lit(", moved 2031"))).when(n % 3 == 1, F.concat(year, F.lit(" "))).otherwise(F.concat(F.lit("sold in "), year))
    return I.table(spark, d, "orders").select("o_orderkey", fn.founded_year(t).alias("founded"))


@_q("split_keywords", "SELECT p_partkey, replace(p_name, ' ', '|') || '|' || p_brand AS keywords FROM part")
def _(spark, d):
    text = F.concat(F.replace("p_name", F.lit(" "), F.lit(" , ,")), F.lit(", "), F.col("p_brand"), F.lit(","))
    return I.table(spark, d, "part").select("p_partkey", F.array_join(fn.split_keywords(text), "|").alias("keywords"))


@_q("json_or_default", """SELECT event_id, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def _(spark, d):
    text = F.when(F.col("event_id") % 5 == 0, F.substring("props", 1, 4)).otherwise(F.col("props"))
    default = F.struct(F.lit(-1).cast("long").alias("k"))
    parsed = fn.json_or_default(text, "struct<k:bigint>", default)
    return I.table(spark, d, "events").select("event_id", F.coalesce(parsed["k"], F.lit(-1)).alias("k"))


@_q("array_or_empty", f"WITH {I.DOCS_SQL} SELECT doc_id, CASE WHEN quality IS NULL THEN 0 ELSE 2 END::BIGINT AS n_keywords FROM docs")
def _(spark, d):
    stored = F.when(F.size("keywords") > 0, F.col("keywords"))
    return I.docs(spark, d).select("doc_id", F.size(fn.array_or_empty(stored)).cast("long").alias("n_keywords"))


@_q("text_items", f"WITH {I.LINE_CHUNKS_SQL} SELECT doc_id, chunk_index, CASE WHEN item_type = 'text' THEN item_value ELSE '' END AS texts FROM line_chunks")
def _(spark, d):
    texts = F.array_join(F.transform(fn.text_items(F.col("content")), lambda x: x["text"]), "|")
    return I.line_chunks(spark, d).select("doc_id", "chunk_index", texts.alias("texts"))


@_q("image_items", f"WITH {I.LINE_CHUNKS_SQL} SELECT doc_id, chunk_index, CASE WHEN item_type = 'image_url' THEN item_value ELSE '' END AS images FROM line_chunks")
def _(spark, d):
    images = F.array_join(F.transform(fn.image_items(F.col("content")), lambda x: x["image_url"]), "|")
    return I.line_chunks(spark, d).select("doc_id", "chunk_index", images.alias("images"))


@_q("jsonld_fields", """SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN NULL ELSE p_brand END AS author,
  CASE p_partkey % 5 WHEN 4 THEN '' WHEN 3 THEN '' ELSE replace(p_name, ' ', '|') END AS keywords,
  CASE WHEN p_partkey % 5 IN (0, 2) THEN '2024-01-0' || (p_partkey % 9 + 1) END AS published FROM part""")
def _(spark, d):
    n, brand, name = F.col("p_partkey"), F.col("p_brand"), F.col("p_name")
    day = F.concat(F.lit("2024-01-0"), (n % 9 + 1).cast("string"))
    text = (
        F.when(n % 5 == 0, F.concat(F.lit('{"author":" '), brand, F.lit('","keywords":"'), F.replace(name, F.lit(" "), F.lit(", ")), F.lit('","datePublished":"'), day, F.lit('"}')))
        .when(n % 5 == 1, F.concat(F.lit('{"author":{"name":"'), brand, F.lit('"},"keywords":["'), F.replace(name, F.lit(" "), F.lit('"," ","')), F.lit('"]}')))
        .when(n % 5 == 2, F.concat(F.lit('[{"x":1},{"author":"'), brand, F.lit('","keywords":"'), F.replace(name, F.lit(" "), F.lit(",")), F.lit('","datePublished":"soon","dateModified":"'), day, F.lit('"}]')))
        .when(n % 5 == 3, F.concat(F.lit('{"author":"'), brand, F.lit('"}')))
        .otherwise(F.lit('{"author": broken'))
    )
    rows = I.table(spark, d, "part").select("p_partkey", fn.jsonld_fields(text).alias("f"))
    return rows.select(
        "p_partkey",
        F.col("f.author").alias("author"),
        F.coalesce(F.array_join("f.keywords", "|"), F.lit("")).alias("keywords"),
        F.date_format("f.published_at", "yyyy-MM-dd").alias("published"),
    )


_HEADER_SQL = """concat_ws(chr(10), CASE WHEN title <> '' THEN 'Title: ' || title END, CASE WHEN description <> '' THEN 'Description: ' || description END,
  'Source: ' || coalesce(source, 'None'), 'URL: ' || url, CASE WHEN contact_name <> '' THEN 'Contact: ' || contact_name END,
  CASE WHEN len(keywords) > 0 THEN 'Keywords: ' || array_to_string(keywords, ', ') END,
  'Metadata: lang: ' || lang || ', chars: ' || n_chars)"""


@_q("chunk_header", f"WITH {I.DOCS_SQL} SELECT doc_id, {_HEADER_SQL} AS header FROM docs")
def _(spark, d):
    header = fn.chunk_header(
        title=F.col("title"), description=F.col("description"), source=F.col("source"), url=F.col("url"),
        contact_name=F.col("contact_name"), keywords=F.col("keywords"), metadata=I.metadata_map(),
    )
    return I.docs(spark, d).select("doc_id", header.alias("header"))


@_q("metrics_line", """SELECT o_orderkey, concat_ws(' ', CASE WHEN o_orderkey % 3 <> 0 THEN '💬 ' || (o_orderkey % 3) END,
  CASE WHEN o_orderkey % 5 <> 0 THEN '⟲ ' || (o_orderkey % 5) END, CASE WHEN o_custkey % 2 <> 0 THEN '❤️ ' || (o_custkey % 2) END,
  '👁️ ' || CAST(floor(o_totalprice) AS BIGINT)) AS metrics FROM orders""")
def _(spark, d):
    line = fn.metrics_line(
        replies=F.col("o_orderkey") % 3, retweets=F.col("o_orderkey") % 5, likes=F.col("o_custkey") % 2, views=F.floor("o_totalprice")
    )
    return I.table(spark, d, "orders").select("o_orderkey", line.alias("metrics"))


@_q("author_link", """SELECT c_custkey, '[' || CASE WHEN c_custkey % 3 = 0 THEN 'cust' || c_custkey ELSE c_name END || '](' ||
  CASE WHEN c_custkey % 2 = 0 THEN 'https://x.com/cust' || c_custkey ELSE 'https://y.org/' || c_custkey END || ') (@cust' || c_custkey || ')' AS link FROM customer""")
def _(spark, d):
    n = F.col("c_custkey")
    handle = F.concat(F.lit("@cust"), n.cast("string"))
    name = F.when(n % 3 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("c_name")))
    url = F.when(n % 2 == 0, F.concat(F.lit("/cust"), n.cast("string"))).otherwise(F.concat(F.lit("https://y.org/"), n.cast("string")))
    return I.table(spark, d, "customer").select("c_custkey", fn.author_link(name, handle, url).alias("link"))


@_q("post_markdown", """SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn % 3 = 0 THEN '> Reposted by r' || conv_id END,
  '### [' || role || '](/u/' || conv_id || ') (@' || role || ') · t' || turn, nullif(text, ''),
  '💬 ' || turn || '   🔄 0   ❤️ ' || conv_id) AS post FROM conversations""")
def _(spark, d):
    c, t = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    post = fn.post_markdown(
        author=F.col("role"), handle=F.concat(F.lit("@"), F.col("role")), time=F.concat(F.lit("t"), t), text=F.col("text"),
        profile_url=F.concat(F.lit("/u/"), c), reposter=F.when(F.col("turn") % 3 == 0, F.concat(F.lit("r"), c)),
        replies=F.col("turn"), likes=F.col("conv_id"),
    )
    return I.table(spark, d, "conversations").select("conv_id", "turn", post.alias("post"))


@_q("extract_urls", """SELECT page_id, url || '|www.ex' || '|' || url AS urls FROM pages""")
def _(spark, d):
    text = F.concat(F.lit("see "), F.col("url"), F.lit(". Or www.ex. And ("), F.col("url"), F.lit(") 'http'"))
    return I.table(spark, d, "pages").select("page_id", F.array_join(fn.extract_urls(text), "|").alias("urls"))


@_q("linkify", """WITH h AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, 'see [' || CASE WHEN length(host) > 30 THEN substr(host, 1, 27) || '...' ELSE host END || '](' || url || '), or "' || url || '" and [x](' || url || ') [www.ex](www.ex)' AS linked FROM h""")
def _(spark, d):
    u = F.col("url")
    text = F.concat(F.lit("see "), u, F.lit(', or "'), u, F.lit('" and [x]('), u, F.lit(") www.ex"))
    return I.table(spark, d, "pages").select("page_id", fn.linkify(text).alias("linked"))


@_q("extract_hashtags", """SELECT doc_id, '#' || source || '|#été_' || doc_id AS tags FROM documents""")
def _(spark, d):
    text = F.concat(F.lit("a #"), F.col("source"), F.lit(" b#été_"), F.col("doc_id").cast("string"), F.lit("! # "))
    return I.table(spark, d, "documents").select("doc_id", F.array_join(fn.extract_hashtags(text), "|").alias("tags"))


@_q("name_handle", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'Some Body' ELSE c_name END AS name,
  CASE WHEN c_custkey % 3 = 2 THEN NULL ELSE 'h' || c_custkey END AS handle FROM customer""")
def _(spark, d):
    n = F.col("c_custkey")
    h = F.concat(F.lit("@h"), n.cast("string"))
    text = (
        F.when(n % 3 == 0, F.concat(F.col("c_name"), F.lit(" "), h, F.lit("Follow me")))
        .when(n % 3 == 1, F.concat(F.col("c_name"), h, F.lit(".x · 3h")))
        .otherwise(F.lit("Some Body"))
    )
    rows = I.table(spark, d, "customer").select("c_custkey", fn.name_handle(text).alias("f"))
    return rows.select("c_custkey", "f.name", "f.handle")


@_q("bio_after_action", """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN '' ELSE 'is in ' || lower(c_mktsegment) END AS bio FROM customer""")
def _(spark, d):
    n = F.col("c_custkey")
    seg = F.concat(F.lit("is in "), F.lower("c_mktsegment"))
    text = (
        F.when(n % 3 == 0, F.concat(F.col("c_name"), F.lit("@h Follow "), seg))
        .when(n % 3 == 1, F.concat(F.lit("X@handle1 Follow handle1 "), seg))
        .otherwise(F.lit("nothing to see"))
    )
    return I.table(spark, d, "customer").select("c_custkey", fn.bio_after_action(text).alias("bio"))


def _rx(words):
    from pagevault.functions.text import any_of

    return _sql_str(any_of(words))


_PEOPLE_SQL = """people AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'Ana Maria Lopez' WHEN 1 THEN 'Jo Wu, Chief of Staff' WHEN 2 THEN 'engineer'
  WHEN 3 THEN '2nd degree connection' WHEN 4 THEN c_custkey || ' followers' ELSE c_name || ' x' END AS t FROM customer)"""


def _people(spark, d):
    n = F.col("c_custkey")
    t = (
        F.when(n % 6 == 0, F.lit("Ana Maria Lopez")).when(n % 6 == 1, F.lit("Jo Wu, Chief of Staff")).when(n % 6 == 2, F.lit("engineer"))
        .when(n % 6 == 3, F.lit("2nd degree connection")).when(n % 6 == 4, F.concat(n.cast("string"), F.lit(" followers")))
        .otherwise(F.concat(F.col("c_name"), F.lit(" x")))
    )
    return I.table(spark, d, "customer").select("c_custkey", t.alias("t"))


_ALL_ROLES = fn.classify.ALL_ROLES


@_q("classify_person", f"""WITH {_PEOPLE_SQL}, w AS (SELECT c_custkey, t, string_split(trim(t), ' ') AS s FROM people)
SELECT c_custkey, length(t) BETWEEN 3 AND 40 AND len(s) >= 2 AND len(list_filter(s, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= len(s) * 0.75
  AND NOT regexp_matches(lower(t), {_rx(fixed.NON_NAME_WORDS + _ALL_ROLES + fixed.LOCATION_WORDS)}) AS is_person FROM w""")
def _(spark, d):
    return _people(spark, d).select("c_custkey", fn.classify_person(F.col("t")).alias("is_person"))


@_q("classify_title", f"""WITH {_PEOPLE_SQL} SELECT c_custkey, regexp_matches(lower(t), {_rx(fixed.RELATIONSHIP_WORDS)})
  OR regexp_matches(lower(t), {_sql_str(fn.classify.ROLE_PATTERN)}) OR (regexp_matches(lower(t), '(^|\\s)\\S+\\s+(at|of|for|with)\\s+\\S')
  AND NOT regexp_matches(lower(t), '(university|school|college)')) AS is_title FROM people""")
def _(spark, d):
    return _people(spark, d).select("c_custkey", fn.classify_title(F.col("t")).alias("is_title"))


@_q("classify_connection", f"""WITH {_PEOPLE_SQL} SELECT c_custkey, regexp_matches(lower(t), {_rx(fixed.CONNECTION_DEGREES + fixed.CONNECTION_MUTUAL + fixed.CONNECTION_PHRASES)})
  OR (regexp_matches(lower(t), 'follower|following') AND regexp_matches(t, '\\d')) AS is_connection FROM people""")
def _(spark, d):
    return _people(spark, d).select("c_custkey", fn.classify_connection(F.col("t")).alias("is_connection"))


@_q("to_wkt", """SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'POINT (' || (c_custkey % 180) || '.5 ' || (c_nationkey % 90) || '.25)' END AS wkt FROM customer""")
def _(spark, d):
    lon = F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 180 + F.lit(0.5).cast("double"))
    lat = F.col("c_nationkey") % 90 + F.lit(0.25).cast("double")
    return I.table(spark, d, "customer").select("c_custkey", fn.to_wkt(lon, lat).alias("wkt"))


@_q("from_wkt", """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 999.0::DOUBLE ELSE round(c_acctbal / 100, 4) END AS lon, CASE WHEN c_custkey % 4 = 0 THEN 999.0::DOUBLE ELSE c_nationkey + 0.5::DOUBLE END AS lat FROM customer""")
def _(spark, d):
    n = F.col("c_custkey")
    lon, lat = F.round(F.col("c_acctbal") / 100, 4), F.col("c_nationkey").cast("double") + 0.5
    text = F.when(n % 4 == 0, F.lit("POINT (1.0)")).otherwise(fn.to_wkt(lon, lat))
    rows = I.table(spark, d, "customer").select("c_custkey", fn.from_wkt(text).alias("p"))
    return rows.select("c_custkey", F.coalesce("p.lon", F.lit(999.0)).alias("lon"), F.coalesce("p.lat", F.lit(999.0)).alias("lat"))
