"""Inputs of the registered queries, derived from the given tables in the same way in Spark and in SQL."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.functions.jsoncols import ITEMS_TYPE, item
from pagevault.operators.rows import explode_once
from pagevault.sources.tables import spread

SEP = r"\n+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take much work each, dealt out to all cores when it is only a few files."""
    return spread(table(spark, sf_dir, name))


def scratch(spark: SparkSession) -> str:
    """A new folder for what a registered query writes: in the shared one the session names, else a local one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/out-{uuid.uuid4().hex}"
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-out-")


# --- lines of documents -------------------------------------------------------------------------------------

LINES_SQL = """lines AS (
  SELECT doc_id, unnest(range(len(l)))::BIGINT AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = explode_once(docs, F.split("text", "\n"), "doc_id", pos="pos", item="line")
    return rows.withColumn("pos", F.col("pos").cast("long"))


# --- documents with attributes ------------------------------------------------------------------------------

DOCS_SQL = """docs AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, 'doc/' || (d.doc_id // 2) AS url,
    string_split(d.text, chr(10))[1] AS title,
    CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.lang || ' text' END AS description,
    CASE WHEN d.doc_id % 4 = 0 THEN '' ELSE 'author ' || (d.doc_id % 17) END AS contact_name,
    d.source AS source, 'loc' || (d.doc_id % 3) AS source_location_identifier,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (d.doc_id * 7919 % 86400) AS ingested_at,
    CASE WHEN l.doc_id IS NULL THEN [] ELSE ['quality ' || l.quality, 'toxic ' || l.toxic] END AS keywords,
    d.lang AS lang, d.text AS text, d.n_chars AS n_chars, l.quality AS quality, l.toxic AS toxic
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    joined = d.join(l, "doc_id", "left")
    n = F.col("doc_id")
    return joined.select(
        "doc_id",
        n.cast("string").alias("id"),
        F.concat(F.lit("doc/"), F.floor(n / 2).cast("string")).alias("url"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.when(n % 3 != 0, F.concat("lang", F.lit(" text"))).alias("description"),
        F.when(n % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("author "), (n % 17).cast("string"))).alias("contact_name"),
        "source",
        F.concat(F.lit("loc"), (n % 3).cast("string")).alias("source_location_identifier"),
        F.timestamp_micros(F.lit(1704067200000000) + (n * 7919 % 86400) * 1000000).alias("ingested_at"),
        F.when(F.col("quality").isNull(), F.array().cast("array<string>"))
        .otherwise(
            F.array(
                F.concat(F.lit("quality "), F.col("quality").cast("string")),
                F.concat(F.lit("toxic "), F.col("toxic").cast("string")),
            )
        )
        .alias("keywords"),
        "lang", "text", "n_chars", "quality", "toxic",
    )


def metadata_map():
    """{'lang': ..., 'chars': ...} for the derived documents."""
    return F.create_map(F.lit("lang"), F.col("lang"), F.lit("chars"), F.col("n_chars").cast("string"))


# --- chunks of documents: one per line, every fifth an image ------------------------------------------------

LINE_CHUNKS_SQL = LINES_SQL + """, line_chunks AS (
  SELECT doc_id, pos AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_total,
    CASE WHEN pos % 5 = 4 THEN 'image_url' ELSE 'text' END AS item_type,
    CASE WHEN pos % 5 = 4 THEN 'http://img/' || doc_id || '/' || pos ELSE line END AS item_value
  FROM lines)"""


def line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of one item each, straight from the document rows (the number of chunks is known there)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("l"))
    rows = explode_once(d, "l", "doc_id", F.size("l").cast("long").alias("chunk_total"), pos="p", item="line")
    p = F.col("p")
    image = F.concat(F.lit("http://img/"), F.col("doc_id").cast("string"), F.lit("/"), p.cast("string"))
    return rows.select(
        "doc_id",
        p.cast("long").alias("chunk_index"),
        "chunk_total",
        F.array(F.when(p % 5 == 4, item("image_url", image)).otherwise(item("text", F.col("line")))).cast(ITEMS_TYPE).alias("content"),
    )


# --- versions of documents ----------------------------------------------------------------------------------

VERSIONS_SQL = """versions AS (
  SELECT doc_id, 0::BIGINT AS ver, text FROM documents
  UNION ALL SELECT doc_id, 1, text || chr(10) || 'appended ' || doc_id FROM documents
  UNION ALL SELECT doc_id, 2, CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE text END FROM documents
  UNION ALL SELECT d.doc_id, 3, n.text FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1
  UNION ALL SELECT d.doc_id, 4, n.text FROM documents d JOIN documents n ON n.doc_id = d.doc_id + 1)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ver, text: the text, one line more, one line less, and twice the text of the next document."""
    d = heavy(spark, sf_dir, "documents").select("doc_id", "text")
    nxt = d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("_next"))
    both = d.join(nxt, "doc_id", "left")
    t, nl = F.col("text"), F.instr("text", "\n")
    shorter = F.when(nl > 0, F.substring(t, nl + 1, F.length(t))).otherwise(t)
    longer = F.concat(t, F.lit("\nappended "), F.col("doc_id").cast("string"))
    all_texts = F.array(t, longer, shorter, F.col("_next"), F.col("_next"))
    rows = both.select("doc_id", F.posexplode(all_texts).alias("ver", "text"))
    return rows.filter("text is not null").withColumn("ver", F.col("ver").cast("long"))


BLOCKS_SQL = """vblocks AS (
  SELECT doc_id, ver, trim(b, ' ' || chr(9) || chr(10) || chr(13)) AS b, bpos FROM (
    SELECT doc_id, ver, unnest(s) AS b, unnest(range(len(s))) AS bpos
    FROM (SELECT doc_id, ver, string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\\n+') AS s FROM versions))
  WHERE trim(b, ' ' || chr(9) || chr(10) || chr(13)) <> '')"""


# --- polls of tabs ------------------------------------------------------------------------------------------

POLLS_SQL = """polls AS (
  SELECT tab_id, poll, url FROM (
    SELECT user_id AS tab_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS poll, 'http://x/' || event_type AS url,
      row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts DESC, event_id DESC) AS rn FROM events)
  WHERE rn = 1)"""


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tab_id, poll (day), url: the last event of each user and day."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    last = F.max_by("event_type", F.struct("ts", "event_id"))
    rows = e.groupBy(F.col("user_id").alias("tab_id"), day.alias("poll")).agg(last.alias("_t"))
    return rows.select("tab_id", "poll", F.concat(F.lit("http://x/"), F.col("_t")).alias("url"))


# --- number and date texts ----------------------------------------------------------------------------------

METRIC_SQL = """metrics AS (
  SELECT o_orderkey, CASE
    WHEN o_orderkey % 7 = 0 THEN 'n/a'
    WHEN o_orderkey % 4 = 0 THEN ' ' || (k // 10) || '.' || (k % 10) || 'K'
    WHEN o_orderkey % 4 = 1 THEN (m // 10) || '.' || (m % 10) || 'M'
    WHEN o_orderkey % 4 = 2 THEN (n // 1000) || ',' || lpad(CAST(n % 1000 AS VARCHAR), 3, '0')
    ELSE CAST(n AS VARCHAR) END AS txt
  FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS n, CAST(floor(o_totalprice / 100) AS BIGINT) AS k,
    CAST(floor(o_totalprice / 100000) AS BIGINT) AS m FROM orders))"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, price = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_totalprice")

    def tenths(divisor: int):
        x = F.floor(price / divisor)
        return F.concat(F.floor(x / 10).cast("string"), F.lit("."), (x % 10).cast("string"))

    n = F.floor(price)
    txt = (
        F.when(key % 7 == 0, F.lit("n/a"))
        .when(key % 4 == 0, F.concat(F.lit(" "), tenths(100), F.lit("K")))
        .when(key % 4 == 1, F.concat(tenths(100000), F.lit("M")))
        .when(key % 4 == 2, F.concat(F.floor(n / 1000).cast("string"), F.lit(","), F.lpad((n % 1000).cast("string"), 3, "0")))
        .otherwise(n.cast("string"))
    )
    return o.select("o_orderkey", txt.alias("txt"))


DATES_SQL = """dates AS (
  SELECT o_orderkey, CASE o_orderkey % 4
    WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 8 = 0 THEN 'Z' ELSE '' END
    WHEN 1 THEN 'Posted ' || strftime(o_orderdate, '%B %-d, %Y')
    WHEN 2 THEN upper(strftime(o_orderdate, '%b %-d'))
    ELSE 'no date here' END AS txt FROM orders)"""


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, d = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_orderdate")
    txt = (
        F.when(key % 8 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(key % 4 == 0, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss"))
        .when(key % 4 == 1, F.concat(F.lit("Posted "), F.date_format(d, "MMMM d, yyyy")))
        .when(key % 4 == 2, F.upper(F.date_format(d, "MMM d")))
        .otherwise(F.lit("no date here"))
    )
    return o.select("o_orderkey", txt.alias("txt"))


# --- pages with metadata tags spliced in --------------------------------------------------------------------


def meta_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with og, meta and JSON-LD tags after <head>, chosen by page_id so that every source wins somewhere."""
    pages, n = heavy(spark, sf_dir, "pages"), F.col("page_id")
    key = n.cast("string")

    def tag(every: int, rest: int, *parts):
        return F.when(n % every == rest, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise(F.lit(""))

    head = F.concat(
        F.lit("<head>"),
        tag(3, 0, '<meta property="og:title" content=" Shared ', key, ' ">'),
        tag(4, 1, '<meta property="og:description" content="Shared words ', key, '">'),
        tag(2, 0, '<meta name="description" content="Plain words ', key, '">'),
        tag(5, 0, '<meta property="og:author" content="Og Author ', key, '">'),
        tag(5, 1, '<meta name="author" content="Meta Author ', key, '">'),
        tag(5, 2, '<meta name="twitter:creator" content="@tw', key, '">'),
        tag(5, 3, '<script type="application/ld+json">{"author":{"name":"Ld Author ', key, '"},"keywords":["a","b ', key, '"],"datePublished":"2024-02-0', (n % 9 + 1).cast("string"), '"}</script>'),
        tag(6, 0, '<meta name="keywords" content="k1, ,k', key, '">'),
        tag(6, 1, '<meta property="article:tag" content="t1"><meta property="article:tag" content="t', key, '">'),
        tag(7, 0, '<meta property="article:published_time" content="2024-01-0', (n % 9 + 1).cast("string"), 'T10:00:00+00:00">'),
        tag(7, 1, '<meta name="date" content="not a date"><meta name="pubdate" content="2023-05-06">'),
        tag(3, 1, '<meta property="og:image" content="/img/', key, '.png">'),
        tag(3, 2, '<link rel="icon" href="/icon', key, '.ico">'),
    )
    return pages.withColumn("html", F.replace("html", F.lit("<head>"), head))
