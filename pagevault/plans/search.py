"""Registered queries: chunking, embedding, nearest neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault import functions as fn
from pagevault.operators import chunks as C
from pagevault.operators import search as S
from pagevault.operators.rows import explode_once
from pagevault.plans import inputs as I

QUERIES, ORACLE = {}, {}


def _q(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return register


_TRIM = "trim(b, ' ' || chr(9) || chr(10) || chr(13))"
# headings, list items and images made of every few lines of a document
_MD_SQL = I.LINES_SQL + """, md AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 3 THEN '## ' || line WHEN pos % 7 = 4 THEN '- ' || line WHEN pos % 7 = 5 THEN '![p](http://img/' || pos || ')' ELSE line END AS b FROM lines WHERE regexp_matches(line, '\\S'))"""
_KIND_SQL = """CASE WHEN regexp_matches(t, '^#{1,6}\\s+\\S') THEN 'title' WHEN regexp_matches(t, '^([-*+]|\\d+[.)])\\s+\\S') THEN 'list_item'
  WHEN regexp_matches(t, '^!\\[([^\\]]*)\\]\\(\\s*([^)\\s]*)[^)]*\\)$') THEN 'image' WHEN regexp_matches(t, '^(```|~~~)') THEN 'code' ELSE 'text' END"""


def _md_lines(spark, d):
    p, line = F.col("pos"), F.col("line")
    b = (
        F.when(p % 7 == 3, F.concat(F.lit("## "), line)).when(p % 7 == 4, F.concat(F.lit("- "), line))
        .when(p % 7 == 5, F.concat(F.lit("![p](http://img/"), p.cast("string"), F.lit(")"))).otherwise(line)
    )
    return I.lines(spark, d).filter(line.rlike(r"\S")).select("doc_id", "pos", b.alias("b"))


def _md_docs(spark, d):
    """The same as whole documents, one row each."""
    docs = I.heavy(spark, d, "documents")

    def dressed(line, i):
        return (
            F.when(i % 7 == 3, F.concat(F.lit("## "), line)).when(i % 7 == 4, F.concat(F.lit("- "), line))
            .when(i % 7 == 5, F.concat(F.lit("![p](http://img/"), i.cast("string"), F.lit(")"))).otherwise(line)
        )

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), dressed), "\n\n").alias("text"))


@_q("md_blocks", rf"""WITH s AS (SELECT doc_id, list_filter(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\n+'), lambda x: regexp_matches(x, '\S')) AS l FROM documents),
  e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS b FROM s)
SELECT doc_id, pos::BIGINT AS pos, b AS original, regexp_replace(b, '^\s+|\s+$', '', 'g') AS stripped FROM e""")
def _(spark, d):
    rows = C.md_blocks(I.table(spark, d, "documents").select("doc_id", "text"), "text", I.SEP)
    return rows.withColumn("pos", F.col("pos").cast("long"))


@_q("block_kind", f"WITH {_MD_SQL}, k AS (SELECT doc_id, pos, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS t FROM md) SELECT doc_id, pos, {_KIND_SQL} AS kind FROM k")
def _(spark, d):
    return _md_lines(spark, d).select("doc_id", "pos", C.block_kind(F.col("b")).alias("kind"))


@_q("section_ids", f"""WITH {_MD_SQL}, k AS (SELECT doc_id, pos, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS t FROM md)
SELECT doc_id, pos, (sum(CASE WHEN {_KIND_SQL} = 'title' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos))::BIGINT AS section_id FROM k""")
def _(spark, d):
    rows = _md_lines(spark, d).select("doc_id", "pos", C.block_kind(F.col("b")).alias("kind"))
    return C.section_ids(rows).select("doc_id", "pos", "section_id")


@_q("pack_chunks")
def _(spark, d):
    rows = _md_docs(spark, d).select("doc_id", C.typed_blocks(F.col("text"), C.BLANK_LINES, 3000).alias("blocks"))
    packed = explode_once(C.pack_chunks(rows), "chunks", "doc_id", pos="chunk_index", item="b")
    return packed.select("doc_id", "chunk_index", F.size("b").alias("n_blocks"), F.array_join(F.col("b")["text"], "\n\n").alias("text"))


@_q("chunk_items", rf"""WITH {_MD_SQL}, k AS (SELECT doc_id, pos, regexp_replace(b, '^\s+|\s+$', '', 'g') AS t FROM md), q AS (SELECT *, {_KIND_SQL} = 'image' AS img FROM k),
  g AS (SELECT *, sum(CASE WHEN img THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM q),
  i AS (SELECT doc_id, img, g, min(pos) AS pos, CASE WHEN img THEN 'image_url:' || regexp_extract(min(t), '\(([^)]*)\)', 1) ELSE 'text:' || string_agg(t, chr(10) || chr(10) ORDER BY pos) END AS item FROM g GROUP BY doc_id, img, g)
SELECT doc_id, string_agg(item, '|' ORDER BY pos) AS items FROM i GROUP BY doc_id""")
def _(spark, d):
    rows = _md_docs(spark, d).select("doc_id", C.typed_blocks(F.col("text"), C.BLANK_LINES, 1000000).alias("blocks"))
    items = F.transform("content", lambda x: F.concat(x["type"], F.lit(":"), F.coalesce(x["text"], x["image_url"])))
    return C.chunk_items(rows.filter(F.size("blocks") > 0)).select("doc_id", F.array_join(items, "|").alias("items"))


@_q("chunk_docs")
def _(spark, d):
    rows = C.chunk_docs(I.heavy(spark, d, "documents"), sep=I.SEP)
    return rows.select("id", "doc_id", "chunk_index", "chunk_total", F.to_json("content").alias("content"))


@_q("chunk_docs_text", r"""SELECT doc_id, md5(regexp_replace(text, '[ \t\n\r]+', '', 'g')) AS text_hash, true AS complete FROM documents WHERE regexp_matches(text, '[^ \t\n\r]')""")
def _(spark, d):
    """What the chunks of a document hold together, white space apart: all of its text, in order, in chunks numbered without a gap."""
    rows = C.chunk_docs(I.heavy(spark, d, "documents"), sep=I.SEP)
    text = F.array_join(F.transform("content", lambda x: F.coalesce(x["text"], x["image_url"])), "")
    parts = rows.select("doc_id", "chunk_index", "chunk_total", text.alias("t")).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct("chunk_index", "t"))).alias("p"), F.max("chunk_total").alias("n"), F.max("chunk_index").alias("last")
    )
    whole = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["t"]), ""), r"[ \t\n\r]+", "")
    complete = (F.size("p") == F.col("n")) & (F.col("last") == F.col("n") - 1)
    return parts.select("doc_id", F.md5(whole.cast("binary")).alias("text_hash"), complete.alias("complete"))


@_q("embed_inputs", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'not plain text' ELSE text END AS result FROM documents""")
def _(spark, d):
    n = F.col("doc_id")
    rows = I.table(spark, d, "documents").select(
        "doc_id", F.when(n % 4 == 0, F.concat(F.lit("https://host/"), n.cast("string"))).otherwise(F.col("text")).alias("input")
    )
    good, bad = S.embed_inputs(rows)
    text = F.element_at("content", 1)["text"]
    return good.select("doc_id", text.alias("result")).unionByName(bad.select("doc_id", F.col("reason").alias("result")))


_EMBED_SQL = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
  c AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 4))::INTEGER % 64 AS slot, count(*) AS n FROM w GROUP BY ALL)
SELECT doc_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS value FROM c"""
_EMBED_MODEL_SQL = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents),
  v AS (SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT w FROM w)),
  h AS (SELECT w, list_reduce(list_prepend(0::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, b: (a * %d + b) %% %d) %% 64 AS slot FROM v),
  c AS (SELECT doc_id, slot, count(*) AS n FROM w JOIN h USING (w) GROUP BY ALL)
SELECT doc_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 4) AS value FROM c""" % (S.WORD_BASE, S.WORD_PRIME)


def _slots(rows):
    slots = rows.select("doc_id", F.posexplode("vector").alias("slot", "v")).filter("v <> 0")
    return slots.select("doc_id", "slot", F.round(F.col("v").cast("double"), 4).alias("value"))


@_q("embed_text", _EMBED_SQL)
def _(spark, d):
    return _slots(S.embed_text(I.heavy(spark, d, "documents").select("doc_id", "text"), "text"))


@_q("embed_with_model", _EMBED_MODEL_SQL)
def _(spark, d):
    return _slots(S.embed_with_model(I.heavy(spark, d, "documents").select("doc_id", "text"), "text", lambda: S.hashed_bow))


def _dist_sql(a, b, metric="l2"):
    dot = lambda x, y: f"list_sum(list_transform(range(1, 65), lambda i: {x}[i]::DOUBLE * {y}[i]::DOUBLE))"
    if metric == "l2":
        return f"sqrt(list_sum(list_transform(range(1, 65), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE))))"
    if metric == "dot":
        return f"-{dot(a, b)}"
    return f"greatest(1 - {dot(a, b)} / (sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 0)"


def _knn_sql(k, metric, where="true", per_label=True):
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 50 = 0),
  c AS (SELECT q.query_id, v.vec_id, {_dist_sql('q.qv', 'v.embedding', metric)} AS dist FROM q, embeddings v WHERE {where}),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM c)
SELECT query_id, vec_id, rank, round(dist, 6) AS distance FROM r WHERE rank <= {k}"""


def _queries(spark, d):
    """Every fiftieth vector asks for its neighbours among all, so that the number of queries grows with the table."""
    return I.table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def _shown(df):
    return df.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@_q("knn_exact", _knn_sql(10, "l2"))
def _(spark, d):
    return _shown(S.knn_exact(_queries(spark, d), I.table(spark, d, "embeddings")))


@_q("knn_cosine", _knn_sql(5, "cosine"))
def _(spark, d):
    return _shown(S.knn_exact(_queries(spark, d), I.table(spark, d, "embeddings"), 5, "cosine"))


@_q("knn_dot", _knn_sql(5, "dot"))
def _(spark, d):
    return _shown(S.knn_exact(_queries(spark, d), I.table(spark, d, "embeddings"), 5, "dot"))


_ONE = [((i * 37) % 19 - 9) / 40 for i in range(64)]  # a fixed query vector


@_q("knn_topk", f"""WITH q AS (SELECT {_ONE}::DOUBLE[] AS qv) SELECT vec_id, label, round({_dist_sql('qv', 'embedding')}, 6) AS distance FROM embeddings, q ORDER BY distance, vec_id LIMIT 10""")
def _(spark, d):
    out = S.knn_topk(_ONE, I.table(spark, d, "embeddings"))
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@_q("vector_search", f"""WITH q AS (SELECT {_ONE}::DOUBLE[] AS qv) SELECT vec_id, label, round({_dist_sql('qv', 'embedding')}, 6) AS distance FROM embeddings, q WHERE label IN (1, 2) ORDER BY distance, vec_id LIMIT 10""")
def _(spark, d):
    out = S.vector_search(I.table(spark, d, "embeddings"), _ONE, 10, "label IN (1, 2)", vec_id="vec_id", vec="embedding")
    return out.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@_q("vector_search_batch", _knn_sql(10, "l2", "v.label = 1"))
def _(spark, d):
    out = S.vector_search_batch(I.table(spark, d, "embeddings"), _queries(spark, d), 10, "label = 1", vec_id="vec_id", vec="embedding")
    return _shown(out)


@_q("text_search")
def _(spark, d):
    """End to end: documents to chunks to search rows to vectors; then the nearest chunks of each question."""
    from pagevault.sources.tables import search_rows

    docs = I.docs(spark, d)
    chunks = C.chunk_docs(I.heavy(spark, d, "documents"), sep=I.SEP).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = S.embed_text(search_rows(chunks, docs.drop("doc_id")), "content")
    asked = I.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    questions = S.embed_text(asked, "text", mode="query")
    found = S.vector_search_batch(rows, questions, 5, "source LIKE 'src1%'")
    return found.select("query_id", "vec_id", "rank", F.round("distance", 6).alias("distance"))


@_q("header_items", f"WITH {I.DOCS_SQL} SELECT doc_id, 2::BIGINT AS n_items FROM docs")
def _(spark, d):
    docs = I.docs(spark, d)
    items = fn.items_concat(fn.chunk_header(title=F.col("title"), source=F.col("source")), F.array(fn.jsoncols.item("text", F.col("text"))))
    return docs.select("doc_id", F.size(items).cast("long").alias("n_items"))
