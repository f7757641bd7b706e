"""Look-ups, listings, updates and matches over stored documents and chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.operators.rows import first_of


def doc_by_id(df: DataFrame, value, col: str = "id") -> DataFrame:
    """The document with an id; an empty id gives no row. The equality reaches the parquet scan."""
    if value is None or value == "":
        return df.limit(0)
    return df.filter(F.col(col) == F.lit(value))


def docs_by_url(df: DataFrame, url: str | None, order: Sequence[str] = ("ingested_at", "id")) -> DataFrame:
    """All documents with exactly this URL, newest first."""
    if not url:
        return df.limit(0)
    return df.filter(F.col("url") == F.lit(url)).orderBy(*[F.desc(c) for c in order])


def url_exists(docs: DataFrame, urls: DataFrame) -> DataFrame:
    """Each asked URL with whether some document has it."""
    seen = docs.filter(F.col("url").isNotNull()).select("url").distinct().withColumn("_seen", F.lit(True))
    return urls.join(seen, "url", "left").withColumn("url_exists", F.coalesce("_seen", F.lit(False))).drop("_seen")


def filter_source(df: DataFrame, source: str | None = None, location: str | None = None) -> DataFrame:
    if source:
        df = df.filter(F.col("source") == source)
    if location:
        df = df.filter(F.col("source_location_identifier") == location)
    return df


def list_docs(
    df: DataFrame,
    source: str | None = None,
    location: str | None = None,
    limit: int = 100,
    offset: int = 0,
    order: Sequence[str] = ("ingested_at", "id"),
) -> DataFrame:
    """A page of the newest documents (a distributed top-k, then an offset)."""
    return filter_source(df, source, location).orderBy(*[F.desc(c) for c in order]).offset(offset).limit(limit)


def search_filter(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(F.expr(predicate))


def distinct_urls(df: DataFrame, source: str | None = None) -> DataFrame:
    return filter_source(df, source).select("url").dropna().distinct()


def seen_urls_anti(new: DataFrame, docs: DataFrame, source: str | None = None) -> DataFrame:
    """New pages whose URL no stored document has. Seen URLs are made distinct before the join."""
    return new.join(distinct_urls(docs, source), "url", "left_anti")


def table_counts(docs: DataFrame, chunks: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per table with its number of rows."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in (("docs", docs), ("chunks", chunks), ("search_rows", rows))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def latest_doc(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest row of each key with all its columns; `order` must be unique in a key.

    Spark keeps one row per key and task before the shuffle (a window group limit), so one key with a third of all rows
    costs no more than any other, and only those rows are sorted after it.
    """
    return first_of(df, [key], [F.desc(c) for c in order])


def update_docs(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with those of `incoming` put in place of equal keys, every column, NULL included.

    Incoming keys must be unique (see `latest_doc`); keys that are not stored are ignored, as an UPDATE does.
    """
    new = incoming.select(F.col(key), F.struct(*[F.col(c) for c in stored.columns]).alias("_new"))
    joined = stored.select(F.col(key), F.struct(*stored.columns).alias("_old")).join(new, key, "left")
    return joined.select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")


def delete_doc_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def match_existing(incoming: DataFrame, docs: DataFrame) -> DataFrame:
    """Incoming documents with the id of the stored document they meet: by id first, else the newest by URL.

    Adds `match_id` and `match_by` ('id', 'url' or NULL). The stored side is one row per id and, for URLs, one row
    per URL from a pre-aggregated maximum, so neither join can multiply rows.
    """
    by_id = docs.select(F.col("id").alias("_id")).distinct()
    by_url = (
        docs.filter(F.col("url").isNotNull())
        .groupBy("url")
        .agg(F.max_by("id", F.struct("ingested_at", "id")).alias("_url_id"))
    )
    out = incoming.join(by_id, incoming["id"] == by_id["_id"], "left").join(by_url, "url", "left")
    return out.select(
        *[incoming[c] if c != "url" else F.col("url") for c in incoming.columns],
        F.coalesce("_id", "_url_id").alias("match_id"),
        F.when(F.col("_id").isNotNull(), F.lit("id")).when(F.col("_url_id").isNotNull(), F.lit("url")).alias("match_by"),
    )


def chunk_doc_join(chunks: DataFrame, docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks with the scalars of their document (AQE picks a broadcast from measured sizes, splits skew)."""
    return chunks.join(docs, key)


def chunks_equal(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Per document: do both sides hold the same chunks (number, index, content)?

    One union and two grouped aggregates with map-side partials instead of a full outer join: each side
    contributes a signed count per (document, index, content), and a document is equal when all counts cancel out.
    """
    cols = ["doc_id", "chunk_index", "content"]
    both = stored.select(*cols, F.lit(1).alias("_side")).unionByName(new.select(*cols, F.lit(-1).alias("_side")))
    per_chunk = both.groupBy(*cols).agg(F.sum("_side").alias("_balance"))
    return per_chunk.groupBy("doc_id").agg((F.max(F.abs("_balance")) == 0).alias("chunks_equal"))


def nearest_candidates(df: DataFrame, key: str, prio: str, pos: str, text: str = "text") -> DataFrame:
    """Per key the text with the lowest priority number, then the earliest position."""
    return df.groupBy(key).agg(F.min_by(text, F.struct(prio, pos)).alias(text))


def element_histogram(elements: DataFrame, kind: str = "tag") -> DataFrame:
    return elements.groupBy(kind).agg(F.count(F.lit(1)).alias("n_elements"))
