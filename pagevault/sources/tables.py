"""Reading, shaping and writing the stored tables: documents, chunks, search rows, page snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from pagevault import schemas
from pagevault.functions import chunk_header, from_wkt, items_concat, json_or_default, to_wkt
from pagevault.functions.jsoncols import ITEMS_TYPE
from pagevault.operators.docs import delete_doc_chunks, update_docs
from pagevault.operators.rows import explode_once
from pagevault.session import delete_file, shared_table


def read_docs(spark: SparkSession, path: str, schema=schemas.PLAIN_DOC, transient: tuple[str, ...] = ("text",)) -> DataFrame:
    """Stored documents with a declared schema, without the transient text column (never read from disk)."""
    return spark.read.schema(schema).parquet(path).drop(*transient)


def read_pages(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Page snapshots with an http(s) URL, as a table or (from a folder) as a stream."""
    reader = spark.readStream if stream else spark.read
    return filter_http(reader.schema(schemas.PAGE).parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """A table that is read in fewer tasks than the cluster has cores, dealt out to all cores before costly per-row work.

    Larger inputs stay as they are read: no shuffle, no list of files. Streams stay as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def filter_http(df: DataFrame, col: str = "url") -> DataFrame:
    return df.filter(F.col(col).startswith("http://") | F.col(col).startswith("https://"))


def skip_empty(df: DataFrame, cols: list[str]) -> DataFrame:
    """Drop rows where any of the columns is NULL or empty."""
    for c in cols:
        df = df.filter(F.col(c).isNotNull() & (F.col(c) != ""))
    return df


def project_except(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def base_fields(df: DataFrame) -> DataFrame:
    """The shared scalar fields, NULL where the input lacks one."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in schemas.BASE_FIELDS])


def prepare_docs(df: DataFrame, now: Column) -> DataFrame:
    """Documents in storage form: times set, empty arrays NULL, JSON columns as text, point as WKT, known columns only."""
    have = set(df.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None)

    out: dict[str, Column] = {"id": col("id").cast("string")}
    for c in schemas.DOC_FIELDS[1:]:
        if c == "ingested_at":
            out[c] = F.coalesce(col(c).cast("timestamp"), now)
        elif c == "created_at":
            out[c] = col(c).cast("timestamp")
        elif c == "last_updated":
            out[c] = now
        elif c in schemas.ARRAY_FIELDS:
            arr = col(c).cast("array<string>")
            out[c] = F.when(F.size(arr) > 0, arr)
        elif c in schemas.JSON_FIELDS:
            default = F.lit(schemas.JSON_FIELDS[c])
            out[c] = default if c not in have else F.coalesce(F.when(F.size(c) > 0, F.to_json(c)), default)
        elif c == "geolocation":
            out[c] = to_wkt(F.col(c)["lon"], F.col(c)["lat"]) if c in have else F.lit(None).cast("string")
        else:
            out[c] = col(c).cast("string")
    return df.select(*[e.alias(n) for n, e in out.items()])


def decode_docs(df: DataFrame) -> DataFrame:
    """The inverse: NULL arrays to empty ones, JSON text to values (default on errors), WKT to STRUCT(lon, lat)."""
    have = set(df.columns)
    out = {}
    for c in schemas.ARRAY_FIELDS:
        if c in have:
            out[c] = F.coalesce(F.col(c), F.array().cast("array<string>"))
    for c, kind in schemas.JSON_TYPES.items():
        if c in have:
            empty = F.create_map() if kind.startswith("map") else F.array()
            out[c] = json_or_default(F.col(c), kind, empty.cast(kind))
    if "geolocation" in have:
        out["geolocation"] = from_wkt(F.col("geolocation"))
    return df.withColumns(out)


def prepare_chunks(df: DataFrame) -> DataFrame:
    """Chunk content as JSON text, `[]` when empty."""
    return df.withColumn("content", F.coalesce(F.when(F.size("content") > 0, F.to_json("content")), F.lit("[]")))


def decode_chunks(df: DataFrame) -> DataFrame:
    """Chunk JSON to an array of items; bad or empty text to an empty array."""
    return df.withColumn("content", json_or_default(F.col("content"), ITEMS_TYPE, F.array().cast(ITEMS_TYPE)))


def with_header(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """Documents with `_header`, the header items of their chunks, and the names of their scalars."""
    have = set(docs.columns)
    parts = {
        c: F.col(c)
        for c in (
            "title", "description", "source", "url", "contact_name", "contact_identifier", "participant_names",
            "source_location_name", "keywords", "metadata",
        )
        if c in have
    }
    return docs.withColumn("_header", chunk_header(**parts)), [c for c in schemas.BASE_FIELDS if c in have]


def under_header(chunks: DataFrame) -> DataFrame:
    """content = JSON of `_header` and items."""
    items = items_concat(F.col("_header"), F.col("content")).alias("content")
    return chunks.withColumn("content", F.to_json(F.struct(items))).drop("_header")


def search_rows(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks joined with the scalars of their document; content = JSON of header and items.

    A plain equi-join on the document id: Spark broadcasts the documents when it measures them small and
    splits skewed partitions otherwise. The header is built on the document side, once per document.
    """
    headed, scalars = with_header(docs)
    return under_header(chunks.join(headed.select(F.col("id").alias("doc_id"), *scalars, "_header"), "doc_id"))


BUCKETS = 64  # folders of stored chunks


def _keyed_writer(rows: DataFrame, *keys: str) -> DataFrameWriter:
    """A Parquet writer that keeps a Bloom filter of each key column per row group, so that a look-up of one value skips nearly all of them."""
    writer = rows.write.option("parquet.bloom.filter.adaptive.enabled", True)
    for k in keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", True)
    return writer


def write_docs(df: DataFrame, path: str, mode: str = "append") -> None:
    """Documents partitioned by their source and sorted by id in it, with Bloom filters of ids and URLs."""
    keys = [c for c in ("id", "url") if c in df.columns]
    rows = df.sortWithinPartitions("source", *keys[:1])
    _keyed_writer(rows, *keys).mode(mode).partitionBy("source").parquet(path)


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))


def write_chunks(df: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Chunks in folders by a hash of the document id, so that an update rewrites only the touched folders, sorted by document, with Bloom filters.

    Rebalancing by folder keeps the files few; a folder made large by one document is split over tasks.
    """
    rows = _bucketed(df, buckets).hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "doc_id")
    _keyed_writer(rows, *[c for c in ("id", "doc_id") if c in df.columns]).mode(mode).partitionBy("bucket").parquet(path)


def write_search_rows(df: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    write_chunks(df, path, mode, buckets)


def update_written_docs(path: str, incoming: DataFrame, key: str = "id") -> None:
    """`update_docs` on documents that `write_docs` wrote: only the folders of sources that lose or get a row are written anew.

    A run that fails can be repeated. Incoming rows with an unknown key are ignored.
    """
    spark = incoming.sparkSession
    stored = spark.read.parquet(path)
    met = incoming.join(stored.select(key, F.col("source").alias("_was")), key)
    touched = [r[0] for r in met.select(F.explode(F.array("_was", "source"))).distinct().collect()]  # names of folders
    if touched:
        of = F.coalesce(F.col("source"), F.lit("")).isin([t or "" for t in touched])
        _rewrite(path, "source", stored.filter(of), update_docs(stored.filter(of), incoming, key), ("id", "url"))


def delete_written_chunks(path: str, ids: DataFrame, buckets: int = BUCKETS) -> None:
    """`delete_doc_chunks` on chunks or search rows that `write_chunks` wrote: only the folders that hold these documents are written anew."""
    spark = ids.sparkSession
    touched = [r[0] for r in _bucketed(ids.select("doc_id"), buckets).select("bucket").distinct().collect()]  # at most `buckets`
    if touched:
        stored = spark.read.parquet(path).filter(F.col("bucket").isin(touched))
        _rewrite(path, "bucket", stored, delete_doc_chunks(stored, ids), ("id", "doc_id"))


def _rewrite(path: str, part: str, old: DataFrame, new: DataFrame, keys: Sequence[str]) -> None:
    """Put `new` in place of `old`, all rows of some folders of `path`; other files stay as they are."""
    new = shared_table(new)
    left = new.select(part).distinct()
    emptied = old.select(part, "_metadata.file_path").distinct().join(left, old[part].eqNullSafe(left[part]), "left_anti")
    files = [r[0] for r in emptied.select("file_path").collect()]  # of folders that hold nothing any more
    rows = new.hint("rebalance", F.col(part)).sortWithinPartitions(part, *[k for k in keys if k in new.columns][-1:])
    writer = _keyed_writer(rows, *[k for k in keys if k in new.columns]).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(part).parquet(path)
    for f in files:
        delete_file(new.sparkSession, f)


def export_pages(texts: DataFrame, pages: DataFrame, path: str) -> None:
    """The Markdown of pages (`texts`: slug, markdown) under md and their HTML (`pages`: slug, html) under html: rows of slug and value
    in files of even size, sorted by slug, so that one page is found by the statistics of its file. Two tables, so that
    exporting the HTML does not convert the pages again."""
    for rows, col, sub in ((texts, "markdown", "md"), (pages, "html", "html")):
        # (a filter on the text would make Spark convert the page once more for the filter)
        written = F.filter(F.array(F.col(col)), lambda v: v.isNotNull() & (v != ""))
        even = explode_once(rows, written, "slug", item="value").select("slug", "value").hint("rebalance").sortWithinPartitions("slug")
        even.write.mode("overwrite").parquet(f"{path}/{sub}")


def adhoc_sql(spark: SparkSession, views: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """Any SQL over the given tables."""
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
