"""From page snapshots to stored documents, chunks and search rows: one batch at a time, repeatable, without a table format.

The store is four logs of parquet files, `docs`, `chunks`, `search` and `deleted`, each with one folder per batch, and a levelled index by id and by
URL (`operators.keyindex`). A batch only writes its own folders (overwriting them when it is run again), so a lost executor or a repeated batch
leaves no duplicates. What a batch has to know of the store (key, id, time, block hashes) it looks up in the index, which reads only buckets
that may hold its keys: no stored text, and about the same number of bytes however large the store is. The current state is an
aggregate over the logs; `compact` writes it out as a new store.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from pagevault.functions import base_url
from pagevault.operators.chunks import BLANK_LINES, chunk_docs
from pagevault.operators.docs import latest_doc
from pagevault.operators.html import absolutize_links, content_fallbacks, main_content, parse_pages, strip_nodes, to_markdown
from pagevault.operators.keyindex import KeyIndex
from pagevault.operators.metadata import doc_from_page, page_metadata
from pagevault.operators.ordered import arrange, fill_forward
from pagevault.operators.search import EmbedFn, embed_text, word_bow
from pagevault.operators.versions import block_hashes, version_chain
from pagevault.session import shared_table
from pagevault.sources.tables import skip_empty, under_header, with_header

VALUE = "key string, ingested_at timestamp, hashes array<bigint>"
EVERY = 1 << 62  # after the last batch
EVEN_BYTES = 64 << 20  # of a batch's staged files, up to which it is dealt out anew into few files


def docs_from_pages(pages: DataFrame) -> DataFrame:
    """Page snapshots (page_id, url, html, ...) to documents with text and metadata: one parse, no shuffle."""
    described = page_metadata(parse_pages(pages))
    clean = absolutize_links(strip_nodes(described), base_url(F.col("url")))
    text = content_fallbacks(to_markdown(main_content(clean)))
    rows = text.withColumn("markdown", F.when(F.col("error").isNull(), F.col("markdown"))).drop("tokens", "starts", "body", "main")
    return doc_from_page(rows)


def key_index(spark: SparkSession, path: str) -> KeyIndex:
    """The index of a store. `i:` and an id leads to the document's key, `k:` and a key to the documents that have it."""
    return KeyIndex(spark, f"{path}/index", VALUE)


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    """A log with all its columns, or None before the first batch. Any other failure raises."""
    try:
        return spark.read.option("mergeSchema", True).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def current_docs(log: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The last written row of each document that was not deleted after it."""
    return _undeleted(latest_doc(log, "id", ["batch", "ingested_at"]), "id", deletes)


def current_chunks(doc_log: DataFrame, chunk_log: DataFrame, deletes: DataFrame | None = None) -> DataFrame:
    """The chunks (or search rows) of the batch that last wrote their document."""
    last = doc_log.groupBy(F.col("id").alias("doc_id")).agg(F.max("batch").alias("batch"))
    return chunk_log.join(_undeleted(last, "doc_id", deletes), ["doc_id", "batch"], "left_semi")


def _undeleted(rows: DataFrame, id_col: str, deletes: DataFrame | None) -> DataFrame:
    if deletes is None:
        return rows
    gone = deletes.groupBy(F.col("id").alias("_gone")).agg(F.max("batch").alias("_at"))
    return rows.join(gone, (F.col(id_col) == F.col("_gone")) & (F.col("batch") <= F.col("_at")), "left_anti")


def _keyed(docs: DataFrame, index: KeyIndex, batch: int) -> DataFrame:
    """Adds `_key`: what a document continues. A known id decides (the key of that document); else the URL; a document without
    URL goes by its id alone, so documents without URL never meet each other."""
    own = F.when(F.coalesce("url", F.lit("")) != "", F.concat(F.lit("u:"), F.col("url"))).otherwise(F.concat(F.lit("i:"), F.col("id")))
    first = docs.groupBy("id").agg(F.min_by(own, F.struct("ingested_at", own)).alias("_batch_key"))
    known = index.lookup(first.select(F.concat(F.lit("i:"), "id").alias("k")), batch)
    keys = first.join(known.select("id", F.col("key").alias("_stored_key")), "id", "left")
    return docs.join(keys.select("id", F.coalesce("_stored_key", "_batch_key").alias("_key")), "id")


def _entries(docs: DataFrame, deleted: bool) -> DataFrame:
    """Index entries of documents (id and VALUE): one by id, one by key."""
    by = lambda prefix, c: docs.select(F.concat(F.lit(prefix), F.col(c)).alias("k"), "id", "key", "ingested_at", "hashes", F.lit(deleted).alias("deleted"))
    return by("i:", "id").withColumn("hashes", F.lit(None).cast("array<bigint>")).unionByName(by("k:", "key"))


def store_batch(docs: DataFrame, path: str, batch: int, sep: str = BLANK_LINES, embed: EmbedFn = word_bow) -> None:
    """Store documents (id, url, ingested_at, text_content and any other columns), their chunks and their search rows.

    A document is compared with the stored one of its id, else with the newest of its URL: when the text is the same
    or overlaps enough it continues that document, else it is a new one (with a new id if its own is taken).
    """
    spark = docs.sparkSession
    # parsing pages is the costly part: do it once and work on the written rows from here on
    staging = f"{path}/staging"
    docs.withColumn("_row", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staging)  # one folder, overwritten by the next batch
    # (a filter on the text before it is written would make Spark compute the text once more for the filter)
    schema = StructType([*docs.schema, StructField("_row", LongType())])
    staged = spark.read.schema(schema).parquet(staging)
    large = _bytes(staged) > EVEN_BYTES
    incoming = skip_empty(staged, ["text_content"])
    index = key_index(spark, path)
    keyed = shared_table(_keyed(incoming.select("_row", "id", "url", "ingested_at"), index, batch).select("_row", "_key"))
    # texts stay where they are: hashes are made in the scan, and only they meet the keys
    hashed = incoming.select(
        "_row", "id", "ingested_at", F.xxhash64("id", "text_content").alias("_n"), block_hashes(F.col("text_content"), sep).alias("_hashes")
    )
    narrow = hashed.join(keyed, "_row").select(F.col("_key").alias("key"), "id", "ingested_at", "_n", "_row", "_hashes", F.lit(False).alias("_stored"))
    known = index.lookup(keyed.select(F.concat(F.lit("k:"), "_key").alias("k")), batch)
    newest = latest_doc(known, "key", ["ingested_at", "batch", "id"])
    zero = F.lit(0).cast("long")
    narrow = newest.select("key", "id", "ingested_at", zero.alias("_n"), zero.alias("_row"), F.col("hashes").alias("_hashes"), F.lit(True).alias("_stored")).unionByName(narrow)
    # stored rows first: a batch may bring older times; rows that are equal but for `_row` are interchangeable
    order = ["_last", "ingested_at", "id", "_n", "_row"]
    chained = version_chain(narrow.withColumn("_last", ~F.col("_stored")).withColumn("hashes", F.col("_hashes")), "key", order, "", sep, hashes="_hashes")
    # a chain's document id is that of its first row; one that an earlier chain has gets its time added
    taken = F.min("chain").over(Window.partitionBy("key", "id")) < F.col("chain")
    new_id = F.when(F.col("_taken"), F.concat_ws("@", "id", F.unix_micros("ingested_at").cast("string"))).otherwise(F.col("id"))
    starts = chained.withColumn("_taken", taken).withColumn("_start", F.when(~F.col("same_doc"), new_id))
    named = fill_forward(arrange(starts, ["key"], order), _doc_id=F.col("_start")).result()
    fresh = named.filter("not _stored").select("key", F.col("id").alias("_own"), "ingested_at", "_n", "_row", "_doc_id", "hashes")
    last = shared_table(latest_doc(fresh, "_doc_id", ["ingested_at", "_own", "_n", "_row"]))
    index.add(_entries(last.select("key", F.col("_doc_id").alias("id"), "ingested_at", "hashes"), False), batch)
    # one row of the batch for each document, so equal rows are stored once
    final = incoming.join(last.select("_row", "_doc_id"), "_row").withColumn("id", F.col("_doc_id")).select(*docs.columns)
    _write(final, f"{path}/docs", batch, large)
    written = spark.read.schema(docs.schema).parquet(f"{path}/docs/batch={batch}")
    # chunks and their search rows come from one pass over the documents, so neither has to meet them again in a join
    headed, scalars = with_header(written)
    pieces = chunk_docs(headed, sep, id_col="id", text="text_content", keep=[*scalars, "_header"])
    pieces.write.mode("overwrite").parquet(f"{path}/pieces")  # one folder, as staging
    pieces = spark.read.schema(pieces.schema).parquet(f"{path}/pieces")
    _write(pieces.drop(*scalars, "_header"), f"{path}/chunks", batch, large)
    _write(embed_text(under_header(pieces), "content", embed), f"{path}/search", batch, large)


def delete_docs(ids: DataFrame, path: str, batch: int) -> None:
    """Delete the documents with these ids (a column id) as a batch of its own: the index forgets them, and what was written before it counts no more.

    Unknown ids change nothing. An id that is stored again later is a new document.
    """
    spark = ids.sparkSession
    index = key_index(spark, path)
    known = index.lookup(ids.select(F.concat(F.lit("i:"), "id").alias("k")), batch)
    gone = shared_table(known.select("id", "key", "ingested_at", "hashes"))
    _write(gone.select("id"), f"{path}/deleted", batch)
    index.add(_entries(gone, True), batch)


def _bytes(read: DataFrame) -> int:
    """Bytes of the files that hold these rows."""
    files = read.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.sum("file_size")).first()[0] or 0


def _write(df: DataFrame, path: str, batch: int, large: bool = False) -> None:
    """Overwrite the folder of this batch. Rebalancing makes few files of a small batch; a large one has files of a fair size without that shuffle."""
    rows = df if large else df.hint("rebalance")
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the current state as a new store with one batch."""
    doc_log, deletes = read_log(spark, f"{path}/docs"), read_log(spark, f"{path}/deleted")
    for name in ("chunks", "search"):
        _write(current_chunks(doc_log, read_log(spark, f"{path}/{name}"), deletes).drop("batch"), f"{target}/{name}", 0)
    _write(current_docs(doc_log, deletes).drop("batch"), f"{target}/docs", 0)
    key_index(spark, target).add(shared_table(key_index(spark, path).everything(EVERY).drop("batch")), 0)
