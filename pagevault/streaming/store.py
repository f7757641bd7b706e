"""A stream of pages into the document store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagevault.operators.chunks import BLANK_LINES
from pagevault.plans.ingest import docs_from_pages, store_batch


def upsert_stream(pages: DataFrame, path: str, checkpoint: str, sep: str = BLANK_LINES, **trigger) -> StreamingQuery:
    """Every changed page (page_id, url, html, ingested_at) through the full store path, batch by batch.

    A batch writes only its own folders, so running it again after a failure changes nothing.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        docs = docs_from_pages(batch.select("page_id", "url", "html", "ingested_at")).drop("page_id")
        store_batch(docs, path, batch_id, sep)

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
