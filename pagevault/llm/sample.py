"""Bounded samples of labelled texts, for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 4000  # rows of a fit
WINDOW = 1 << 15  # code points of a text in a fit; texts are scored whole


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; a null id counts as ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def window_of(text: Column, size: int = WINDOW) -> Column:
    """The text, or of a longer one `size` code points from a place that its hash gives."""
    start = F.pmod(F.xxhash64(text), F.greatest(F.length(text) - size, F.lit(0)) + 1) + 1
    return F.when(F.length(text) > size, F.substr(text, start.cast("int"), F.lit(size))).otherwise(text)


def fitted(rows: DataFrame, train: Callable[[list[tuple]], dict]) -> dict:
    """`train` of the rows of a bounded sample, sorted by their columns. It runs in one task, so that the driver only gets the model."""

    def run(batches):
        given = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(train(given))], pa.binary())})

    models = rows.repartition(1).sortWithinPartitions(*rows.columns).mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0].model) if models else train([])


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """id, text and label of at most `most` rows whose id satisfies `learn`, chosen by a hash of the id; of longer texts a window."""
    known = labels.filter(learn & F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label).alias("_label"))
    every = -(-known.count() // most) or 1
    picked = known.filter(F.pmod(F.xxhash64(id_col), F.lit(every)) == 0).orderBy(F.xxhash64(id_col), id_col).limit(most)
    texts = docs.select(F.col(id_col), F.col(text_col).alias("_text")).filter(F.col("_text").isNotNull() & F.col(id_col).isNotNull())
    rows = texts.join(F.broadcast(picked), id_col)  # at most `most` short rows
    rows = rows.select(id_col, window_of(F.col("_text")).alias("_text"), "_label")
    return rows.groupBy(id_col).agg(F.min("_text").alias("_text"), F.first("_label").cast("int").alias("_label"))
