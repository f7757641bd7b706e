"""Spark helpers of the text operators: unique ids, sizes, written tables in the shared folder, broadcasts with a bound."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.llm import words as W
from pagevault.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, the folder that all executors share (a local one only in local mode)."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/t-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows of `df`, written once to the shared folder and read back: what follows does not compute them again."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_uid(docs: DataFrame, id_col: str, text_col: str, *more: str) -> tuple[DataFrame, bool]:
    """Columns _uid, _text and _in_<name> for the id and each of `more`; and whether _uid is the id.

    `_uid` is unique and ordered as the ids. Where ids are unique and not null it is the id itself. Else rows are numbered by
    (id with null first, text); equal rows are interchangeable, and the numbering is kept in the shared folder.
    """
    keep = [F.col(c).alias(f"_in_{c}") for c in dict.fromkeys((id_col, *more))]
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    key = F.col(f"_in_{id_col}")
    twice = docs.select(F.col(id_col).alias("k")).groupBy("k").count().filter("count > 1 or k is null")
    if dict(docs.dtypes)[id_col] in ("bigint", "int", "smallint", "tinyint") and twice.isEmpty():
        return rows.withColumn("_uid", key.cast("long")), True
    return written(rows.orderBy(key.asc_nulls_first(), "_text").withColumn("_uid", F.monotonically_increasing_id())), False


def text_bytes(docs: DataFrame, text_col: str = "_text") -> int:
    """Bytes of all texts: one narrow aggregate."""
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def buckets(total: int, each: int) -> int:
    """A power of two, so that each of so many equal parts of `total` bytes has at most about `each`."""
    return 1 << max(0, (max(total, 1) - 1) // each).bit_length()


def attach(docs: DataFrame, text_col: str, prepare: Callable, per_text: Callable, added: T.StructType, part: int) -> tuple[DataFrame, list[str]]:
    """All columns of `docs` and those of `added`, under names that `docs` does not have, which are returned as well:
    `per_text(prepare(), texts)` gives their Arrow arrays for some rows' texts.

    One pass without a shuffle, in parts of about `part` bytes of text; `prepare` runs once per task. Rows are independent.
    """
    names = [f"_c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    taken = {c.lower() for c in docs.columns}
    more = [next(n for k in range(len(taken) + 1) if (n := f"_{f.name}_{k}").lower() not in taken) for f in added]

    def run(batches):
        given = prepare()
        for whole in batches:
            for batch in W.slices(whole, text, part):
                values = per_text(given, batch[text])
                yield pa.RecordBatch.from_arrays([*batch.columns, *values], [*batch.schema.names, *(f"_a{i}" for i in range(len(values)))])

    fields = [T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)]
    fields += [T.StructField(f"_a{i}", f.dataType) for i, f in enumerate(added)]
    return docs.toDF(*names).mapInArrow(W.tidy(run), T.StructType(fields)).toDF(*docs.columns, *more), more
