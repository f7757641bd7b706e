"""Turning arrays into rows, and rows into portions of a bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explode_once(df: DataFrame, values: Column | str, *keep: Column | str, pos: str = "_pos", item: str = "_item") -> DataFrame:
    """The kept columns and one row per element, with its position (from 0).

    For a plain explode Spark infers the filter `size(values) > 0` and pushes it down, which computes a costly
    array twice and possibly below a repartition; an outer explode followed by a test of the position does not.
    """
    return df.select(*keep, F.posexplode_outer(values).alias(pos, item)).filter(F.col(pos).isNotNull())


RULE_BYTES = 1 << 20  # of rules in one packed row, about


def rule_blocks(rules: DataFrame, text: str, limit: int = RULE_BYTES) -> list[DataFrame]:
    """The rules in parts of about `limit` bytes of `text` each (one part in the usual case), dealt out by hash."""
    size = rules.agg(F.sum(F.octet_length(text) + 64)).first()[0] or 0
    n = -(-size // limit)
    part = F.pmod(F.xxhash64(text), F.lit(n))
    return [rules.filter(part == k) for k in range(n)] if n > 1 else [rules] * n


def first_of(df: DataFrame, key: list, order: list) -> DataFrame:
    """The first row of each key in the given order, which must be unique in a key."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def portions(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to `limit` at most, or of one larger row."""
    ends, begin = np.cumsum(sizes, dtype=np.int64), 0
    while begin < len(ends):
        before = int(ends[begin - 1]) if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield begin, end
        begin = end
