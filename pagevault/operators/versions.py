"""Re-visits of a page: how much of a new version was already there, and which versions form one document.

The stored text of a URL after any visit is the text of that visit (the merged text is always the new one), so
version n is compared with version n-1 only: one look-back along each URL and one running sum.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions import fixed
from pagevault.functions.text import has_text, strip, strip_part
from pagevault.operators.ordered import Arranged, arrange, running_sum, shift

BLANK_LINES = r"\n\n+"
FEW = 1 << 12  # pairs of blocks up to which lists are compared in plain Python


def blocks(text: Column, sep: str = BLANK_LINES) -> Column:
    """Non-blank blocks of a text, as written."""
    return F.filter(F.split(strip(text), sep), has_text)


def block_hashes(text: Column, sep: str = BLANK_LINES) -> Column:
    """64-bit hashes of the stripped blocks: all that comparing versions needs, at a fraction of the text's size."""
    return F.transform(blocks(text, sep), lambda b: F.xxhash64(strip_part(b)))


class _Windows:
    """Numbers of equal windows of any length over two sequences: ranks for lengths that are powers of two, made when they are needed."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.shift = len(old)
        joined = np.concatenate((old, new))
        self.levels = [np.unique(joined, return_inverse=True)[1].astype(np.int64)]
        self.n = max(len(joined), 1)

    def _at(self, place: np.ndarray, length: int) -> np.ndarray:
        k = length.bit_length() - 1
        while len(self.levels) <= k:
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.unique(last[:-half] * self.n + last[half:], return_inverse=True)[1].astype(np.int64))
        ranks = self.levels[k]
        return ranks[place] * self.n + ranks[place + length - (1 << k)]

    def old(self, a: int, b: int, length: int) -> np.ndarray:
        """Numbers of the windows of `length` in old[a:b]."""
        return self._at(np.arange(a, b - length + 1), length)

    def new(self, c: int, d: int, length: int) -> np.ndarray:
        return self._at(np.arange(c, d - length + 1) + self.shift, length)


def _longest(windows: _Windows, a: int, b: int, c: int, d: int, most: int) -> int:
    """Length of the longest common run of old[a:b] and new[c:d]; at most `most`. Doubling, then halving."""

    def common(length: int) -> bool:
        return bool(np.isin(windows.old(a, b, length), windows.new(c, d, length)).any())

    most = min(most, b - a, d - c)
    low, high = 0, 1
    while high <= most and common(high):
        low, high = high, high * 2
    high = min(high, most + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if common(middle) else (low, middle)
    return low


def _matched_few(old: list, new: list) -> int:
    """matched_blocks for short lists: common runs grow along the places of each block in new, kept in a dict."""
    places: dict[int, list[int]] = {}
    for j, value in enumerate(new):
        places.setdefault(value, []).append(j)
    open_, total = [(0, len(old), 0, len(new))], 0
    while open_:
        a, b, c, d = open_.pop()
        length, first_old, first_new, before = 0, a, c, {}
        for i in range(a, b):
            ends = {}
            for j in places.get(old[i], ()):
                if c <= j < d:
                    ends[j] = run = before.get(j - 1, 0) + 1
                    if run > length:
                        length, first_old, first_new = run, i + 1 - run, j + 1 - run
            before = ends
        if length:
            total += length
            open_ += [r for r in ((a, first_old, c, first_new), (first_old + length, b, first_new + length, d)) if r[0] < r[1] and r[2] < r[3]]
    return total


def matched_blocks(old: np.ndarray, new: np.ndarray) -> int:
    """Blocks matched by taking the longest common run (of equally long ones the first in old, then in new), then the same on either side of it.

    Left of the run that is taken none of its length is left, and right of it the next one of that length is the next that is found going on to the
    right in both. So one sweep takes all runs of one length, and what lies between them is open for shorter ones: the work is about
    n log n for each length that occurs among the runs of a place, not for each run.
    """
    if len(old) * len(new) <= FEW:
        return _matched_few(old.tolist(), new.tolist())
    windows, total = _Windows(old, new), 0
    open_ = [(0, len(old), 0, len(new), min(len(old), len(new)))]
    while open_:
        a, b, c, d, most = open_.pop()
        length = _longest(windows, a, b, c, d, most) if a < b and c < d and most else 0
        if not length:
            continue
        ids_old, ids_new = windows.old(a, b, length), windows.new(c, d, length)
        places: dict[int, list[int]] = {}
        for j in np.flatnonzero(np.isin(ids_new, ids_old)).tolist():
            places.setdefault(int(ids_new[j]), []).append(c + j)
        free, j = a, c  # what is still open begins here
        for i in (np.flatnonzero(np.isin(ids_old, ids_new)) + a).tolist():
            if i < free:
                continue
            found = places[int(ids_old[i - a])]
            k = bisect.bisect_left(found, j)
            if k < len(found):
                total += length
                open_.append((free, i, j, found[k], length - 1))
                free, j = i + length, found[k] + length
        open_.append((free, b, j, d, length - 1))
    return total


def _shrunk(values: np.ndarray, other: np.ndarray, mark: int) -> np.ndarray:
    """Stretches of values that the other side lacks, as one mark each."""
    known = np.isin(values, other)
    keep = known.copy()
    keep[1:] |= known[:-1]
    keep[:1] = True
    return np.where(known, values, mark)[keep]


def _ratios(old: pd.Series, new: pd.Series) -> pd.Series:
    def ratio(o, n) -> float | None:
        if o is None or n is None or len(n) == 0:
            return None
        if len(o) * len(n) <= FEW:
            return _matched_few(o.tolist(), n.tolist()) / len(n)
        # ranks from 0, so that the marks below occur on neither side
        _, ranks = np.unique(np.concatenate((o, n)), return_inverse=True)
        a, b = ranks[: len(o)], ranks[len(o) :]
        return matched_blocks(_shrunk(a, b, -1), _shrunk(b, a, -2)) / len(n)

    return pd.Series([ratio(o, n) for o, n in zip(old, new, strict=True)], dtype="float64")


_ratio_udf = F.pandas_udf(_ratios, T.DoubleType())


def match_ratio(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Adds `match_ratio` for two columns of block hashes: matched blocks / new blocks, longest runs first."""
    return pairs.withColumn("match_ratio", _ratio_udf(F.col(old), F.col(new)))


def _compared(
    df: DataFrame, key: Sequence[str], order: Sequence[str], text: str, sep: str, sliced: bool, hashes: str | None = None
) -> Arranged:
    rows = df if hashes else df.withColumn("_h", block_hashes(F.col(text), sep))
    rows = rows.withColumnRenamed(hashes, "_h") if hashes else rows
    return shift(arrange(rows, key, order, sliced), _old=(F.coalesce("_h", F.array().cast("array<bigint>")), 1))


def version_chain(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    text: str,
    sep: str = BLANK_LINES,
    min_ratio: float = fixed.MIN_MATCH_RATIO,
    sliced: bool = False,
    hashes: str | None = None,
) -> DataFrame:
    """Adds `same_doc` and `chain` (0, 1, ...): a visit stays in the document of the visit before when their blocks
    are identical or enough of the new ones match, else it starts a new document.

    Pairs without common blocks and identical pairs are decided by built-in expressions; the rest goes through one
    Arrow function that sees hashes only. With `hashes`, that column holds the hashes of the blocks (it is
    dropped) and no text is needed.
    """
    a = _compared(df, [key], order, text, sep, sliced, hashes)
    same = F.col("_h") == F.col("_old")
    undecided = F.col("_old").isNotNull() & ~same & F.arrays_overlap("_h", "_old")
    ratio = _ratio_udf(F.when(undecided, F.col("_old")), F.when(undecided, F.col("_h")))
    a = a.having(a.df.withColumn("_ratio", ratio))
    a = a.having(
        a.df.withColumn(
            "same_doc",
            F.when(F.col("_old").isNull(), F.lit(False)).otherwise(
                F.coalesce(same, F.lit(False)) | F.coalesce(F.col("_ratio") >= min_ratio, F.lit(False))
            ),
        )
    )
    a = running_sum(a, chain=F.when(F.col("same_doc"), 0).otherwise(1).cast("long"))
    return a.result().withColumn("chain", F.col("chain") - 1).drop("_h", "_old", "_ratio")


def merge_state(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    text: str,
    sep: str = BLANK_LINES,
    sliced: bool = False,
) -> DataFrame:
    """`version_chain` plus the outcome of the merge with the version before: `merge_type` and `content`.

    MERGED: the new blocks joined by blank lines. KEPT_NEW: the new text as it is. KEPT_EMPTY: the new text is blank.
    """
    out = version_chain(df, key, order, text, sep, sliced=sliced)
    blank = F.col(text).isNull() | (strip(F.col(text)) == "")
    kind = F.when(blank, F.lit("KEPT_EMPTY")).when(F.col("same_doc"), F.lit("MERGED")).otherwise(F.lit("KEPT_NEW"))
    content = (
        F.when(kind == "MERGED", F.array_join(blocks(F.col(text), sep), "\n\n"))
        .when(kind == "KEPT_NEW", F.col(text))
        .when(F.col(text) == "", F.lit(""))
    )
    return out.withColumns({"merge_type": kind, "content": content})


def bag_overlap(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    text: str,
    sep: str = BLANK_LINES,
    sliced: bool = False,
) -> DataFrame:
    """For each visit after the first: share of its blocks that the visit before holds, as a multiset.

    An upper bound of the match ratio. The two block lists sit in one row after the look-back, so each row counts
    its own blocks: explode, count per (row, block) with partial sums, and sum the smaller counts.
    """
    a = _compared(df, [key], order, text, sep, sliced)
    pairs = a.result().filter("_old is not null").select(key, *order, "_h", "_old")
    ids = [key, *order]
    n_new = F.size("_h")
    both = pairs.select(
        *ids,
        n_new.alias("_n"),
        F.explode_outer(
            F.concat(
                F.transform("_h", lambda h: F.struct(h.alias("b"), F.lit(1).alias("new"), F.lit(0).alias("old"))),
                F.transform("_old", lambda h: F.struct(h.alias("b"), F.lit(0).alias("new"), F.lit(1).alias("old"))),
            )
        ).alias("e"),
    )
    counts = both.groupBy(*ids, "_n", "e.b").agg(F.sum("e.new").alias("_new"), F.sum("e.old").alias("_old"))
    return counts.groupBy(*ids).agg(
        F.coalesce(F.sum(F.least(F.coalesce("_new", F.lit(0)), F.coalesce("_old", F.lit(0)))), F.lit(0)).alias("n_common"),
        F.max("_n").cast("long").alias("n_new"),
    ).withColumn(
        "bag_overlap",
        F.when(F.col("n_new") > 0, F.col("n_common") / F.col("n_new")).otherwise(F.lit(0.0)),
    )
