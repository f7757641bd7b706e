"""Removal of passages that occur earlier, by difference-cover anchors.

A set D of residues modulo P is a difference cover if every difference modulo P occurs in it. Then for any two positions
there is a shift below P that takes both to positions whose residues lie in D. So two equal runs of WINDOW words always
share an *anchor*, an equal run of WINDOW - P + 1 words that begins at cover positions of both texts, at the same place of
either run. Only the windows at cover positions (4 of 13) are hashed and dealt out. Texts whose anchors occur nowhere else are
done. Around shared anchors the runs are extended to whole windows, whose 96-bit hashes decide which came first.

Every exchange carries packed arrays, one row per part and bucket. What a part can settle alone, it settles before the
exchange: an anchor that it has twice is shared, a window that it has twice needs only its first place. So a passage that
millions of texts have costs one entry per part, and no bucket sees a group of copies whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.frames import buckets, text_bytes, with_uid

WINDOW = 20
# fixed values: a perfect difference set modulo 13
PERIOD, COVER = 13, (0, 1, 3, 9)
PART = 8 << 20  # bytes of text that one part or bucket holds, about

_ENTRIES = "bucket long, known boolean, h1 binary, h2 binary, doc binary, at binary"
_PLACES = "bucket long, doc binary, at binary"


def _texts(batch: pa.RecordBatch | pa.Table):
    data, offs = W.utf8(batch["_text"])
    starts, ends, doc = W.spans(data, offs, W.NOT_SPACE)
    return data, starts, ends, doc, batch["_uid"].to_numpy(zero_copy_only=False) if batch.num_rows else np.zeros(0, np.int64)


# fixed values: the primes of xxHash64, and the seed that Spark's function has
_XXH64 = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_SEED = 42
NEAR = 6  # bits


def _first_of_runs(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys: is this the first of its run of equal keys?"""
    new = np.ones(len(keys[0]), bool)
    if len(new) > 1:
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def _batch(known: bool, packed: dict, schema) -> pa.RecordBatch:
    n = len(packed["bucket"])
    none = pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [packed["bucket"], pa.array([known] * n, pa.bool_()), *(packed.get(c, none) for c in ("h1", "h2", "doc", "at"))], schema=schema
    )


_ENTRY_SCHEMA = pa.schema([("bucket", pa.int64()), ("known", pa.bool_()), *((c, pa.binary()) for c in ("h1", "h2", "doc", "at"))])
_PLACE_SCHEMA = pa.schema([("bucket", pa.int64()), ("doc", pa.binary()), ("at", pa.binary())])


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    return (h >> np.uint64(20)).astype(np.int64) & (n - 1)


def _home(doc: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a text by a hash of its id, NEAR neighbouring ids together (their places pack well); the same numbers as `_home_column`."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _XXH64)
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    h = (np.uint64(_SEED) + p5 + np.uint64(8)) ^ (turn((doc >> NEAR).astype(np.uint64) * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return ((h ^ (h >> np.uint64(32))) & np.uint64(n - 1)).astype(np.int64)


def _home_column(n: int):
    return F.pmod(F.xxhash64(F.shiftright("_uid", NEAR)), F.lit(n))


def _anchors(n: int, window: int):
    width = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches):
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                data, starts, ends, doc, uid = _texts(batch)
                count, _, at = W.within(doc, batch.num_rows)
                pick = np.flatnonzero(cover[at % PERIOD] & (at + width <= count[doc]))
                h = W.window_hashes(W.word_hashes(data, starts, ends), pick, width)
                order = np.argsort(h, kind="stable")
                h, pick = h[order], pick[order]
                first = _first_of_runs(h)
                alone = first & np.append(first[1:], True)
                d, p = uid[doc[pick]], at[pick].astype(np.uint32)
                some = ~alone  # this part has them twice: shared, whatever others have
                yield _batch(True, W.pack(_home(d[some], n), doc=d[some], at=p[some]), _ENTRY_SCHEMA)
                yield _batch(False, W.pack(_bucket(h[first], n), h1=h[first], doc=d[first], at=p[first]), _ENTRY_SCHEMA)

    return run


def _shared(n: int):
    """Bucket of anchors -> places of the anchors that occur twice."""

    def run(t: pa.Table) -> pa.Table:
        known = t["known"].to_numpy(zero_copy_only=False).astype(bool)
        fresh, sure = t.filter(pa.array(~known)), t.filter(pa.array(known))
        h, d, p = W.unpack(fresh["h1"], np.uint64), W.unpack(fresh["doc"], np.int64), W.unpack(fresh["at"], np.uint32)
        order = np.argsort(h)
        first = _first_of_runs(h[order])
        pick = order[~(first & np.append(first[1:], True))] if len(h) else order
        d = np.concatenate((d[pick], W.unpack(sure["doc"], np.int64)))
        p = np.concatenate((p[pick], W.unpack(sure["at"], np.uint32)))
        order = np.lexsort((p, d))
        packed = W.pack(_home(d[order], n), doc=d[order], at=p[order])
        return pa.Table.from_arrays(list(packed.values()), schema=_PLACE_SCHEMA)

    return run


def _rows_of(places: pa.Table, order_of_uid: np.ndarray, uid_sorted: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Word numbers of places (text, word of the text)."""
    d, p = W.unpack(places["doc"], np.int64), W.unpack(places["at"], np.uint32)
    return first[order_of_uid[np.searchsorted(uid_sorted, d)]] + p


def _windows(n: int, window: int):
    """Texts of a bucket and the shared anchors in them -> the windows that contain one at a place that a cover shift allows."""

    def run(key, texts: pa.Table, places: pa.Table) -> pa.Table:
        if places.num_rows == 0:
            return pa.Table.from_batches([], _ENTRY_SCHEMA)
        data, starts, ends, doc, uid = _texts(texts)
        count, first, at = W.within(doc, texts.num_rows)
        by_uid = np.argsort(uid)
        anchor = _rows_of(places, by_uid, uid[by_uid], first)
        # a window begins 0 to PERIOD - 1 words before its anchor
        low = np.maximum(first[doc[anchor]], anchor - (PERIOD - 1))
        edge = np.zeros(len(doc) + 1, np.int64)
        np.add.at(edge, low, 1)
        np.add.at(edge, anchor + 1, -1)
        start = np.flatnonzero((np.cumsum(edge[:-1]) > 0) & (at + window <= count[doc]))
        h1 = W.window_hashes(W.word_hashes(data, starts, ends, 0), start, window, 0)
        h2 = W.window_hashes(W.word_hashes(data, starts, ends, 1), start, window, 1).astype(np.uint32)
        d, p = uid[doc[start]], at[start].astype(np.uint32)
        order = np.lexsort((p, d, h2, h1))
        h1, h2, d, p = h1[order], h2[order], d[order], p[order]
        new = _first_of_runs(h1, h2)
        late = ~new  # not the first even here
        sure = _batch(True, W.pack(_home(d[late], n), doc=d[late], at=p[late]), _ENTRY_SCHEMA)
        rest = _batch(False, W.pack(_bucket(h1[new], n), h1=h1[new], h2=h2[new], doc=d[new], at=p[new]), _ENTRY_SCHEMA)
        return pa.Table.from_batches([sure, rest])

    return run


def _later(n: int):
    """Bucket of windows -> places of all but the first of each."""

    def run(t: pa.Table) -> pa.Table:
        known = t["known"].to_numpy(zero_copy_only=False).astype(bool)
        fresh, sure = t.filter(pa.array(~known)), t.filter(pa.array(known))
        h1, h2 = W.unpack(fresh["h1"], np.uint64), W.unpack(fresh["h2"], np.uint32)
        d, p = W.unpack(fresh["doc"], np.int64), W.unpack(fresh["at"], np.uint32)
        order = np.lexsort((p, d, h2, h1))
        late = order[~_first_of_runs(h1[order], h2[order])] if len(order) else order
        d = np.concatenate((d[late], W.unpack(sure["doc"], np.int64)))
        p = np.concatenate((p[late], W.unpack(sure["at"], np.uint32)))
        order = np.lexsort((p, d))
        packed = W.pack(_home(d[order], n), doc=d[order], at=p[order])
        return pa.Table.from_arrays(list(packed.values()), schema=_PLACE_SCHEMA)

    return run


_RESULT = "_uid long, n_words long, n_removed long, kept string, kept_sha256 string"


def _removed(window: int, keep_text: bool):
    def run(key, texts: pa.Table, places: pa.Table) -> pa.Table:
        data, starts, ends, doc, uid = _texts(texts)
        count, first, _ = W.within(doc, texts.num_rows)
        edge = np.zeros(len(doc) + 1, np.int64)
        if places.num_rows:
            by_uid = np.argsort(uid)
            s = _rows_of(places, by_uid, uid[by_uid], first)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        raw, texts_out, shas = data.tobytes(), [], []
        for i, n in enumerate(count):
            f = first[i]
            stay = np.flatnonzero(~gone[f : f + n]) + f
            kept = b" ".join([raw[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)])
            shas.append(hashlib.sha256(kept).hexdigest())
            texts_out.append(kept.decode() if keep_text else None)
        removed = np.bincount(doc[gone], minlength=texts.num_rows)
        return pa.table(
            {"_uid": pa.array(uid, pa.int64()), "n_words": pa.array(count, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
             "kept": pa.array(texts_out, pa.string()), "kept_sha256": pa.array(shas, pa.string())}
        )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """The id, n_words, n_removed, kept (the words that stay, joined by one space) and kept_sha256 of each row.

    A word goes if a run of `window` words that covers it also begins earlier: in a smaller id, or earlier in the same text. Runs are judged on
    the input. A null text has no words; texts shorter than a window stay; rows with equal or null ids are ordered by their text
    (null id first), and of equal rows any one counts as the earlier. An empty table gives an empty result.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    rows, same = with_uid(docs, id_col, text_col)
    n = buckets(text_bytes(rows), PART)
    texts = rows.select("_uid", "_text", _home_column(n).alias("bucket"))
    anchors = rows.select("_uid", "_text").mapInArrow(_anchors(n, window), _ENTRIES)
    shared = anchors.groupBy("bucket").applyInArrow(_shared(n), _PLACES)
    windows = texts.groupBy("bucket").cogroup(shared.groupBy("bucket")).applyInArrow(_windows(n, window), _ENTRIES)
    later = windows.groupBy("bucket").applyInArrow(_later(n), _PLACES)
    out = texts.groupBy("bucket").cogroup(later.groupBy("bucket")).applyInArrow(_removed(window, keep_text), _RESULT)
    if same:
        out = out.withColumn(id_col, F.col("_uid").cast(dict(docs.dtypes)[id_col]))
    else:
        out = out.join(rows.select("_uid", F.col(f"_in_{id_col}").alias(id_col)), "_uid")
    return out.select(id_col, "n_words", "n_removed", "kept", "kept_sha256")
