"""Embedding inputs, embedding, exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions import fixed, is_plain_text
from pagevault.functions.jsoncols import item
from pagevault.operators.ordered import arrange, number_rows
from pagevault.operators.rows import portions
from pagevault.session import shared_table
from pagevault.sources.tables import decode_docs

EMBED_DIM = 64


# --- inputs -------------------------------------------------------------------------------------------------


def _item_reason(x: Column) -> Column:
    """Why an item is not usable, NULL when it is."""
    missing = lambda f: x[f].isNull() | (x[f] == "")
    return (
        F.when(x["type"].isNull() | ~x["type"].isin("text", "image_url", "image_base64"), F.lit("unknown type"))
        .when((x["type"] == "text") & missing("text"), F.lit("text without text field"))
        .when((x["type"] == "image_url") & missing("image_url"), F.lit("image without image_url field"))
        .when((x["type"] == "image_base64") & missing("image_base64"), F.lit("image without image_base64 field"))
    )


def embed_item_reasons(df: DataFrame, items: str) -> DataFrame:
    """Adds `reason`: the first fault of the row's items, or mixed image kinds, or NULL."""
    kinds = F.array_distinct(
        F.filter(F.transform(F.col(items), lambda x: x["type"]), lambda t: t.startswith("image_"))
    )
    fault = F.try_element_at(
        F.filter(F.transform(F.col(items), _item_reason), lambda r: r.isNotNull()), F.lit(1)
    )
    return df.withColumn(
        "reason",
        F.when(F.col(items).isNull(), F.lit("content must be an array"))
        .when(fault.isNotNull(), fault)
        .when(F.size(kinds) > 1, F.lit("images must be all URLs or all base64")),
    )


def embed_item_valid(df: DataFrame, items: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose items are all valid, and the rejects with their reason."""
    judged = embed_item_reasons(df, items)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def embed_inputs(df: DataFrame, col: str = "input") -> tuple[DataFrame, DataFrame]:
    """Plain texts or item arrays to `content` arrays; rows that cannot be used come back as rejects with a reason.

    Item arrays keep their usable items (an item with another type but a URL or text is read as that); texts that
    are URLs or file names would be images to load, which is outside this library, so they are rejects.
    """
    if dict(df.dtypes)[col].startswith("array"):
        def usable(x: Column) -> Column:
            url, text = x["image_url"], x["text"]
            return (
                F.when((x["type"] == "text") & text.isNotNull(), item("text", text))
                .when((x["type"] == "image_url") & url.isNotNull(), item("image_url", url))
                .when(url.isNotNull(), item("image_url", url))
                .when(text.isNotNull(), item("text", text))
            )

        content = F.filter(F.transform(F.col(col), usable), lambda x: x.isNotNull())
        judged = df.withColumn("content", content).withColumn(
            "reason", F.when(F.coalesce(F.size("content"), F.lit(0)) <= 0, F.lit("no valid content items"))
        )
    else:
        judged = df.withColumn("content", F.array(item("text", F.col(col)))).withColumn(
            "reason", F.when(~is_plain_text(F.col(col)), F.lit("not plain text"))
        )
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null").drop("content")


def embed_batches(
    df: DataFrame, size: int = fixed.EMBED_BATCH, order: Sequence[str] = ("id",), kind: str | None = None
) -> DataFrame:
    """Adds `batch_id`: requests of at most `size` rows, numbered along the order; with `kind` (image kind or NULL)
    one request never mixes two kinds, and `batch_id` counts within the kind.

    Numbering all rows needs no single task: rows are range-partitioned and the partitions' counts added up.
    """
    key = [kind] if kind else []
    a = number_rows(arrange(df, key, order), "_n")
    return a.result().withColumn("batch_id", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


# --- embedding ----------------------------------------------------------------------------------------------

EmbedFn = Callable[[pd.Series, str], np.ndarray]


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_IN_WORD = np.zeros(256, bool)  # digits, letters, and all bytes of characters outside ASCII
_IN_WORD[0x30:0x3A] = _IN_WORD[0x41:0x5B] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True
WORD_BASE, WORD_PRIME = 31, 2_147_483_647
_PIECE = 1 << 20  # bytes of text at a time: numpy holds some fifty times as much


def _slot_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words per text and slot. A word's hash is the polynomial of its bytes: all words at once, weighted by distance from the word's end."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _IN_WORD[data]
    at = offsets[1:-1]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    first[at[at < len(data)]] = inside[1:-1][at[at < len(data)]]  # a text's end ends a word as well
    last[at[at > 0] - 1] = inside[1:-1][at[at > 0] - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.zeros((len(offsets) - 1, EMBED_DIM), np.int64)
    if not len(starts):
        return out
    longest = int((ends - starts).max())
    powers = np.ones(longest, np.int64)
    for i in range(1, longest):
        powers[i] = powers[i - 1] * WORD_BASE % WORD_PRIME
    at = np.flatnonzero(inside[1:-1])  # the bytes of all words, one word after the other
    head = np.cumsum(ends - starts) - (ends - starts)
    terms = _LOWER[data[at]] * powers[np.repeat(ends, ends - starts) - 1 - at]
    slots = np.add.reduceat(terms, head) % WORD_PRIME % EMBED_DIM  # 2**24 bytes of a word fit
    text = np.searchsorted(offsets, starts, side="right") - 1
    return np.bincount(text * EMBED_DIM + slots, minlength=out.size).reshape(out.shape)


def hashed_bow(texts: pd.Series, mode: str) -> np.ndarray:
    """Like `word_bow` with less work, for texts whose letters outside ASCII need no lower case.

    Words are runs of ASCII letters (in lower case), digits and characters outside ASCII; the hash is the polynomial of the word's bytes with
    WORD_BASE modulo WORD_PRIME. Texts without words, and NULL, give zeros.
    """
    column = pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    parts, at = [np.zeros((0, EMBED_DIM), np.int64)], 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _PIECE, side="right")) - 1)
        parts.append(_slot_counts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]))
        at = end
    out = np.concatenate(parts).astype(np.float64)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


_SPACED = np.where(_IN_WORD, np.arange(256), 0x20).astype(np.uint8)  # all bytes between words as spaces


def word_bow(texts: pd.Series, mode: str) -> np.ndarray:
    """Unit-length counts of words hashed to 64 places by their md5: needs no model, the same everywhere. Mode is ignored.

    Words are runs of ASCII letters, digits and characters outside ASCII, in lower case in every script. Each distinct word of a piece of
    text is hashed once. Texts without words, and NULL, give zeros.
    """
    column = pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")
    out = np.zeros((len(column), EMBED_DIM))
    for begin, end in portions(pc.binary_length(column).to_numpy(zero_copy_only=False), _PIECE):
        _, offsets, data = pc.utf8_lower(column.slice(begin, end - begin)).buffers()
        spaced = _SPACED[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.zeros(0, np.uint8)
        words = pc.split_pattern(pa.LargeStringArray.from_buffers(end - begin, offsets, pa.py_buffer(spaced)), " ")
        coded = pc.list_flatten(words).dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False)
        slots = [hashlib.md5(w, usedforsecurity=False).digest()[1] % EMBED_DIM if w else -1 for w in distinct]
        slots = np.array(slots, np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
        text = pc.list_parent_indices(words).to_numpy(zero_copy_only=False)
        found = slots >= 0
        counts = np.bincount(text[found] * EMBED_DIM + slots[found], minlength=(end - begin) * EMBED_DIM)
        out[begin:end] = counts.reshape(-1, EMBED_DIM)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)


EMBED_BYTES = 1 << 20  # of text that an embedding function gets at a time, at least one text


def _vectors(texts: pa.Array, fn: EmbedFn, mode: str) -> pa.Array:
    """The vectors of a batch. Its texts become Python objects in portions of EMBED_BYTES, however large it is."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    if not len(sizes):
        return pa.array([], pa.list_(pa.float32()))
    parts = [
        np.asarray(fn(pd.Series(texts.slice(begin, end - begin).to_pylist(), dtype=object), mode), np.float32)
        for begin, end in portions(sizes, EMBED_BYTES)
    ]
    ends = np.cumsum([0, *(p.shape[1] for p in parts for _ in range(len(p)))], dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([p.ravel() for p in parts])))


def embed_text(df: DataFrame, col: str, fn: EmbedFn = word_bow, mode: str = "document") -> DataFrame:
    """Adds `vector` (array of floats) from a pluggable function of (texts, 'document' or 'query')."""

    def run(texts: pa.Array) -> pa.Array:
        return _vectors(texts, fn, mode)

    return df.withColumn("vector", F.arrow_udf(run, "array<float>")(F.col(col)))


def embed_with_model(
    df: DataFrame, col: str, load: Callable[[], EmbedFn], mode: str = "document", batch: int = fixed.EMBED_BATCH
) -> DataFrame:
    """Adds `vector` by a model that `load` opens: once in each Python worker, not once per batch of rows. NULL texts reach it as ''."""

    def make() -> Callable[[np.ndarray], np.ndarray]:
        fn = load()
        return lambda texts: fn(pd.Series(texts), mode).astype(np.float32)

    predict = predict_batch_udf(make, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return df.withColumn("vector", predict(F.coalesce(F.col(col), F.lit(""))))


# --- nearest neighbours -------------------------------------------------------------------------------------

BLOCK_QUERIES = 8_000  # query vectors that are broadcast at a time
STEP_CELLS = 1_000_000  # distances that a task holds at a time


def _distances(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each query to each row, low = near, summed in double precision."""
    if metric == "l2":
        # differences rather than the dot-product identity: exact for equal vectors
        out = np.empty((len(queries), len(rows)))
        for i, q in enumerate(queries):
            d = rows - q
            out[i] = np.sqrt(np.einsum("ij,ij->i", d, d))
        return out
    dots = queries @ rows.T
    if metric == "dot":
        return -dots
    if metric == "cosine":
        qn = np.linalg.norm(queries, axis=1)[:, None]
        rn = np.linalg.norm(rows, axis=1)[None, :]
        return np.maximum(1.0 - np.divide(dots, qn * rn, out=np.zeros_like(dots), where=(qn * rn) > 0), 0.0)
    raise ValueError(f"unknown metric {metric}")


def _block_topk(
    block: list[tuple], vectors: DataFrame, query_type: str, vec_type: str, k: int, metric: str
) -> DataFrame:
    """Top k rows per query of one block: each task keeps k rows per query, so only k x tasks rows are shuffled."""
    ids = [q[0] for q in block]
    matrix = np.array([q[1] for q in block], dtype=np.float64)
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, qs = shared.value
        best: list[list[tuple]] = [[] for _ in qids]  # (is NaN, distance, id) in order, at most k
        kth = np.full(len(qids), np.nan)  # compares as larger with nothing: all rows are candidates until there are k
        step = max(1, STEP_CELLS // len(qids))
        parts = (pdf.iloc[i : i + step] for whole in batches for pdf in [whole[whole["_vec"].notna()]] for i in range(0, len(pdf), step))
        for pdf in parts:
            d = _distances(qs, np.stack(pdf["_vec"].to_numpy()).astype(np.float64), metric)
            ids = pdf["_id"].to_numpy(dtype=object)
            may = ~(d > kth[:, None])  # ties with the k-th stay, to be settled by id
            for i in np.flatnonzero(may.any(axis=1)).tolist():
                near = np.flatnonzero(may[i])
                if len(near) > k:  # NaN sorts last
                    near = near[~(d[i, near] > np.partition(d[i, near], k - 1)[k - 1])]
                found = [(x != x, 0.0 if x != x else x, v) for x, v in zip(d[i, near].tolist(), ids[near].tolist(), strict=True)]
                best[i] = sorted(best[i] + found)[:k]
                if len(best[i]) == k:
                    kth[i] = np.nan if best[i][-1][0] else best[i][-1][1]
        rows = [(q, v, np.nan if nan else x) for q, some in zip(qids, best, strict=True) for nan, x, v in some]
        if rows:
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "distance"])

    local = vectors.mapInPandas(run, f"query_id {query_type}, vec_id {vec_type}, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return local.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def knn_exact(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    metric: str = "l2",
    query_id: str = "query_id",
    vec_id: str = "vec_id",
    query_vec: str = "vector",
    vec: str = "embedding",
) -> DataFrame:
    """query_id, vec_id, distance, rank of the k nearest vectors of each query; ties go to the lower id.

    A flat scan, as exact search has to be: query vectors go to the tasks, which compute distances in numpy, a bounded
    number at a time. No pair is ever a row: a task holds k candidates per query. Up to BLOCK_QUERIES queries take one
    scan. More go in blocks, one on the driver at a time; vectors are then written once, so that what makes them does not run again.
    """
    if metric not in ("l2", "cosine", "dot"):
        raise ValueError(f"unknown metric {metric}")
    qs = queries.select(F.col(query_id).alias("_qid"), F.col(query_vec).cast("array<double>").alias("_qv"))
    qs = qs.filter(F.col("_qv").isNotNull())
    vs = vectors.select(F.col(vec_id).alias("_id"), F.col(vec).alias("_vec"))
    query_type, vec_type = dict(qs.dtypes)["_qid"], dict(vs.dtypes)["_id"]
    head = qs.limit(BLOCK_QUERIES + 1).collect()
    if not head:
        return vectors.sparkSession.createDataFrame([], f"query_id {query_type}, vec_id {vec_type}, distance double, rank long")
    if len(head) <= BLOCK_QUERIES:
        return _block_topk([tuple(r) for r in head], vs, query_type, vec_type, k, metric)
    asked, vs, out = shared_table(qs), shared_table(vs), None
    n_blocks = -(-asked.count() * 2 // BLOCK_QUERIES)  # twice the mean: hashing is uneven
    for b in range(n_blocks):
        block = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("_qid"), F.lit(n_blocks)) == b).collect()]
        if block:
            found = shared_table(_block_topk(block, vs, query_type, vec_type, k, metric))
            out = found if out is None else out.unionByName(found)
    return out


def knn_topk(query: Sequence[float], vectors: DataFrame, k: int = 10, metric: str = "l2", vec_id: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """The k nearest rows of one query vector with all their columns and `distance`.

    One query needs no broadcast table: the distance is an expression and the order a distributed top-k.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    v = F.transform(F.col(vec), lambda x: x.cast("double"))

    def total(values: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)

    dot = total(F.zip_with(v, q, lambda a, b: a * b))
    if metric == "l2":
        distance = F.sqrt(total(F.zip_with(v, q, lambda a, b: (a - b) * (a - b))))
    elif metric == "dot":
        distance = -dot
    elif metric == "cosine":
        norms = F.sqrt(total(F.transform(v, lambda a: a * a))) * F.sqrt(total(F.transform(q, lambda a: a * a)))
        distance = F.when(norms > 0, F.greatest(F.lit(1.0) - dot / norms, F.lit(0.0))).otherwise(F.lit(1.0))
    else:
        raise ValueError(f"unknown metric {metric}")
    return vectors.filter(F.col(vec).isNotNull()).withColumn("distance", distance).orderBy("distance", vec_id).limit(k)


def vector_search(
    rows: DataFrame,
    query: str | Sequence[float],
    k: int = 10,
    predicate: str | None = None,
    metric: str = "l2",
    fn: EmbedFn = word_bow,
    vec_id: str = "id",
    vec: str = "vector",
) -> DataFrame:
    """Embed a query text (or take a vector), filter, find the k nearest rows, decode their stored columns.

    The filter comes first and reaches the scan. Failures raise; an empty result means that nothing matched.
    """
    vector = fn(pd.Series([query]), "query")[0] if isinstance(query, str) else query
    found = rows.filter(F.expr(predicate)) if predicate else rows
    out = knn_topk(vector, found, k, metric, vec_id, vec)
    if "content" in out.columns:
        out = out.withColumn("content", F.try_parse_json("content"))
    return decode_docs(out).drop(vec)


def vector_search_batch(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 10,
    predicate: str | None = None,
    metric: str = "l2",
    vec_id: str = "id",
    vec: str = "vector",
    query_id: str = "query_id",
    query_vec: str = "vector",
) -> DataFrame:
    """Many queries at once over filtered rows; join the result with the rows for their other columns."""
    found = rows.filter(F.expr(predicate)) if predicate else rows
    return knn_exact(queries, found, k, metric, query_id, vec_id, query_vec, vec)
