"""Quality by a byte-level convolutional network in numpy.

A text is cut into overlapping chunks of bytes that cover all of it. Bytes become small vectors, learned filters slide over each chunk, and each filter's largest
response in the chunk is kept. The mean and the maximum over the chunks are combined into one probability. All weights, byte vectors
included, are learned here by gradient descent on a bounded labelled sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.sample import MOST, fitted, labelled

THRESHOLD = 0.3
CHUNK, OVERLAP, WIDTH, STRIDE, DIM, FILTERS = 512, 64, 8, 4, 8, 24
GROUP = 384  # chunks at a time
PART = 2 << 20
EPOCHS, BATCH = 12, 32


def chunks(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk matrix (bytes, zero-padded) and the text of each chunk; every text has one chunk at least."""
    size = np.diff(offs)
    count = np.maximum(1, -(-(size - OVERLAP) // (CHUNK - OVERLAP)))
    doc = np.repeat(np.arange(len(size)), count)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else count
    begin = offs[:-1][doc] + (np.arange(len(doc)) - first[doc]) * (CHUNK - OVERLAP)
    padded = np.concatenate((data, np.zeros(CHUNK, np.uint8)))
    out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[begin] if len(doc) else np.zeros((0, CHUNK), np.uint8)
    over = np.arange(CHUNK)[None, :] >= (offs[1:][doc] - begin)[:, None]
    out[over] = 0
    return out, doc


def _patches(x: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """chunks x places x (WIDTH * DIM)."""
    e = np.ascontiguousarray(vectors[x]).reshape(len(x), CHUNK * DIM)
    view = np.lib.stride_tricks.sliding_window_view(e, WIDTH * DIM, axis=1)[:, :: STRIDE * DIM]
    return view


def _respond(x: np.ndarray, model: dict):
    p = _patches(x, model["vectors"])
    y = np.ascontiguousarray(p).reshape(-1, WIDTH * DIM) @ model["filters"]
    return p, y.reshape(len(x), -1, FILTERS)


def pooled(x: np.ndarray, model: dict) -> np.ndarray:
    out = np.empty((len(x), FILTERS), np.float32)
    for i in range(0, len(x), GROUP):
        out[i : i + GROUP] = np.maximum(_respond(x[i : i + GROUP], model)[1].max(1) + model["bias"], 0)
    return out


def _combine(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(doc, minlength=n)
    cut = np.concatenate(([0], np.cumsum(count)[:-1]))
    return np.concatenate((np.add.reduceat(h, cut) / count[:, None], np.maximum.reduceat(h, cut)), axis=1)


def score_texts(texts, model: dict) -> np.ndarray:
    x, doc = chunks(*W.utf8(texts))
    if not len(doc):
        return np.zeros(0)
    z = _combine(pooled(x, model), doc, len(texts)) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30).astype(np.float64)))


def train(texts: list[str], y: np.ndarray, seed: int = 7) -> dict:
    """Weights from texts and their labels (0 or 1), by Adam on the logistic loss."""
    rng = np.random.default_rng(seed)
    model = {
        "vectors": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "filters": rng.normal(0, 0.15, (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "out": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "out_bias": np.zeros(1, np.float32),
    }
    if len(y) == 0:
        return model | {"out": np.zeros(2 * FILTERS, np.float32)}
    share = np.clip(y.mean(), 0.01, 0.99)
    model["out_bias"][0] = np.log(share / (1 - share))
    parts = [chunks(*W.utf8(pa.array([t], pa.string())))[0] for t in texts]
    first = {k: np.zeros_like(v) for k, v in model.items()}
    second = {k: np.zeros_like(v) for k, v in model.items()}
    step, steps = 0, EPOCHS * -(-len(y) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            pick = order[i : i + BATCH]
            x = np.concatenate([parts[k] for k in pick])
            doc = np.repeat(np.arange(len(pick)), [len(parts[k]) for k in pick])
            tops, args = [], []
            for c in range(0, len(x), GROUP):
                r = _respond(x[c : c + GROUP], model)[1]
                args.append(r.argmax(1))
                tops.append(r.max(1))
            arg, pre = np.concatenate(args), np.concatenate(tops) + model["bias"]
            h = np.maximum(pre, 0)
            f = _combine(h, doc, len(pick))
            z = f @ model["out"] + model["out_bias"]
            d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
            g = {"out": f.T @ d, "out_bias": np.array([d.sum()])}
            df = d[:, None] * model["out"][None]
            count = np.bincount(doc)
            dh = df[doc, :FILTERS] / count[doc][:, None] + np.where(h == f[doc, FILTERS:], df[doc, FILTERS:], 0)
            dh = dh * (pre > 0)
            g["bias"] = dh.sum(0)
            # only the place of a filter's largest response takes part
            at = arg[:, :, None] * STRIDE + np.arange(WIDTH)[None, None]
            byte = x[np.arange(len(x))[:, None, None], at]  # chunks x filters x WIDTH
            seen = model["vectors"][byte].reshape(len(x), FILTERS, WIDTH * DIM)
            g["filters"] = np.einsum("cf,cfk->kf", dh, seen)
            back = (dh[:, :, None] * model["filters"].T[None]).reshape(-1, DIM)
            flat = byte.reshape(-1)
            g["vectors"] = np.stack([np.bincount(flat, weights=back[:, j], minlength=256) for j in range(DIM)], axis=1)
            step += 1
            rate = 0.004 * (1 - step / (steps + 1))
            for k in model:
                gk = g[k].astype(np.float32) + 1e-5 * model[k]
                first[k] = 0.9 * first[k] + 0.1 * gk
                second[k] = 0.99 * second[k] + 0.01 * gk * gk
                model[k] = (model[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", most: int = MOST) -> dict:
    """A network from at most `most` labelled rows for which `learn` holds, of longer texts a window each, trained in one task.

    Without such rows every score is 0.5.
    """
    return fitted(labelled(docs, labels, label, learn, id_col, text_col, most), lambda rows: train([r[1] for r in rows], np.array([r[2] for r in rows], np.float32)))


def _score(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                yield pa.RecordBatch.from_arrays([batch["_uid"], pa.array(score_texts(batch["_text"], model), pa.float64())], ["_uid", "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and score (0 to 1: how likely the label is 1, from the whole text) of each row. Null texts count as empty; rows are independent."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_score(shared), f"_uid {kind}, score double").withColumnRenamed("_uid", id_col)
