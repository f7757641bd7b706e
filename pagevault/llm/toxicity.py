"""Toxicity by weak supervision: voters, a generative model of how they err, and a linear classifier on its posterior labels.

Voters say toxic, clean or nothing. Lexicon voters: each word of a small fixed list, and words that the labelled sample shows to be
far more frequent in toxic texts. Pattern voters: several lexicon words together, a lexicon word near a word of address, shouting, runs
of exclamation marks, and two that vote clean. The label model has, for each voter and class, the probability of each vote; EM
estimates them from the votes alone, and from what is left, the correlation of voters within a class: a voter that repeats others
counts for less. A logistic regression on word and voter features then learns the posterior labels; it alone scores texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.llm import words as W
from pagevault.llm.frames import attach
from pagevault.llm.sample import MOST, fitted, labelled

THRESHOLD = 0.7
INDUCED, FEATURES = 48, 1500
PART = 2 << 20
SLICE = 200  # texts of a fit at a time
# fixed values: common words of abuse in a few languages
LEXICON = (
    "idiot idiots moron morons stupid loser losers scum trash garbage clown pathetic disgusting worthless dumb fool imbecile jerk "
    "bastard creep filthy vermin freak retard hate kill ugly shut "
    "dummkopf trottel abschaum widerlich versager arschloch blöd "
    "imbécile crétin connard ordure débile pourriture abruti "
    "idiota imbécil estúpido basura asqueroso inútil cabrón tonto"
).split()
ADDRESS = "you your youre u du dein ihr tu te vous votre ton tú usted ustedes eres".split()


def _hashes(listed) -> np.ndarray:
    data, offs = W.utf8(pa.array(list(listed), pa.string()))
    return np.unique(W.word_hashes(data, offs[:-1], offs[1:]))


def _tokens(texts):
    data, offs = W.utf8(texts)
    starts, ends, doc = W.spans(data, offs, W.ALNUM)
    return data, offs, W.word_hashes(W.LOWER[data], starts, ends), doc


def _member(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Index in the sorted array `known`, or -1."""
    if not len(known):
        return np.full(len(h), -1, np.int64)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    return np.where(known[at] == h, at, -1)


def _share(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offs[1:]] - total[offs[:-1]]


def votes(texts, lexicon: np.ndarray, address: np.ndarray) -> np.ndarray:
    """n x voters: 1 toxic, -1 clean, 0 no vote. The first voters are the words of the lexicon."""
    data, offs, h, doc = _tokens(texts)
    n = len(offs) - 1
    word = _member(h, lexicon)
    found = np.flatnonzero(word >= 0)
    out = np.zeros((n, len(lexicon) + 6), np.int8)
    out[doc[found], word[found]] = 1
    kinds = (out[:, : len(lexicon)] > 0).sum(1)
    count = np.bincount(doc, minlength=n)
    near = np.zeros(n, bool)
    addressed = _member(h, address) >= 0
    for k in (1, 2, 3):
        p = found[found >= k]
        p = p[(doc[p] == doc[p - k]) & addressed[p - k]]
        near[doc[p]] = True
    upper = _share((data >= 0x41) & (data <= 0x5A), offs)
    marks = data == 0x21
    runs = _share(np.append(marks[1:] & marks[:-1], False) if len(marks) else marks, offs)
    size = np.maximum(np.diff(offs), 1)
    p = len(lexicon)
    out[:, p] = kinds >= 2
    out[:, p + 1] = near
    out[:, p + 2] = upper > 0.4 * size
    out[:, p + 3] = runs >= 5
    out[:, p + 4] = -(kinds == 0).astype(np.int8)
    out[:, p + 5] = -((kinds == 0) & (count >= 100)).astype(np.int8)
    return out


def _correlation(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted correlation of voters, 0 with themselves and where a voter never changes."""
    centred = v - weight @ v
    cov = (centred * weight[:, None]).T @ centred
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    size = np.outer(sd, sd)
    out = np.where(size > 1e-9, cov / np.maximum(size, 1e-9), 0)
    np.fill_diagonal(out, 0)
    return out


def label_model(v: np.ndarray, prior: float, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of toxic for each row, accuracy of each voter when it votes, and the correlations of voters within a class."""
    n, k = v.shape
    said = [(v == vote).astype(np.float32) for vote in (-1, 0, 1)]  # n x voters for each vote
    # voters that all but repeat each other are known from their votes at once; EM would else believe them for agreeing
    alike = np.abs(_correlation(v, np.full(n, 1 / max(n, 1))))
    discount, corr = 1 / (1 + np.where(alike > 0.8, alike, 0).sum(1)), np.zeros((k, k))
    q = np.where(v @ discount > 0, 0.9, 0.05)
    for r in range(rounds):
        table = []
        for weight in (1 - q, q):
            table.append((np.stack([weight @ x for x in said], axis=1) + 0.1) / (weight.sum() + 0.3))
        ratio = np.log(table[1] / table[0])  # voters x votes
        logit = np.log(prior / (1 - prior)) + sum(x @ (ratio[:, k] * discount) for k, x in enumerate(said))
        q = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if r in (10, 20):  # what votes still share, given the class
            corr = np.zeros((k, k))
            for weight in (1 - q, q):
                corr = np.maximum(corr, np.abs(_correlation(v, weight / max(weight.sum(), 1e-9))) * (weight.sum() > 20))
            strong = np.where(corr > 0.3, corr, 0)
            discount = 1 / (1 + strong.sum(1))
    right = q @ (v > 0) + (1 - q) @ (v < 0)
    return q, right / np.maximum((v != 0).sum(0), 1), corr


def _features(texts, model: dict) -> np.ndarray:
    _, _, h, doc = _tokens(texts)
    n = len(texts)
    v = votes(texts, model["lexicon"], model["address"]).astype(np.float32)
    x = np.zeros((n, len(model["words"])), np.float32)
    at = _member(h, model["words"])
    some = at >= 0
    x[doc[some], at[some]] = 1
    return np.concatenate((v, x), axis=1)


def fit(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", most: int = MOST) -> dict:
    """A model from at most `most` labelled rows for which `learn` holds, of longer texts a window each, trained in one task.

    Without such rows it is the fixed lexicon and a prior of 0.1.
    """
    return fitted(labelled(docs, labels, label, learn, id_col, text_col, most), lambda rows: train([r[1] for r in rows], np.array([r[2] for r in rows], bool)))


def train(texts: list[str], y: np.ndarray) -> dict:
    """A model from texts and their labels."""
    texts = pa.array(texts, pa.string())
    words, of = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for i in range(0, len(texts), SLICE):  # each word of a text once
        _, _, h, doc = _tokens(texts[i : i + SLICE])
        first = np.unique(W.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
        words.append(h[first])
        of.append(doc[first] + i)
    h, of = np.concatenate(words), np.concatenate(of)
    vocab, at = np.unique(h, return_inverse=True)
    bad = np.bincount(at, weights=y[of], minlength=len(vocab)) if len(h) else np.zeros(0)
    all_ = np.bincount(at, minlength=len(vocab))
    n_bad, n_all = max(1, int(y.sum())), max(1, len(y))
    odds = np.log((bad + 0.1) / (n_bad + 0.2)) - np.log((all_ - bad + 0.1) / (n_all - n_bad + 0.2))
    strong = np.flatnonzero((bad >= max(5, 0.02 * n_bad)) & (bad >= 0.7 * all_))
    strong = strong[np.argsort(-odds[strong] * np.sqrt(bad[strong]), kind="stable")][:INDUCED]
    model = {"lexicon": np.union1d(_hashes(LEXICON), vocab[strong]), "address": _hashes(ADDRESS)}
    often = np.flatnonzero(all_ >= max(5, 0.003 * n_all))
    often = often[np.argsort(-np.abs(odds[often]) * np.sqrt(all_[often]), kind="stable")][:FEATURES]
    model["words"] = np.sort(vocab[often])
    slices = [texts[i : i + SLICE] for i in range(0, max(len(texts), 1), SLICE)]
    v = np.concatenate([votes(t, model["lexicon"], model["address"]) for t in slices])
    prior = min(0.5, max(0.02, n_bad / n_all)) if len(y) and y.any() else 0.1
    if not len(y):
        w = np.zeros(v.shape[1], np.float32)
        w[: len(model["lexicon"]) + 1] = 3
        return model | {"weights": w, "bias": np.float32(-2.2), "accuracy": np.zeros(v.shape[1]), "correlation": np.zeros((v.shape[1],) * 2)}
    q, accuracy, corr = label_model(v, prior)
    x = np.concatenate([_features(t, model) for t in slices])
    w, b, q = np.zeros(x.shape[1], np.float32), float(np.log(prior / (1 - prior))), q.astype(np.float32)
    penalty = np.concatenate((np.full(v.shape[1], 1e-4), np.full(x.shape[1] - v.shape[1], 3e-2))).astype(np.float32)
    m, s, mb, sb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, 301):
        p = 1 / (1 + np.exp(-np.clip(x @ w + np.float32(b), -30, 30)))
        g, gb = x.T @ (p - q) / len(q) + penalty * w, float((p - q).mean())
        m, s, mb, sb = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.99) * s + np.float32(0.01) * g * g, 0.9 * mb + 0.1 * gb, 0.99 * sb + 0.01 * gb * gb
        rate = 0.1 if step < 220 else 0.02
        w -= np.float32(rate) * (m / np.float32(1 - 0.9**step)) / (np.sqrt(s / np.float32(1 - 0.99**step)) + np.float32(1e-8))
        b -= rate * (mb / (1 - 0.9**step)) / (np.sqrt(sb / (1 - 0.99**step)) + 1e-8)
    return model | {"weights": w.astype(np.float32), "bias": np.float32(b), "accuracy": accuracy, "correlation": corr}


def score_texts(texts, model: dict) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_features(texts, model) @ model["weights"] + model["bias"], -30, 30))).astype(np.float64)


def _score(shared):
    def run(batches):
        model = shared.value
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                p = score_texts(batch["_text"], model)
                names = [c for c in batch.schema.names if c != "_text"]
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(p, pa.float64())], [*names, "score"])

    return run


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and score (0 to 1, from the whole text) of each row. Null texts count as empty; rows are independent."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers, whatever the data
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(_score(shared), f"_uid {kind}, score double").withColumnRenamed("_uid", id_col)


def clean(docs: DataFrame, model: dict, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores below the threshold, unchanged.

    Rows are independent: repeated rows stay or go together; null texts count as empty, and texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("score", T.DoubleType())])
    out, (found,) = attach(docs, text_col, lambda: shared.value, lambda m, texts: [pa.array(score_texts(texts, m), pa.float64())], added, PART)
    return out.filter(F.col(found) < threshold).drop(found)
