"""Quality and toxicity scores: held-out accuracy, odd rows, and that labels of held-out rows are not used."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pagevault.llm import quality, toxicity
from pagevault.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def auc(score, label):
    ones, zeros = np.sort(score[label == 1]), score[label == 0]
    return np.mean((len(ones) - np.searchsorted(ones, zeros, "left") + len(ones) - np.searchsorted(ones, zeros, "right")) / 2) / len(ones)


@pytest.mark.parametrize(("name", "label", "parts", "rest", "threshold"), [("op3_quality", "quality", 5, 0, 0.3), ("op8_toxicity", "toxic", 3, 1, 0.7)])
def test_held_out(spark, name, label, parts, rest, threshold):
    rows = QUERIES[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == rest)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= threshold)
    held = [r for r in rows if r.held_out and r[label] is not None]
    score, y = np.array([r.score for r in held]), np.array([r[label] for r in held])
    assert auc(score, y) > 0.9  # some labels are noise
    assert np.mean((score >= threshold) == y) > 0.95


@pytest.mark.parametrize("method", [quality, toxicity])
def test_odd_rows(spark, method):
    rows = [(None, None), (1, ""), (1, "same text"), (1, "same text"), (2, "very long " * 60_000), (3, "é")]
    docs = spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, score double, quality int")
    labels = spark.createDataFrame([(1, 1, None), (1, 0, 1), (None, 1, 1), (2, None, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = method.score(docs, method.fit(docs, labels, F.lit(True))).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert method.score(docs.limit(0), method.fit(docs.limit(0), labels.limit(0), F.lit(True))).count() == 0


def test_convolution_sees_the_whole_text():
    rng = np.random.default_rng(1)
    plain = ["plain words " * int(k) for k in rng.integers(5, 300, 120)]
    texts = plain + [t + "%%%" * 30 + t for t in plain]
    model = quality.train(texts, np.array([1] * 120 + [0] * 120, np.float32))
    p = quality.score_texts(pa.array(["plain words " * 4000, "plain words " * 4000 + "%%%" * 30]), model)
    assert p[0] > p[1]
    x, doc = quality.chunks(np.arange(2000).astype(np.uint8), np.array([0, 0, 700, 2000]))
    assert set(doc) == {0, 1, 2} and x.shape[1] == quality.CHUNK


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, np.where(y, 1, -1), np.where(y, -1, 1))
    first = vote(0.7)
    v = np.stack([vote(0.9), vote(0.8), vote(0.85), first, first], axis=1).astype(np.int8)
    q, accuracy, corr = toxicity.label_model(v, 0.3)
    assert np.mean((q > 0.5) == y) > 0.9
    assert accuracy[:3] == pytest.approx([0.9, 0.8, 0.85], abs=0.05)
    assert corr[3, 4] > 0.9 and corr[0, 1] < 0.3
