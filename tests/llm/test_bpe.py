"""Encoding against the tokenizers library; decoding is an exact round trip."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pagevault.llm import bpe as module
from pagevault.llm import words as W
from pagevault.llm.bpe import Bpe, default_vocabulary, encode
from pagevault.llm.queries import QUERIES


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_vocabulary())


@pytest.fixture(scope="module")
def bpe():
    return Bpe(open(default_vocabulary(), encoding="utf-8").read())


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_query_is_the_library(spark, sf_dir, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op4_bpe"](spark, sf_dir).collect()
    assert {r.doc_id for r in got} == docs.keys()
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(back))


def test_words_are_merged_exactly(bpe, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aeiou thsrnl'sdéßñ 0123\t\n \x1c.,-<|>") for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["a" * n for n in range(1, 70)] + ["ab" * 40, "<|endoftext|>", "x<|endoftext|> y <|endoftext|>", " " * 9, "日本語テキスト 🎉🎉", "don't we'll I'M"]
    for text in texts:
        bpe.learn(set(bpe.pieces(text)))
        coded = ",".join(bpe.coded[p] for p in bpe.pieces(text))
        assert coded == ",".join(map(str, library.encode(text, add_special_tokens=False).ids)), repr(text)


def test_check_agrees_with_merging(bpe):
    """A pair passes exactly if merging its bytes gives the pair; both outcomes occur."""
    rng = random.Random(6)
    pairs = [(rng.randrange(300, 50000), rng.randrange(300, 50000)) for _ in range(3000)]
    pairs += [(t, t) for t in range(0, 3000)]
    got = bpe.compatible(*np.array(pairs, np.int64).T)
    want = [bpe.merged(bpe.bytes[a] + bpe.bytes[b]) == [a, b] for a, b in pairs]
    # a token that merging its own bytes does not give is never proposed by merging; the check is about its neighbours only
    whole = [bpe.merged(bpe.bytes[a]) == [a] and bpe.merged(bpe.bytes[b]) == [b] for a, b in pairs]
    assert [g for g, w in zip(got, whole) if w] == [x for x, w in zip(want, whole) if w]
    assert 0 < sum(want) < len(want)


def test_odd_rows(spark, library):
    rows = [(None, None, 1), (1, "", 2), (1, "same", 3), (1, "same", 3), (2, "word " * 40_000, 4), (3, "ß" * 30_000, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted(((r.doc_id or 0, r.n_tokens, r.decoded) for r in encode(df).collect()))
    assert got == sorted((i or 0, len(library.encode(t or "", add_special_tokens=False).ids), t or "") for i, t, _ in rows)
    assert encode(df.limit(0)).count() == 0


def test_short_words_are_worked_on_together(bpe, monkeypatch):
    """Proposals and merges of many words at once are those of each word alone; no short word is merged alone."""
    rng = random.Random(7)
    words = ["".join(rng.choice("aeioulnrst théß日0") for _ in range(rng.randint(1, 24))).encode()[:48] for _ in range(4000)]
    words += [b"a" * n for n in range(1, 60)] + [b"ab" * 30, bytes(range(256)), b"\xff", b"the" * 16]
    short = [w for w in words if len(w) <= 48]
    data, offs = np.frombuffer(b"".join(short), np.uint8), np.cumsum([0, *map(len, short)])
    tokens, count = bpe.propose_all(data, offs)
    assert [p.tolist() for p in np.split(tokens, np.cumsum(count)[:-1])] == [bpe.propose(w) for w in short]
    want = [bpe.merged(w) for w in words]
    assert bpe.merged_all(data, offs) == [m for w, m in zip(words, want) if len(w) <= 48]
    one_by_one = []
    alone = type(bpe).merged
    monkeypatch.setattr(bpe, "merged", lambda w: one_by_one.append(w) or alone(bpe, w))
    assert bpe.encode_words(words) == want
    assert bpe.encode_words([]) == []
    assert all(len(w) > 48 for w in one_by_one)


def test_a_worker_keeps_no_words_after_a_task(bpe, monkeypatch):
    """In a pipeline the worker waits for other work; words kept from before would count beside it."""
    monkeypatch.setattr(module, "_encoder", lambda shared: bpe)
    batch = pa.RecordBatch.from_pydict({"_uid": [1, 2], "_text": ["some words", None]})
    out = list(W.tidy(module._run(None, False))(iter([batch])))
    assert [n for b in out for n in b["n_tokens"].to_pylist()] == [2, 0]
    assert not bpe.coded and not bpe.decoded and bpe.older == ({}, {})
