"""Secret scans: base spans by brute force, decoding against all taggings, and secrets that the patterns miss."""

import hashlib
import itertools
import re

import numpy as np
import pyarrow as pa
import pytest

from pagevault.llm import secrets
from pagevault.llm.queries import QUERIES


def brute(text):
    assign = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    kinds = [[(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) > 5]]
    for k, (pattern, least) in enumerate(((r"AKIA[A-Z0-9]+", 20), (r"[0-9a-f]+", 24)), 1):
        kinds.append([(m.start(), k, m.end()) for m in re.finditer(pattern, text) if m.end() - m.start() >= least])
    names = ("assign", "access", "hex")
    joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(sum(kinds, [])))
    return *map(len, kinds), hashlib.sha256(joined.encode()).hexdigest()


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    return secrets.fit(docs)


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op7_secrets"](spark, sf).collect()
    assert {r.doc_id for r in got} == docs.keys()
    for r in got:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == brute(docs[r.doc_id])
        base = [s for s in r.spans.split(",") if s and not s.startswith("crf")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256


def test_odd_rows(spark, model):
    texts = [
        None, "", "password=abc secret=token:abcdefghij TOKEN : 'x+y/z.w=-' api_key=\"ABCDEF\" apikey=k12345", "é" * 9 + " AKIA" + "A1" * 9 + " ñ " + "0a" * 13,
        "AKIAshort AKIA" + "Z" * 15, "a" * 23 + "g" + "b" * 24, "paſſword=abcdefgh toKen=abcdefgh", "token=" + "x1" * 20_000, "word " * 40_000,
    ]
    rows = [(None if i % 3 else 1, t, "s") for i, t in enumerate(texts)]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string").coalesce(1), model).collect()
    assert [tuple(r[1:5]) for r in got] == [brute(t or "") for t in texts]
    assert "AKIA" not in got[3].redacted and got[3].redacted.startswith("é" * 9 + " [secret] ñ ")
    assert got[-1].redacted is None and got[-1].spans == ""
    assert secrets.scan(spark.createDataFrame(rows[:1], "doc_id long, text string, spans string").limit(0), model).count() == 0


def test_finds_secrets_that_the_patterns_miss(spark, model):
    texts = [
        'then passwort = "45ac953709720d07d9" and more words', "the credential: 9f86d081884c7d659a2f came", "credential = AKIA5BAMYKPX",
        "plain words of a text and nothing else in it at all", "call 0171 2345678 on 12 May 2024 at 10:30, page 7",
    ]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1), model).collect()
    assert "crf" in rows[0].spans or "crf" in rows[1].spans
    assert rows[3].spans == rows[4].spans == ""


def test_viterbi_is_the_best_of_all_taggings():
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes = rng.integers(1, 7, 4)
        emit, move = rng.normal(0, 2, (sizes.sum(), 3)), rng.normal(0, 0.4, (3, 3))
        emit[rng.random(len(emit)) < 0.3, 0] += 9
        cut = np.zeros(len(emit), bool)
        cut[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
        got, at = secrets.viterbi(emit, move, cut), 0
        for n in sizes:
            value = lambda p: sum(emit[at + i, t] for i, t in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max(itertools.product(range(3), repeat=int(n)), key=value)
            assert tuple(got[at : at + n]) == best
            at += n


def test_text_features_are_per_text():
    texts = pa.array(["", "a1b2 x", None, "token = q9w8e7r6t5"])
    data, offs = secrets.W.utf8(texts)
    f = secrets.Tokens(data, offs).features(secrets.context_hashes())
    one = secrets.Tokens(*secrets.W.utf8(texts.slice(3))).features(secrets.context_hashes())
    assert (f[2:] == one).all() and f.max() < secrets.N_FEATURES
