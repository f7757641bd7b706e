"""Substring removal against a brute-force version."""

import hashlib
import re

import pytest

from pagevault.llm.queries import QUERIES
from pagevault.llm.substrings import remove_repeats


def brute(rows, window=20):
    """rows: (id, text) in their order; -> (id, words, removed, sha) of each."""
    seen, out = set(), []
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = set()
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone.update(range(s, s + window))
            seen.add(key)
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_query_is_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    got = QUERIES["op10_substring_dedup"](spark, sf_dir).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == brute(docs)
    assert sum(r.n_removed for r in got) > 0


@pytest.mark.parametrize("shift", range(13))
def test_every_alignment(spark, shift):
    run = " ".join(f"w{i}" for i in range(20))
    rows = [(1, "a " * 7 + run + " b"), (2, " ".join(f"x{i}" for i in range(shift)) + " " + run + " c"), (3, run[:-1] + "X")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = remove_repeats(df).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got] == brute(rows)
    assert got[1].n_removed == 20


def test_odd_rows(spark):
    p = "  ".join(["same"] * 50)
    rows = [(None, p), (None, p), (7, None), (7, ""), (7, p), (8, p + "\tend"), (9, "längere Wörter\n" + p), (9, "längere Wörter\n" + p)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, kept string, n_words int")
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(df).collect()))
    assert got == sorted((i or 0, *rest) for i, *rest in brute(rows))
    assert remove_repeats(df.limit(0)).count() == 0
