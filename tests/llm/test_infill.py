"""Fill-in-the-middle against SQL and a plain rewriting; the rank index against a list of boundaries."""

import hashlib
import random

import duckdb
import numpy as np

from pagevault.llm import infill
from pagevault.llm.queries import ORACLE, QUERIES
from pyspark.sql import functions as F


def boundaries(text):
    out, at = [0], 0
    for c in text:
        at += len(c.encode())
        out.append(at)
    return out


def test_index_is_exact():
    rng = random.Random(3)
    texts = ["", "a", "ß", "plain ascii " * 400, "日本" * 3000, "ab" * 500 + "🎉é" * 500 + "x" * 900]
    texts += ["".join(rng.choice(["a", "ß", "日", "🎉", " "]) * rng.randint(1, 40) for _ in range(rng.randint(1, 300))) for _ in range(40)]
    for text in texts:
        for error in (0, 3, infill.ERROR):
            index = infill.RankIndex(np.frombuffer(text.encode(), np.uint8), error)
            want = boundaries(text)
            assert index.offsets(np.arange(len(want))).tolist() == want
            assert index.ranks(np.array(want)).tolist() == list(range(len(want)))
            assert np.abs(index.residual).max() <= error
    assert len(infill.RankIndex(np.frombuffer(b"x" * 5000, np.uint8)).rank) == 1
    mixed = infill.RankIndex(np.frombuffer(texts[5].encode(), np.uint8))
    assert 1 < len(mixed.rank) < 40  # few segments, not one per boundary


def test_index_over_pieces(monkeypatch):
    monkeypatch.setattr(infill.W, "PIECE", 7)
    text = "aß日🎉" * 50
    index = infill.RankIndex(np.frombuffer(text.encode(), np.uint8))
    assert index.offsets(np.arange(len(text) + 1)).tolist() == boundaries(text)


def plain(doc_id, text):
    text, n = text or "", len(text or "")
    h = [int(hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    return n, form, a, b - a, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def test_odd_rows(spark):
    texts = [None, "", "a", "has <S> in it", "<P", "x<", "ends with <P", "日本語🎉 ß" * 5, "word ß " * 400_000, "same", "same"]
    rows = [(i, t, 1, "o") for i, t in enumerate(texts)] + [(None, "no id", 2, "o"), (None, None, 2, "o"), (9, "same", 1, "o")]
    rows += [(100 + i, f"text {i} ßß 日本 <" * (i % 7), 3, "o") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, output string")
    got = infill.fill_in_middle(df).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    have = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got), key=key)
    assert have == sorted(((i, *plain(i, t), t or "") for i, t, *_ in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(df.limit(0)).count() == 0


def test_query_is_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    df = QUERIES["op11_fill_in_middle"](spark, sf_dir)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op11_fill_in_middle']})")
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
