"""Contamination against SQL and brute force."""

import hashlib
import re

import duckdb

from pagevault.llm.decontaminate import contamination, longest_matches
from pagevault.llm.queries import ORACLE, QUERIES


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for item, t in items:
            q = words(t)
            n = min(window, len(q))
            for s in range(len(q) - n + 1 if q else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add("" if item is None else str(item))
        out.append((i or 0, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def test_query_is_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = QUERIES["op5_decontamination"](spark, sf)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op5_decontamination']})")
    got = sorted(map(tuple, df.collect()))
    assert got == sorted(cur.fetchall())
    assert sum(r[-1] for r in got) > 3


def test_odd_rows_in_one_and_in_many_blocks(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = [(None, long), (1, None), (1, ""), (2, "pre " + long.upper() + ". post short item here"), (2, "Short, item"), (3, "short item " * 3), (3, "a " * 5000), (4, long[10:90]), (4, long[10:90])]
    items = [(7, long), (8, "short item"), (9, None), (10, ""), (None, "post"), (8, "a " * 12), (11, " ".join(long.split()[:9]))]
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, n_words int, hit string")
    b = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    for block in (1 << 20, 60):
        got = contamination(d, b, block=block).collect()
        assert sorted((r.doc_id or 0, *r[1:6]) for r in got) == brute(docs, items)
        assert all(sum(y - x for x, y in r.spans) == r.n_hit for r in got)
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).filter("contaminated").count() == 0


def test_longest_matches(spark):
    long = [f"w{i % 7}x{i // 7}" for i in range(60)]
    docs = [(1, " ".join(long[5:40]) + " " + " ".join(long[20:58])), (2, " ".join(long[30:50])), (3, "none")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(long)), (2, "absent words")], "item_id long, text string")
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.word) for r in longest_matches(d, b).collect()}
    want = {}
    for s in range(60):
        best = (0, 0, 0)
        for i, t in docs:
            w = t.split()
            for p in range(len(w)):
                n = 0
                while p + n < len(w) and s + n < 60 and w[p + n] == long[s + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, p)
        if best[0]:
            want["1", s] = best
    assert got == want
