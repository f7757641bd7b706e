"""Resampling against SQL and a plain version; CRCs against zlib."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa

from pagevault.llm import resample as R
from pagevault.llm.queries import ORACLE, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def test_crc_is_zlib():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8)
    starts = np.concatenate((rng.integers(0, 1000, 500), np.zeros(4, int), [7]))
    ends = np.concatenate((starts[:500] + rng.integers(1, 400, 500), [64, 65, 128, 129], [300_000]))
    got = R.Crc()(data, starts, ends)
    assert got.tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]
    assert len(R.Crc()(data, starts[:0], ends[:0])) == 0


def grams(text, widest):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i : i + k]) for k in range(1, widest + 1) for i in range(len(w) - k + 1)], len(w)


def test_features():
    rng = random.Random(2)
    texts = [None, "", "Ä b-C", "x" * 500 + " y", *("".join(rng.choice("aBc ß,1日 ") for _ in range(rng.randint(0, 80))) for _ in range(60))]
    for widest in (1, 2, 4):
        h, doc, n = R.features(pa.array(texts), widest, R.Crc())
        want = [grams(t, widest) for t in texts]
        assert n.tolist() == [w for _, w in want]
        for i, (g, _) in enumerate(want):
            assert sorted(h[doc == i].tolist()) == sorted(zlib.crc32(x.encode()) for x in g)


def brute(docs, target, buckets=R.BUCKETS, widest=1, seed="2024", least=20, percent=10):
    said = [grams(t, widest) for _, t in docs]
    s = collections.Counter(zlib.crc32(x.encode()) % buckets for g, _ in said for x in g)
    t = collections.Counter(zlib.crc32(x.encode()) % buckets for text in target for x in grams(text, widest)[0])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for (i, _), (g, n) in zip(docs, said):
        weight = sum(gain(zlib.crc32(x.encode()) % buckets) for x in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2]))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


def key(r):
    return tuple((v is not None, v or 0) for v in r)


def test_odd_rows(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(50)] + ["ß", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(None, None), (None, text(30)), (5, ""), (7, text(25)), (8, "long " * 200_000)]
    docs += [(9, "Same words " * 12)] * 40
    target = [None, "", text(50), "long words " * 5]
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, rank int, weight string").repartition(5)
    aim = spark.createDataFrame([(t, 0) for t in target], "text string, bucket int")
    for widest, buckets, percent in ((1, R.BUCKETS, 10), (2, 97, 50)):
        got = R.resample(df, aim, widest=widest, buckets=buckets, percent=percent).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, target, buckets, widest, percent=percent), key=key)
    empty = R.resample(df, aim.limit(0)).collect()
    assert sorted(map(tuple, empty), key=key) == sorted(brute(docs, []), key=key)
    assert R.resample(df.limit(0), aim).count() == 0


def test_query(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = QUERIES["op12_resampling"](spark, sf_dir)
    got = sorted(map(tuple, df.collect()), key=key)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op12_resampling']})")
    assert got == sorted(cur.fetchall(), key=key)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert got == sorted(brute(docs, target), key=key)
    assert sum(r[4] is not None for r in got) > 5
