"""Fingerprints: the edited texts exactly, likeness by its bits, the radius search against all pairs."""

import hashlib
import math

import pytest

from pagevault.llm.fingerprints import BITS, edited_fingerprints, fingerprints, within_radius
from pagevault.llm.queries import QUERIES


def apart(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1")


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_query_is_brute_force(spark, sf):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, sf).collect()}
    assert len(got) == len(docs)
    fp = {}
    for k, (i, text) in enumerate(docs):
        nxt, n = docs[(k + 1) % len(docs)], len(text)
        edited = text[: n - n // 2] + nxt[1][: n // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (n, hashlib.sha256(edited.encode()).hexdigest())
        for value, other in ((r.near_edited, r.edited_fingerprint), (r.near_next, got[nxt[0]].fingerprint)):
            assert value == pytest.approx(max(0, math.cos(math.pi * apart(r.fingerprint, other) / BITS)))
        assert fp.setdefault(text, r.fingerprint) == r.fingerprint
    for i, r in got.items():
        want = sum(apart(r.fingerprint, o.fingerprint) <= 8 for o in got.values()) - 1
        assert r.n_near == (want if i % 50 == 0 else None)
    assert sum(r.near_edited > r.near_next for r in got.values()) > 0.97 * len(got)


def test_radius_search_finds_all(spark):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(BITS) for _ in range(6)]
    fps = [b ^ sum(1 << k for k in rng.sample(range(BITS), rng.randint(0, 12))) for b in base for _ in range(25)]
    signed = lambda x: [((x >> 64 * i & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for i in range(BITS // 64)]
    df = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "key long, fp array<bigint>")
    for radius in (0, 3, 8, 20):
        got = [tuple(r) for r in within_radius(df, df, radius).collect()]
        want = sorted((i, j, d) for i, a in enumerate(fps) for j, b in enumerate(fps) if i != j and (d := bin(a ^ b).count("1")) <= radius)
        assert sorted(got) == want


def test_odd_rows(spark):
    rows = [(None, "null id"), (5, None), (5, "a b c"), (5, "a b c"), (9, ""), (9, "word " * 30_000), (12, "日本語" * 7), (1, "one")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for k, (i, text) in enumerate(order):
        t, nxt = text or "", order[(k + 1) % len(order)][1] or ""
        want.append((i or 0, t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]))
    assert sorted((r.doc_id or 0, r.edited) for r in edited_fingerprints(df).collect()) == sorted(want)
    assert edited_fingerprints(df.limit(0)).count() == 0
    one = edited_fingerprints(df.filter("doc_id = 12")).first()
    assert one.near_next == 1  # the only row is its own next
    assert fingerprints(df.selectExpr("text as _text").filter("_text = ''")).first()._fp == [0] * (BITS // 64)


def test_near_copies_are_counted(spark, tmp_path):
    """One and four words of 200 changed (five-word Jaccard 0.95 and 0.82): counted, and as many as brute force finds."""
    import random

    rng = random.Random(5)
    docs = []
    for i in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        one, more = list(words), list(words)
        one[rng.randrange(200)] = "changed"
        for k in range(4):
            more[rng.randrange(200)] = f"other{k}"
        docs += [(50 * i, " ".join(words)), (50 * i + 1, " ".join(one)), (50 * i + 2, " ".join(more)), (50 * i + 3, " ".join(one))]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op1_simhash"](spark, str(tmp_path)).collect()}
    for i, r in got.items():
        for column, radius in (("n_near", 8), ("n_near_copies", 38)):
            want = sum(apart(r.fingerprint, o.fingerprint) <= radius for o in got.values()) - 1
            assert r[column] == (want if i % 50 == 0 else None)
    assert all(r.n_near_copies == 3 for i, r in got.items() if i % 50 == 0)


def test_near_counts_are_brute_force(spark, monkeypatch):
    import random

    from pagevault.llm import fingerprints as module

    monkeypatch.setattr(module, "QUERIES", 60)
    rng = random.Random(7)
    base = [rng.getrandbits(BITS) for _ in range(5)]
    fps = list(dict.fromkeys(b ^ sum(1 << k for k in rng.sample(range(BITS), rng.randint(0, 60))) for b in base for _ in range(40)))
    signed = lambda x: [((x >> 64 * i & (1 << 64) - 1) ^ 1 << 63) - (1 << 63) for i in range(BITS // 64)]
    rows = [(signed(x), i % 3 + 1, i % 2 == 0) for i, x in enumerate(fps)]
    df = spark.createDataFrame(rows, "fp array<bigint>, size long, asks boolean").repartition(3)
    for radii in ((0, 8), (8, 38), (45, 70)):
        got = {tuple(r.fp): (r.n0, r.n1) for r in module.near_counts(df.filter("asks"), df, radii).collect()}
        for i in range(0, len(fps), 2):
            want = tuple(sum(rows[j][1] for j, y in enumerate(fps) if j != i and bin(fps[i] ^ y).count("1") <= r) for r in radii)
            assert got.get(tuple(rows[i][0]), (0, 0)) == want
