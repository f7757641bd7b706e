"""Components of the Jaccard join against all pairs."""

import random
import re

import pyarrow as pa

from pagevault.llm import jaccard as J
from pagevault.llm import words as W
from pagevault.llm.components import components
from pagevault.llm.jaccard import jaccard_components
from pagevault.llm.queries import QUERIES


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=80):
    """rows: (id, text), ids distinct -> id: (set size, component)."""
    sets = [(i, shingles(t)) for i, t in rows]
    home = {i: i for i, _ in rows}

    def root(i):
        while home[i] != i:
            i = home[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    a, b = sorted((root(i), root(j)))
                    home[b] = a
    return {i: (len(x), root(i)) for i, x in sets}


def test_query_is_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_jaccard_join"](spark, sf).collect()}
    assert got == brute(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_chains_and_thresholds(spark):
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, i = [], 0
    for _ in range(12):
        text = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(25):  # each a little off the one before or off the first: chains, stars, pairs about the threshold
            rows.append((i, " ".join(text)))
            i += 1
            text = list(text)
            for _ in range(rng.randint(0, 2)):
                text[rng.randrange(len(text))] = word()
    shared = " ".join(word() for _ in range(60))  # one passage in many texts that are otherwise unlike
    rows += [(i + k, shared + " " + " ".join(word() for _ in range(40))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
    assert got == brute(rows)


def test_odd_rows(spark):
    a, b = " ".join(map(str, range(40))), " ".join(map(str, range(41)))
    rows = [(None, a), (3, b), (3, "x Y"), (4, "X\ty"), (5, None), (6, ""), (7, " \n"), (8, a.upper()), (8, a.upper()), (9, "long " * 30_000)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n int, comp string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_components(df).collect())
    assert got == sorted([(0, 36, 0), (3, 37, 0), (3, 1, 3), (4, 1, 3), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 36, 0), (8, 36, 0), (9, 1, 9)])
    assert jaccard_components(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(60)] + [(300, k) for k in range(301, 380)] + [(5, 5)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    home = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in home:
        for a, b in edges:
            if a != b:
                home[a] = home[b] = min(home[a], home[b])
    assert got == home


def test_frequent_shingles_are_counted_over_all_texts(spark, monkeypatch):
    seen, real = [], J._nodes
    monkeypatch.setattr(J, "_nodes", lambda width, percent, shared: seen.append(shared.value) or real(width, percent, shared))
    texts = ["a b c d e"] * 100 + ["f g h i j"] * 60 + ["k l m n o"] * 47 + [f"only {i} of its kind" for i in range(4000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert jaccard_components(docs).filter("component_id <> doc_id").count() == 99 + 59 + 46
    frequent, rank = seen[0]
    hashes = [int(J._sets(*W.utf8(pa.array([t])), 5)[0][0]) for t in (texts[0], texts[100])]
    assert dict(zip(frequent.tolist(), rank.tolist())) == {hashes[0]: 2, hashes[1]: 1}  # the most frequent one comes last
