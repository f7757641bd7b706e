"""What a Python worker holds at a time is bounded, whatever a batch has; the results do not depend on the bound."""

import tracemalloc

import numpy as np
import pyarrow as pa

from pagevault.operators import html as H
from pagevault.operators import keyindex as K
from pagevault.operators import search as S


def test_tokens_are_handed_on_in_portions(monkeypatch):
    pages = ["<p>a</p>" * n for n in (50, 1, 0, 400, 3, 3)] + [None]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(pages))), "html": pages})
    whole = pa.Table.from_batches(H._token_batches(iter([batch]), ["page_id"], "html"))
    monkeypatch.setattr(H, "PARSE_BYTES", 500)
    parts = list(H._token_batches(iter([batch]), ["page_id"], "html"))
    assert [p.num_rows for p in parts] == [3, 1, 3]  # one page beyond the bound stays alone
    assert pa.Table.from_batches(parts).to_pylist() == whole.to_pylist()


def test_sums_are_made_in_portions(monkeypatch):
    rows = [[{"pos": i, "end_pos": n - 1 - i, "code": 1 + 2 * (i % 2), "length": i} for i in range(n)] for n in (4, 0, 9, 2, 5)]
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("pos", "end_pos", "code", "length")]))
    tokens, real, seen = pa.array(rows, kind), H._sums_at_once, []
    whole = H._sums(tokens).to_pylist()
    monkeypatch.setattr(H, "SUM_TOKENS", 5)
    monkeypatch.setattr(H, "_sums_at_once", lambda t: seen.append(len(t.flatten())) or real(t))
    assert H._sums(tokens).to_pylist() == whole and seen == [4, 9, 2, 5]


def test_neighbours_do_not_depend_on_the_step(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(300)] + [(300, [float("nan")] * 4), (301, None)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame(rows[:9], "query_id long, vector array<double>")
    monkeypatch.setattr(S, "STEP_CELLS", 90)
    got = {(r.query_id, r["rank"]): r.vec_id for r in S.knn_exact(asked, vectors, 7, "dot").collect()}
    for q, v in rows[:9]:
        near = sorted((-float(np.dot(v, w)), i) for i, w in rows[:300])[:7]
        assert [got[q, n + 1] for n in range(7)] == [i for _, i in near]


def test_texts_are_embedded_in_portions(monkeypatch):
    texts = pa.array(["ab cd", None, "", "x" * 50, "ab", "cd e"])
    whole, seen = S._vectors(texts, S.hashed_bow, "document").to_pylist(), []
    monkeypatch.setattr(S, "EMBED_BYTES", 9)
    parts = S._vectors(texts, lambda some, mode: seen.append(list(some)) or S.hashed_bow(some, mode), "document")
    assert parts.to_pylist() == whole and seen == [["ab cd", None, ""], ["x" * 50], ["ab", "cd e"]]
    assert S._vectors(texts.slice(0, 0), S.hashed_bow, "document").to_pylist() == []


def test_filters_of_a_large_bucket_take_little_memory():
    h = np.random.default_rng(5).integers(-(1 << 62), 1 << 62, 300_000)
    rows, key = pa.table({"bucket": np.zeros(len(h), np.int64), "h": h}), (pa.scalar(0, pa.int64()),)
    tracemalloc.start()
    blooms = K._filters(key, rows)
    found = K._possible(key, rows, blooms)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found.num_rows == len(h) and peak < 25 << 20  # 6 positions of 8 bytes for each hash are 14 MB alone, and there are several such arrays
    others = pa.table({"bucket": rows["bucket"], "h": h + 1})
    assert K._possible(key, others, blooms).num_rows < 0.01 * len(h)
