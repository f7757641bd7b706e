"""Documents, chunks, search, streams and the store on small tables."""

import hashlib
import math
import random
import re
import time
import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pagevault.operators import chunks as C
from pagevault.operators import docs as D
from pagevault.operators import search as S
from pagevault.operators import versions as V
from pagevault.plans.ingest import compact, current_chunks, current_docs, delete_docs, read_log, store_batch
from pagevault.sources import tables as T


def chunk_texts(spark, text, **kw):
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = C.chunk_docs(df, **kw).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all(r["chunk_total"] == len(rows) for r in rows)
    return [[(i["type"], i["text"] or i["image_url"]) for i in r["content"]] for r in rows]


def reference_packing(blocks, hard, soft, combine):
    """The packing rule as loops."""
    groups = []
    for kind, text in blocks:
        if groups and kind != "title":
            size = sum(map(len, groups[-1])) + 2 * (len(groups[-1]) - 1)
            if size <= soft and size + 2 + len(text) <= hard:
                groups[-1].append(text)
                continue
        groups.append([text])
    out = []
    for g in groups:
        if out:
            size, n = len("\n\n".join(out[-1])), len("\n\n".join(g))
            if size < combine and size + 2 + n <= hard:
                out[-1] += g
                continue
        out.append(list(g))
    return ["\n\n".join(g) for g in out]


def test_packing_against_loops(spark):
    rng = random.Random(1)
    for hard, soft in ((120, 80), (60, 60), (300, 40)):
        blocks = []
        for _ in range(60):
            words = " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(1, 8)))
            blocks.append(("title", f"# {words}"[:50].strip()) if rng.random() < 0.2 else ("text", words[:hard].strip()))
        got = chunk_texts(spark, "\n\n".join(t for _, t in blocks), hard=hard, soft=soft)
        assert [c[0][1] for c in got] == reference_packing(blocks, hard, soft, min(hard, 1500))


def test_long_blocks_are_cut_at_white_space(spark):
    words = " ".join(f"word{i}" for i in range(400))
    got = [c[0][1] for c in chunk_texts(spark, words, hard=100, soft=50)]
    assert all(len(t) <= 100 for t in got) and " ".join(got).split() == words.split()
    run = [c[0][1] for c in chunk_texts(spark, "x" * 250, hard=100)]
    assert "".join(run) == "x" * 250 and max(map(len, run)) == 100
    assert chunk_texts(spark, "  \n\n ") == [] and chunk_texts(spark, "") == []


def test_images_in_chunks(spark):
    text = "before\n\n![a](./p.png)\n\nafter ![b](http://h/q.png 'title') end"
    got = chunk_texts(spark, text, base_path="/base")
    assert got == [[("text", "before"), ("image_url", "/base/p.png"), ("text", "after"), ("image_url", "http://h/q.png"), ("text", "end")]]


def test_reconstruct(spark):
    df = spark.createDataFrame([(1, "a\n\nb\n\n![x](http://i)\n\nc")], "doc_id long, text string")
    assert C.reconstruct_text(C.chunk_docs(df)).first()["text"] == "a\n\nb\n\nc"


def test_merge_cases(spark):
    def state(old, new):
        df = spark.createDataFrame([("u", 0, old), ("u", 1, new)], "url string, ver long, text string")
        r = V.merge_state(df, "url", ["ver"], "text").filter("ver = 1").first()
        return r["merge_type"], r["content"]

    assert state("A\n\nB", "A\n\nB\n\nC") == ("MERGED", "A\n\nB\n\nC")
    assert state("A\n\nB\n\nC", "B") == ("MERGED", "B")
    assert state("A", " A \n\n\nX\n\nY") == ("MERGED", "A \n\nX\n\nY")
    assert state("A", "X\n\nY\n\nZ\n\nA") == ("KEPT_NEW", "X\n\nY\n\nZ\n\nA")
    assert state("A", "X") == ("KEPT_NEW", "X")
    assert state("", "X") == ("KEPT_NEW", "X")
    assert state("A", "") == ("KEPT_EMPTY", "")
    assert state("A", "  ") == ("KEPT_EMPTY", None)
    assert state("A", None) == ("KEPT_EMPTY", None)


def test_chunks_equal(spark):
    def chunks(rows):
        data = [(d, i, [("text", t, None)]) for d, i, t in rows]
        return spark.createDataFrame(data, "doc_id string, chunk_index int, content array<struct<type:string,text:string,image_url:string>>")

    stored = chunks([("same", 0, "a"), ("same", 1, "b"), ("less", 0, "a"), ("less", 1, "b"), ("text", 0, "a"), ("index", 0, "a")])
    new = chunks([("same", 1, "b"), ("same", 0, "a"), ("less", 0, "a"), ("text", 0, "x"), ("index", 1, "a"), ("new", 0, "a")])
    got = {r["doc_id"]: r["chunks_equal"] for r in D.chunks_equal(stored, new).collect()}
    assert got == {"same": True, "less": False, "text": False, "index": False, "new": False}


def test_prepare_and_decode_round_trip(spark):
    df = spark.createDataFrame(
        [("1", ["k"], {"a": "b"}, (1.5, -2.0)), ("2", [], {}, None)],
        "id string, keywords array<string>, metadata map<string,string>, geolocation struct<lon:double,lat:double>",
    )
    stored = T.prepare_docs(df, F.lit("2024-01-01").cast("timestamp")).orderBy("id")
    a, b = stored.collect()
    assert (a["geolocation"], a["metadata"], b["metadata"], b["keywords"], b["participant_metadatas"]) == ("POINT (1.5 -2.0)", '{"a":"b"}', "{}", None, "[]")
    back = {r["id"]: r for r in T.decode_docs(stored).collect()}
    assert (back["1"]["keywords"], back["1"]["metadata"], tuple(back["1"]["geolocation"])) == (["k"], {"a": "b"}, (1.5, -2.0))
    assert (back["2"]["keywords"], back["2"]["metadata"], back["2"]["geolocation"]) == ([], {}, None)
    bad = stored.withColumn("metadata", F.lit("{oops"))
    assert {tuple(r["metadata"].items()) for r in T.decode_docs(bad).collect()} == {()}


def test_update_and_delete(spark):
    stored = spark.createDataFrame([("1", "a", 1), ("2", "b", 2)], "id string, t string, n int")
    new = spark.createDataFrame([("2", None, 5), ("9", "z", 9)], "id string, t string, n int")
    assert sorted(map(tuple, D.update_docs(stored, new).collect())) == [("1", "a", 1), ("2", None, 5)]


@pytest.mark.parametrize("metric", ["l2", "cosine", "dot"])
def test_knn_against_numpy(spark, metric, monkeypatch):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(200, 8)).astype(np.float32)
    vectors[17] = vectors[3]  # a tie: the lower id first
    queries = np.vstack([vectors[3], rng.normal(size=(6, 8)).astype(np.float32)])
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(queries)], "query_id long, vector array<float>")
    a, b = queries.astype(float), vectors.astype(float)
    if metric == "l2":
        d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1))
    elif metric == "dot":
        d = -(a @ b.T)
    else:
        d = np.maximum(1 - (a @ b.T) / np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)), 0)
    want = {(i, int(j), r + 1) for i in range(len(a)) for r, j in enumerate(sorted(range(200), key=lambda j: (round(d[i, j], 12), j))[:5])}
    got = {(r["query_id"], r["vec_id"], r["rank"]) for r in S.knn_exact(q, v, 5, metric).collect()}
    assert got == want
    monkeypatch.setattr(S, "BLOCK_QUERIES", 3)  # several query blocks
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in S.knn_exact(q, v, 5, metric).collect()} == want
    top = [r["vec_id"] for r in S.knn_topk(queries[1].tolist(), v, 5, metric).collect()]
    assert top == [j for i, j, r in sorted(want, key=lambda x: x[2]) if i == 1]


def test_embed_and_search(spark):
    df = spark.createDataFrame([("1", "red apples and pears"), ("2", "fast cars"), ("3", None)], "id string, text string")
    rows = S.embed_text(df, "text")
    norms = [math.sqrt(sum(x * x for x in r["vector"])) for r in rows.orderBy("id").collect()]
    assert [round(n, 5) for n in norms] == [1.0, 1.0, 0.0]
    assert S.vector_search(rows, "pears apples", 1).first()["id"] == "1"
    assert S.vector_search(rows, "pears apples", 1, "id <> '1'").first()["id"] != "1"


def test_embed_inputs(spark):
    df = spark.createDataFrame([(1, "text"), (2, "http://x"), (3, None)], "i int, input string")
    good, bad = S.embed_inputs(df)
    assert [r["i"] for r in good.collect()] == [1] and sorted(r["i"] for r in bad.collect()) == [2, 3]
    items = spark.createDataFrame(
        [(1, [("text", "a", None), ("text", None, None)]), (2, [("odd", None, "http://i")]), (3, [("text", None, None)]), (4, None)],
        "i int, input array<struct<type:string,text:string,image_url:string>>",
    )
    good, bad = S.embed_inputs(items)
    assert {r["i"]: [tuple(x) for x in r["content"]] for r in good.collect()} == {1: [("text", "a", None)], 2: [("image_url", None, "http://i")]}
    assert sorted(r["i"] for r in bad.collect()) == [3, 4]


def _docs(spark, rows):
    df = spark.createDataFrame(rows, "id string, url string, text_content string, h int")
    t = lambda c: F.lit(None).cast("string").alias(c)
    return df.select(
        "id", "url", t("title"), t("description"), t("contact_name"), F.lit("chrome").alias("source"),
        F.lit(None).cast("timestamp").alias("created_at"),
        F.timestamp_micros(F.col("h").cast("long") * 3600000000).alias("ingested_at"),
        F.lit(None).cast("array<string>").alias("keywords"), F.lit(None).cast("map<string,string>").alias("metadata"), "text_content",
    )


def test_store_batches(spark, tmp_path):
    path = str(tmp_path / "store")
    first = _docs(spark, [("a", "u1", "A\n\nB", 1), ("b", "u1", "A\n\nB\n\nC", 2), ("c", "u2", "Z", 1)])
    second = _docs(spark, [("d", "u1", "A\n\nB\n\nD", 3), ("e", "u1", "other\n\ntext", 4), ("f", "u3", "new", 1)])
    store_batch(first, path, 0)
    store_batch(second, path, 1)
    store_batch(second, path, 1)  # a repeated batch changes nothing
    docs = read_log(spark, f"{path}/docs")
    now = {r["id"]: r["text_content"] for r in current_docs(docs).collect()}
    assert now == {"a": "A\n\nB\n\nD", "c": "Z", "e": "other\n\ntext", "f": "new"}
    chunks = current_chunks(docs, read_log(spark, f"{path}/chunks"))
    assert {r["doc_id"]: r["content"][0]["text"] for r in chunks.collect()} == now
    assert docs.count() == 5
    compact(spark, path, str(tmp_path / "small"))
    small = read_log(spark, str(tmp_path / "small" / "docs"))
    assert {r["id"]: r["text_content"] for r in small.collect()} == now


def test_store_deletes(spark, tmp_path):
    path = str(tmp_path / "store")
    store_batch(_docs(spark, [("a", "u1", "A\n\nB", 1), ("b", "u1", "other\n\ntext", 2), ("c", None, "Z", 1)]), path, 0)
    ids = spark.createDataFrame([("b",), ("c",), ("unknown",)], "id string")
    delete_docs(ids, path, 1)
    delete_docs(ids, path, 1)
    state = lambda where: (read_log(spark, f"{where}/docs"), read_log(spark, f"{where}/deleted"))
    now = lambda where: {r["id"]: r["text_content"] for r in current_docs(*state(where)).collect()}
    assert now(path) == {"a": "A\n\nB"}
    # the newest of the URL is gone, so the one before it is continued; a deleted id is a new document
    store_batch(_docs(spark, [("d", "u1", "A\n\nB\n\nC", 3), ("c", None, "Y", 4)]), path, 2)
    assert now(path) == {"a": "A\n\nB\n\nC", "c": "Y"}
    docs, deletes = state(path)
    chunks = current_chunks(docs, read_log(spark, f"{path}/chunks"), deletes)
    assert {r["doc_id"]: r["content"][0]["text"] for r in chunks.collect()} == now(path)
    compact(spark, path, str(tmp_path / "small"))
    small = str(tmp_path / "small")
    store_batch(_docs(spark, [("e", "u1", "A\n\nB\n\nD", 5), ("c", "u9", "Y\n\nX", 6)]), small, 1)
    assert now(small) == {"a": "A\n\nB\n\nD", "c": "Y\n\nX"}


def test_store_ids_and_missing_urls(spark, tmp_path):
    path = str(tmp_path / "store")
    store_batch(_docs(spark, [("a", None, "A\n\nB\n\nC", 1), ("b", None, "A\n\nB\n\nD", 1), ("c", "", "A\n\nB", 1), ("d", "u4", "P\n\nQ", 1)]), path, 0)
    # a known id under another URL continues its document; an unlike text under a known id becomes a new document
    more = _docs(spark, [("d", "u5", "P\n\nQ\n\nR", 2), ("a", None, "something\n\nelse", 3), ("e", None, "A\n\nB", 3), ("e", None, "A\n\nB", 3)])
    store_batch(more.withColumn("contact_identifier", F.lit("@x")), path, 1)
    now = {r["id"]: (r["url"], r["text_content"], r["contact_identifier"]) for r in current_docs(read_log(spark, f"{path}/docs")).collect()}
    assert now == {
        "a": (None, "A\n\nB\n\nC", None), "b": (None, "A\n\nB\n\nD", None), "c": ("", "A\n\nB", None), "d": ("u5", "P\n\nQ\n\nR", "@x"),
        "a@10800000000": (None, "something\n\nelse", "@x"), "e": (None, "A\n\nB", "@x"),
    }
    rows = current_chunks(read_log(spark, f"{path}/docs"), read_log(spark, f"{path}/search"))
    assert {r["doc_id"] for r in rows.collect()} == now.keys() and all(len(r["vector"]) for r in rows.collect())
    with pytest.raises(Exception, match="."):
        read_log(spark, __file__)


def test_store_shuffles_texts_once(spark, tmp_path, monkeypatch):
    """Of a large batch each text goes through one shuffle at most (into the documents); hashes, chunks and search rows need none of it."""
    from pagevault.plans import ingest

    monkeypatch.setattr(ingest, "EVEN_BYTES", 0, raising=False)
    rng, status = random.Random(11), spark.sparkContext._jsc.sc().statusStore()
    texts = ["\n\n".join("%x" % rng.getrandbits(2000) for _ in range(100)) for _ in range(60)]
    rows = [(f"i{n}", f"u{n}" if n % 3 else None, text, 1) for n, text in enumerate(texts)]
    written = lambda: status.executorList(True).apply(0).totalShuffleWrite()
    before, joins = written(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        store_batch(_docs(spark, [*rows, rows[0]]).repartition(4), str(tmp_path / "store"), 0)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", joins)
    # (repartition is one shuffle as well)
    assert written() - before < 2.5 * sum(map(len, texts))
    logs = {name: read_log(spark, f"{tmp_path}/store/{name}") for name in ("docs", "chunks", "search")}
    assert {r["id"]: r["text_content"] for r in logs["docs"].collect()} == {r[0]: r[2] for r in rows} and logs["docs"].count() == len(rows)
    parts = logs["chunks"].orderBy("chunk_index").collect()
    assert {i: "\n\n".join(r["content"][0]["text"] for r in parts if r["doc_id"] == i) for i in ("i0", "i59")} == {"i0": texts[0], "i59": texts[59]}
    assert logs["search"].select("id", "url").exceptAll(logs["chunks"].join(logs["docs"].select(F.col("id").alias("doc_id"), "url"), "doc_id").select("id", "url")).isEmpty()


def test_debounce_stream_equals_table(spark, sf_dir, tmp_path):
    from pagevault.plans.streams import drain
    from pagevault.streaming import interactions as X

    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    last = events.agg(F.max("ts").alias("ts"))
    closing = last.select(F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 90 days")).alias("ts"), F.lit(-1).cast("long").alias("user_id"))
    events.write.parquet(str(tmp_path / "in" / "d=1"))
    closing.write.parquet(str(tmp_path / "in" / "d=2"))
    stream = spark.readStream.schema("event_id long, ts timestamp, user_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = {(r["user_id"], r["first_at"], r["n_events"]) for r in drain(X.debounce_stream(stream, gap="6 hours")).collect()}
    want = X.debounce(events, gap_ms=6 * 3600 * 1000).select("user_id", F.timestamp_micros("first_us").alias("first_at"), "n_events")
    assert {g for g in got if g[0] != -1} == {(r["user_id"], r["first_at"], r["n_events"]) for r in want.collect()}


def test_hashed_words_against_a_loop(monkeypatch):
    def slow(text):
        out = np.zeros(64)
        for word in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
            h = 0
            for b in "".join(c.lower() if "A" <= c <= "Z" else c for c in word).encode():
                h = (h * S.WORD_BASE + b) % S.WORD_PRIME
            out[h % 64] += 1
        return out / (np.linalg.norm(out) or 1)

    rng = random.Random(3)
    texts = [None, "", "a", "x" * 100_000, "Ab-c", "ß a", "-", "", "a", "日本 ß", *("".join(rng.choice("aBc ß,1日 ") for _ in range(rng.randint(0, 40))) for _ in range(80))]
    want = np.array([slow(t) for t in texts])
    assert np.allclose(S.hashed_bow(pd.Series(texts, dtype=object), "document"), want)
    monkeypatch.setattr(S, "_PIECE", 10)
    assert np.allclose(S.hashed_bow(pd.Series(texts, dtype=object), "document"), want)
    assert S.hashed_bow(pd.Series([], dtype=object), "query").shape == (0, 64)


def test_model_is_loaded_once(spark, tmp_path):
    def load():
        with open(f"{tmp_path}/{uuid.uuid4().hex}", "w"):
            pass
        return lambda texts, mode: np.array([[len(t), mode == "query"] for t in texts], np.float64)

    df = spark.createDataFrame([(i, "x" * (i % 9) if i % 10 else None) for i in range(3000)], "i long, text string").coalesce(1)
    got = {r.i: list(r.vector) for r in S.embed_with_model(df, "text", load, mode="query", batch=100).collect()}
    assert got == {i: [float(i % 9 if i % 10 else 0), 1.0] for i in range(3000)}
    assert len(list(tmp_path.iterdir())) == 1


def test_packing_of_very_many_blocks():
    """Boundaries of 300 000 blocks in linear time, and those of the plain rule."""
    rng = random.Random(8)
    some = [(rng.randint(1, 90), rng.random() < 0.1) for _ in range(3000)]
    texts = [("title" if title else "text", "x" * n) for n, title in some]
    got = ["\n\n".join(t for _, t in texts[a : a + n]) for a, n in C._bounds(some, 300, 200, 150)]
    assert got == reference_packing(texts, 300, 200, 150)
    start = time.perf_counter()
    bounds = C._bounds(some * 100, 300, 200, 150)
    assert time.perf_counter() - start < 5 and sum(n for _, n in bounds) == 300_000


def test_md5_words_against_a_loop(monkeypatch):
    """Words in lower case in every script, by their md5."""

    def slow(text):
        out = np.zeros(64)
        for word in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower()):
            out[int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % 64] += 1
        return out / (np.linalg.norm(out) or 1)

    rng = random.Random(4)
    texts = [None, "", "a", "x" * 100_000, "Ab-c", "ß a", "-", "", "É É é", "日本 Жж", *("".join(rng.choice("aBc ÉßЖ,1日\x00 ") for _ in range(rng.randint(0, 40))) for _ in range(80))]
    want = np.array([slow(t) for t in texts])
    assert np.allclose(S.word_bow(pd.Series(texts, dtype=object), "document"), want)
    monkeypatch.setattr(S, "_PIECE", 10)
    assert np.allclose(S.word_bow(pd.Series(texts, dtype=object), "document"), want)
    assert S.word_bow(pd.Series([], dtype=object), "query").shape == (0, 64)


def test_capital_letters_of_all_scripts_embed_alike(spark, tmp_path):
    from pagevault.plans import all_queries

    spark.createDataFrame([(1, "ÉTÉ Жук"), (2, "été жУК")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = all_queries()["embed_text"](spark, str(tmp_path)).collect()
    slots = lambda n: sorted((r.slot, r.value) for r in rows if r.doc_id == n)
    assert slots(1) == slots(2) and len(slots(1)) == 2
