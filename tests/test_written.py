"""Written tables: look-ups that skip row groups, and updates that leave other files alone."""

import os
import re

import pandas as pd
from pyspark.sql import functions as F

from pagevault.operators.docs import doc_by_id, docs_by_url
from pagevault.sources import tables as T


def files(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def scanned(df):
    """Rows that the scan gives out."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    node = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(n):
        if "FileSourceScan" in n.getClass().getSimpleName():
            found.append(n.metrics().get("numOutputRows").get().value())
        for i in range(n.children().size()):
            walk(n.children().apply(i))
        if re.search("AdaptiveSparkPlan", n.getClass().getSimpleName()):
            walk(n.executedPlan())
        if hasattr(n, "plan") and "QueryStage" in n.getClass().getSimpleName():
            walk(n.plan())

    walk(node)
    assert found, plan
    return sum(found)


def test_lookups_skip_row_groups(spark, tmp_path):
    n = 40_000
    ids = F.md5(F.col("id").cast("string"))
    docs = spark.range(n).select(ids.alias("id"), F.concat(F.lit("http://host/"), F.md5(ids)).alias("url"), F.lit("s").alias("source"), F.lit(None).cast("timestamp").alias("ingested_at")).repartition(8)
    T.write_docs(docs, f"{tmp_path}/docs")
    stored = spark.read.parquet(f"{tmp_path}/docs")
    some = docs.filter(F.col("id") == F.md5(F.lit("77"))).first()
    one = doc_by_id(stored, some["id"])
    assert one.count() == 1 and scanned(one) <= n / 4
    assert scanned(doc_by_id(stored, "0" * 31 + "x")) == 0  # lies between the least and the greatest id of each file
    # URLs are in no order: only the Bloom filter tells
    by_url = docs_by_url(stored, some["url"])
    assert [r["id"] for r in by_url.collect()] == [some["id"]] and scanned(by_url) <= n / 4


def test_updates_leave_other_files(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"t{i}", f"s{i % 5}") for i in range(50)], "id string, title string, source string")
    path = f"{tmp_path}/docs"
    T.write_docs(docs, path)
    before = files(path)
    # 3 changes in its folder, all of s1 moves to s4 and a new folder, 99 is unknown
    new = spark.createDataFrame([("3", None, "s3"), ("99", "x", "s0"), *((str(i), "moved", "s4" if i < 30 else "n:w/ s") for i in range(1, 50, 5))], docs.schema)
    for _ in range(2):
        T.update_written_docs(path, new)
        got = {r["id"]: (r["title"], r["source"]) for r in spark.read.parquet(path).collect()}
        changed = {r["id"]: (r["title"], r["source"]) for r in new.collect() if r["id"] != "99"}
        assert got == {str(i): (f"t{i}", f"s{i % 5}") for i in range(50)} | changed
    kept = {f for f in before if f.startswith(("source=s0", "source=s2"))}
    assert kept and kept <= files(path) and not any(f.startswith("source=s1") for f in files(path))


def test_deletes_leave_other_files(spark, tmp_path):
    path = f"{tmp_path}/chunks"
    chunks = spark.range(400).select((F.col("id") % 40).cast("string").alias("doc_id"), F.col("id").alias("chunk_index"), F.lit("c").alias("content"))
    T.write_chunks(chunks, path, buckets=16)
    before = files(path)
    ids = spark.createDataFrame([("7",), ("8",), ("nine",)], "doc_id string")
    T.delete_written_chunks(path, ids, buckets=16)
    assert {r["doc_id"] for r in spark.read.parquet(path).collect()} == {str(i) for i in range(40)} - {"7", "8"}
    touched = {f"bucket={r[0]}" for r in ids.select(F.pmod(F.xxhash64("doc_id"), F.lit(16))).collect()}
    assert {f for f in before if f.split("/")[0] not in touched} <= files(path) and len(touched) < 16
    T.delete_written_chunks(path, chunks.select("doc_id"), buckets=16)  # every folder is emptied
    assert files(path) == set()


def test_hundred_thousand_phrases(spark):
    from pagevault.operators import noise as N

    rules = spark.range(100_000).select(F.concat(F.lit("Phrase "), F.hex("id"), F.lit("!")).alias("phrase"))
    lines = spark.createDataFrame([(1, "some phrase 1869F! here"), (2, "phrase 186A0! is none"), (3, None), (4, "PHRASE 0!"), (5, "kept whatever: phrase 1!"), (6, "")], "i int, line string")
    got = N.noise_filter_rules(lines, "line", rules.union(rules.limit(5)), keep=F.col("i") == 5)
    assert sorted(r.i for r in got.collect()) == sorted(r.i for r in N.noise_filter(lines, "line").collect() if r.i in (2, 5, 6))
    assert N.noise_filter_rules(lines, "line", rules.limit(0)).count() == N.noise_filter(lines, "line").count()
    every = spark.createDataFrame([("",), (None,)], "phrase string")
    assert [r.i for r in N.noise_filter_rules(lines, "line", every, keep=F.col("i") == 5).collect()] == [5]


def test_phrases_in_parts(spark, monkeypatch):
    from pagevault.operators import noise as N

    monkeypatch.setattr(N, "AUTOMATON_BYTES", 200)
    rules = spark.createDataFrame([(f"word{i}x",) for i in range(30)], "phrase string")
    lines = spark.createDataFrame([(i, f"a line with word{i}x in it") for i in range(40)], "i int, line string")
    assert sorted(r.i for r in N.noise_filter_rules(lines, "line", rules).collect()) == list(range(30, 40))


def test_export_converts_a_page_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        seen.add(len(html))
        return html.str.upper()

    rows = [(f"s{i:02d}", [None, "", f"<p>{i}</p>"][i % 3]) for i in range(30)]
    pages = spark.createDataFrame(rows, "slug string, html string")
    T.export_pages(pages.select("slug", convert("html").alias("markdown")), pages, str(tmp_path))
    assert seen.value == 30
    kept = [(s, h) for s, h in rows if h]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/html").collect())) == kept
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/md").collect())) == [(s, h.upper()) for s, h in kept]
