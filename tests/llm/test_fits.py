"""Fits on texts and pages that are all long, fits without anything to learn from, clashing columns, and ids that share their low bits."""

import random

import numpy as np
from pyspark.sql import functions as F

from pagevault.llm import decontaminate, pages, quality, secrets, toxicity
from pagevault.llm.substrings import remove_repeats
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from test_main_text import article
from test_substrings import brute


def long_text(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def test_classifiers_learn_from_long_texts(spark):
    """Every text has over 100 KB."""
    rng = random.Random(1)
    good, bad = ["clear", "river", "window", "history", "garden"], ["%%%", "###", "idiot", "moron", "scum"]
    rows = [(i, long_text(rng, 18_000, bad if i % 3 == 0 else good), int(i % 3 != 0), int(i % 3 == 0)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(4)
    docs, labels = df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")
    for method, label in ((quality, "quality"), (toxicity, "toxic")):
        scores = method.score(docs, method.fit(docs, labels, F.lit(True))).collect()
        want = {r[0]: r[2 if label == "quality" else 3] for r in rows}
        assert np.mean([(r.score >= 0.5) == want[r.doc_id] for r in scores]) > 0.95


def test_secrets_are_learned_from_long_texts(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    key = lambda: "".join(rng.choice("abcdefABCDEF0123456789ghXYZ") for _ in range(32))
    text = lambda: " ".join(" ".join(word() for _ in range(30)) + f" token = {key()} " for _ in range(300))
    docs = spark.createDataFrame([(i, text()) for i in range(20)] + [(50 + i, long_text(rng, 12_000, [word() for _ in range(500)])) for i in range(10)], "doc_id long, text string")
    planted = [(i, " ".join(word() for _ in range(20)) + f" pwd {key()} " + " ".join(word() for _ in range(20))) for i in range(60)]
    clean = [(100 + i, " ".join(word() for _ in range(50))) for i in range(60)]
    found = {r.doc_id: r.spans for r in secrets.scan(spark.createDataFrame(planted + clean, "doc_id long, text string"), secrets.fit(docs)).collect()}
    recall = np.mean([bool(found[i]) for i, _ in planted])
    false = np.mean([bool(found[i]) for i, _ in clean])
    assert recall > 0.8 and false < 0.1


def test_pages_are_learned_from_long_pages(spark):
    """Every page has over 50 KB."""
    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    more = F.concat(F.lit("</p>"), F.expr("array_join(transform(sequence(1, 900), i -> concat('<p>Long sentence number ', i, ' of text, with some more words.</p>')), '')"), F.lit("<p>"))
    long_ones = given.withColumn("html", F.concat(F.regexp_extract("html", r"(?s)\A(.*?<article>.*?)</p>", 1), more, F.regexp_extract("html", r"(?s)\A.*?<article>.*?</p>(.*)\Z", 1)))
    long_ones = long_ones.filter(F.length("html") > 50_000)
    assert long_ones.count() > 200
    model = pages.fit(long_ones)
    for df, most in ((long_ones.limit(20), 20), (given.limit(100), 100)):
        html = {r.page_id: r.html for r in df.collect()}
        got = pages.main_text(df, model, "page_id").collect()
        assert sum(r.text == article(html[r.page_id]) for r in got) >= 0.95 * most


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(docs, quality.fit(docs, labels, F.lit(True))).collect()} == {0.5}
    plain = toxicity.score(spark.createDataFrame([(1, "you idiot, you stupid scum"), (2, "a river")], docs.schema), toxicity.fit(docs, labels, F.lit(True)))
    assert {r.doc_id: r.score > 0.5 for r in plain.collect()} == {1: True, 2: False}
    none = spark.createDataFrame([(1, None), (2, "")], "page_id long, html string")
    page = spark.createDataFrame([(1, "<article><p>words</p></article>")], "page_id long, html string")
    assert [r.text for r in pages.main_text(page, pages.fit(none), "page_id").collect()] == [""]
    assert {r.spans for r in secrets.scan(docs, secrets.fit(docs.limit(0))).collect()} == {""}


def test_clashing_columns(spark):
    names = ["doc_id", "text", "n_chars", "_a0", "_score_0", "_hit_0", "_text_0", "_TEXT_1"]
    docs = spark.createDataFrame([(1, "token = abcdef123456", 20, "a", "b", "c", "d", "e"), (2, "plain words", 11, "a", "b", "c", "d", "e")], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'string'}" for n in names))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([("i", "plain words")], "item_id string, text string")
    for out in (toxicity.clean(docs, toxicity.fit(docs, labels, F.lit(True))), secrets.redacted(docs, secrets.fit(docs)), decontaminate.decontaminated(docs, items)):
        assert out.columns == names
        assert {tuple(r)[3:] for r in out.collect()} == {("a", "b", "c", "d", "e")}
    assert [r.text for r in decontaminate.decontaminated(docs, items).collect()] == ["token = abcdef123456"]


def test_ids_with_equal_low_bits_and_a_very_long_text(spark):
    rng = random.Random(4)
    run = " ".join(f"r{i}" for i in range(30))
    rows = [(1024 * i, long_text(rng, 40, ["a", "b", "c"]) + " " + (run if i % 5 == 0 else str(i))) for i in range(200)]
    rows.append((1024 * 300, " ".join(f"w{i % 70_000}" for i in range(1_600_000))))  # over 9 MB, with long repeats of its own
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)
