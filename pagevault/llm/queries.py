"""The registered queries opN_<name> and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagevault.llm import bpe, decontaminate, fingerprints, infill, jaccard, pages, quality, resample, secrets, sharding, substrings, toxicity, warc
from pagevault.llm.frames import table, written
from pagevault.llm.sample import fold


def op1_simhash(spark, sf_dir):
    """Fingerprints and their likeness; for ids divisible by 50 (null for the others) how many other rows lie within the radius:
    n_near within RADIUS, n_near_copies within COPY_RADIUS, which finds the near copies."""
    rows = written(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")).drop("edited"))
    asks = F.coalesce(F.col("doc_id") % 50 == 0, F.lit(False))
    classes = written(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("size"), F.max(asks).alias("asks")))
    near = fingerprints.near_counts(classes.filter("asks"), classes, (fingerprints.RADIUS, fingerprints.COPY_RADIUS))
    own, more = F.col("size") - 1, lambda n: F.coalesce(F.col(n), F.lit(0))
    counted = classes.filter("asks").join(near, "fp", "left").select("fp", (own + more("n0")).alias("n_near"), (own + more("n1")).alias("n_near_copies"))
    out = rows.join(counted, "fp", "left").withColumns({n: F.when(asks, F.col(n)) for n in ("n_near", "n_near_copies")})
    return out.drop("fp")


def op2_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def _scored(spark, sf_dir, method, held_out):
    """Scores by a model that is fitted on labels outside `held_out`."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = method.score(docs, method.fit(docs, labels, ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= method.THRESHOLD).cast("int").alias("predicted"))


def op3_quality(spark, sf_dir):
    return _scored(spark, sf_dir, quality, fold("doc_id", 5) == 0)


def op4_bpe(spark, sf_dir):
    return bpe.encode(table(spark, sf_dir, "documents"), tokens=False)


def op5_decontamination(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op6_main_text(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    return pages.main_text(rows, pages.fit(rows), "page_id", "url")


def op7_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs), redacted=False)


def op8_toxicity(spark, sf_dir):
    return _scored(spark, sf_dir, toxicity, fold("doc_id", 3) == 1)


def op9_extendible_sharding(spark, sf_dir):
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark, sf_dir):
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).drop("kept")


def op11_fill_in_middle(spark, sf_dir):
    out = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = {f"{n}_sha256": F.sha2(c.cast("binary"), 256) for n, c in (("output", F.col("output")), ("restored", infill.restored(F.col("output"), F.col("form"))))}
    return out.withColumns(digests).drop("output")


def op12_resampling(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc(spark, sf_dir):
    return warc.page_records(spark, table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_jaccard_join, op3_quality, op4_bpe, op5_decontamination, op6_main_text, op7_secrets, op8_toxicity,
        op9_extendible_sharding, op10_substring_dedup, op11_fill_in_middle, op12_resampling, op13_warc,
    )
}
ORACLE = {
    "op5_decontamination": decontaminate.SQL,
    "op9_extendible_sharding": sharding.SQL,
    "op11_fill_in_middle": infill.SQL,
    "op12_resampling": resample.SQL,
    "op13_warc": warc.SQL,
}
