"""The pipeline's stages, each against brute force on what the stage before kept."""

import sys
from pathlib import Path

import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from pagevault.llm.bpe import default_vocabulary
from pagevault.llm.frames import written
from pagevault.llm.queries import QUERIES
from test_decontaminate import brute as contaminated
from test_jaccard import brute as near
from test_secrets import brute as base

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SF)))
    return out


def test_stages(spark, results):
    docs, clean, single, apart, bare, ids = results
    for df in results[1:-1]:
        assert df.dtypes == docs.dtypes
    rows = [{r.doc_id: r for r in df.collect()} for df in results]
    bad = {r.doc_id for r in QUERIES["op8_toxicity"](spark, SF).collect() if r.predicted}
    assert rows[1] == {i: r for i, r in rows[0].items() if i not in bad} and bad
    groups = near([(i, r.text) for i, r in rows[1].items()])
    assert rows[2] == {i: r for i, r in rows[1].items() if groups[i][1] == i} and len(rows[2]) < len(rows[1])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = {r[0] for r in contaminated([(i, r.text) for i, r in rows[2].items()], items) if r[-1]}
    assert rows[3] == {i: r for i, r in rows[2].items() if i not in hit}
    assert rows[4].keys() == rows[3].keys()
    for i, r in rows[4].items():
        assert r.n_chars == len(r.text)
        assert sum(base(r.text)[:3]) == 0
        if not sum(base(rows[3][i].text)[:3]):
            assert r == rows[3][i]
    library = Tokenizer.from_file(default_vocabulary())
    assert {i: r.ids for i, r in rows[5].items()} == {i: library.encode(r.text, add_special_tokens=False).ids for i, r in rows[4].items()}


def test_run_is_the_stages(spark, results):
    key = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(results[-1])


def test_odd_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(None, None, None, None, None, None), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, text, None, "s", 5, None), (2, text, None, "s", 5, None), (3, text + " more", "de", "s", 1, "y"), (4, "token = abcdef123456", "en", None, 20, "z"), (5, "long " * 50_000, "en", "s", 1, "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, SF))
        assert now.dtypes == docs.dtypes
    got = sorted((r.doc_id or 0, r.text or "", r.score or "") for r in now.collect())
    assert got == sorted([(0, "", ""), (1, "", "x"), (1, "", "x"), (2, text, ""), (4, "[secret]", "z"), (5, "long " * 50_000, "w")])
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF).count() == 6
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = written(stage(spark, empty, SF)) if _ != "bpe" else stage(spark, empty, SF)
    assert empty.count() == 0
