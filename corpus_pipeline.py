"""From documents to token ids: toxic texts go, one of each group of near copies stays, texts with benchmark passages go,
secrets are replaced, and what is left is encoded. Each stage's result is written as Parquet and read again as the next one's input.

Stages take nulls in any column, empty and very long texts, repeated rows, empty tables and further columns: rows that a stage keeps pass
through whole. Null texts count as empty; they are clean, alone in their group, without passages or secrets, and have no tokens.
"""

from __future__ import annotations

from pagevault.llm import bpe, decontaminate, jaccard, secrets, toxicity
from pagevault.llm.frames import table, written
from pagevault.llm.sample import fold


def clean_of_toxicity(spark, docs, sf_dir):
    """Operator 8. The model learns from the labels outside the held-out fold of op8."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return toxicity.clean(docs, model)


def one_of_near_copies(spark, docs, sf_dir):
    """Operator 2. The smallest doc_id of each component stays."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark, docs, sf_dir):
    """Operator 5."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark, docs, sf_dir):
    """Operator 7. All rows stay; secrets in them are replaced, and n_chars follows."""
    return secrets.redacted(docs, secrets.fit(docs))


def encoded(spark, docs, sf_dir):
    """Operator 4: doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    return bpe.encode(docs).drop("decoded")


STAGES = [
    ("toxicity", clean_of_toxicity),
    ("jaccard_join", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("bpe", encoded),
]

#: Scores of a fitted classifier are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over `documents`."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
