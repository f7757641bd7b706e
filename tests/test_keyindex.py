"""The levelled key index against a dictionary, and how much a look-up reads."""

import os
import random

from pyspark.sql import functions as F

from pagevault.operators.keyindex import KeyIndex

SCHEMA = "k string, id string, v long, deleted boolean"


def test_against_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    index = KeyIndex(spark, str(tmp_path), "v long", rows=20, fanout=2)
    known: dict[tuple, int | None] = {}
    asked = [f"k{i}" for i in range(60)] + ["never"]
    for batch in range(9):
        entries = {}
        for _ in range(rng.choice([0, 5, 40] if batch != 1 else [0])):
            entries[f"k{rng.randrange(50)}", rng.choice("ab")] = (rng.randrange(1000), rng.random() < 0.3)
        rows = [(*key, v, gone) for key, (v, gone) in entries.items()]
        want = {(*k, v) for k, v in known.items() if v is not None}
        keys = spark.createDataFrame([(k,) for k in asked + asked[:3] + [None]], "k string")
        for _ in range(2):  # a batch that runs again after a failure sees and leaves the same
            assert {(r.k, r.id, r.v) for r in index.lookup(keys, batch).collect()} == want
            index.add(spark.createDataFrame(rows, SCHEMA), batch)
        for key, (v, gone) in entries.items():
            known[key] = None if gone else v
    want = {(*k, v) for k, v in known.items() if v is not None}
    assert {(r.k, r.id, r.v) for r in index.everything(9).collect()} == want
    runs = index.runs(9)
    assert len(runs) <= 4 and max(r.level for r in runs) >= 2 and sorted(b for r in runs for b in (r.first, r.last)) == [b for r in runs for b in (r.first, r.last)]
    assert KeyIndex(spark, str(tmp_path / "none")).lookup(keys, 0).count() == 0


def test_deletions_vanish_with_the_oldest_run(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path), "v long", fanout=2)
    one = lambda v, gone: spark.createDataFrame([("k", "a", v, gone)], SCHEMA)
    index.add(one(1, False), 0)
    index.add(one(2, True), 1)
    index.add(one(3, False).limit(0), 2)
    assert index.runs(3) == [] and index.lookup(one(0, False), 3).count() == 0


def bytes_of(path, index, runs, buckets):
    return sum(
        os.path.getsize(os.path.join(d, f))
        for kind in ("entries", "blooms")
        for i, some in buckets.items()
        for b in some
        for d, _, files in os.walk(f"{index._at(kind, runs[i])}/bucket={b}")
        for f in files
        if f.endswith(".parquet")
    )


def test_reads_stay_level(spark, tmp_path):
    """A look-up of 20 keys reads no more of an index of ten times the entries, and nothing for keys that are not there."""
    index = KeyIndex(spark, str(tmp_path), rows=500, fanout=4)
    entries = lambda a, b: spark.range(a, b).select(F.concat(F.lit("http://host/"), "id").alias("k"), F.lit("").alias("id"), F.lit(False).alias("deleted"))
    keys = entries(0, 20)
    read = []
    for batch, (a, b) in enumerate([(0, 4000), (4000, 40_000)]):
        index.add(entries(a, b), batch)
        runs, hits, buckets = index.possible(keys, batch + 1)
        assert {r.k for r in hits.collect()} == {r.k for r in keys.collect()}
        read.append((sum(map(len, buckets.values())), bytes_of(tmp_path, index, runs, buckets)))
    assert read[1][0] <= read[0][0] + 2 and read[1][1] < 1.5 * read[0][1]
    _, hits, buckets = index.possible(entries(10**6, 10**6 + 200), 2)
    assert hits.count() <= 3 and sum(map(len, buckets.values())) <= 3
