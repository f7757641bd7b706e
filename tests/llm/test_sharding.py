"""Extendible hashing against SQL and against its own promises."""

import collections

import duckdb

from pagevault.llm.queries import ORACLE, QUERIES
from pagevault.llm.sharding import extendible_shards


def test_query_is_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = QUERIES["op9_extendible_sharding"](spark, sf)
    cur = con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op9_extendible_sharding']})")
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())
    assert df.select("shard").distinct().count() > 2


def test_limits_hold(spark):
    rows = [(i, "x" * (i % 50)) for i in range(300)] + [(7, "copy" * 10)] * 40 + [(None, "n" * 500), (None, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, shard string").repartition(3)
    out = extendible_shards(df, limit=200).collect()
    assert sorted((r.doc_id or 0, r.n_bytes) for r in out) == sorted((i or 0, len(t or "")) for i, t in rows)
    held = collections.defaultdict(list)
    for r in out:
        held[r.shard, r.page].append(r)
        assert len(r.shard) == r.depth
    for members in held.values():
        total = sum(r.n_bytes for r in members)
        assert {r.shard_bytes for r in members} == {total}
        assert total <= 200 or len(members) == 1
    names = {r.shard for r in out}
    assert not any(a != b and b.startswith(a) for a in names for b in names)  # prefixes of buckets don't nest
    assert extendible_shards(df.limit(0)).count() == 0
