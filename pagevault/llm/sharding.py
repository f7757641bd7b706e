"""Shards of bounded size by extendible hashing, with DataFrame functions only.

A row's 60-bit hash comes from its id and text. The directory maps hash prefixes to buckets; a bucket over the byte limit splits on the next
bit, and only such a bucket. So a row's bucket is its shortest hash prefix whose rows fit the limit. Prefix sums over the cells of a fine
directory (a few cells for each shard) give all splits of many levels at once; where a cell itself is over the limit, the rows in
such cells, and only they, go one round deeper. A prefix that holds one hash alone cannot split: its rows are copies
of one row, which fill overflow pages by count, so even those shards stay within the limit unless one row is larger.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60
LIMIT = 1 << 20  # bytes of text in a shard of the registered query; small, so that small tables split as well
STEP = 8  # more bits for cells that are too large


def _hash(id_col: str, text_col: str) -> Column:
    text = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _prefix(bits: int, h: str = "_h") -> Column:
    return F.shiftright(F.col(h), BITS - bits)


def _directory(rows: DataFrame, bits: int, above: int, limit: int) -> DataFrame:
    """cell, depth, prefix and the bucket's bytes for each cell of `bits` bits; depth is null where even the cell is over the limit."""
    stats = [F.sum("_sum").alias("_sum"), F.min("_low").alias("_low"), F.max("_high").alias("_high")]
    cells = (
        rows.select(_prefix(bits).alias("_cell"), (F.col("_n") * F.col("_bytes")).alias("_sum"), F.col("_h").alias("_low"), F.col("_h").alias("_high"))
        .groupBy("_cell").agg(*stats)
    )
    depths = cells.select("*", F.explode(F.sequence(F.lit(above), F.lit(bits))).alias("_depth"))
    at = depths.withColumn("_prefix", F.expr(f"shiftright(_cell, {bits} - _depth)"))
    sums = at.groupBy("_depth", "_prefix").agg(*stats)
    fits = sums.filter((F.col("_sum") <= limit) | (F.col("_low") == F.col("_high"))).select("_depth", "_prefix", F.col("_sum").alias("_bucket"))
    found = at.select("_cell", "_depth", "_prefix").join(fits, ["_depth", "_prefix"])
    return found.groupBy("_cell").agg(F.min(F.struct("_depth", "_prefix", "_bucket")).alias("_at"))


def extendible_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """The id, n_bytes, shard (its bits, '' for the root), depth, page and shard_bytes (of shard and page) of each row.

    page is 0 but for copies of one row (same id, same text) that exceed the limit together. A row larger than the limit has a shard
    or page of its own. A null text has 0 bytes; null ids hash as ''. An empty table gives an empty result.
    """
    raw = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("_bytes"), _hash(id_col, text_col).alias("_h"))
    rows = raw.groupBy("_id", "_h", "_bytes").agg(F.count(F.lit(1)).alias("_n"))
    total = raw.agg(F.sum("_bytes")).first()[0] or 0
    bits, above, parts = min(BITS, max(1, (4 * total // limit).bit_length())), 0, []
    while True:
        directory = _directory(rows, bits, above, limit)
        open_rows = rows.join(directory, _prefix(bits) == F.col("_cell"), "left_anti")
        parts.append(rows.join(directory, _prefix(bits) == F.col("_cell")))
        if bits == BITS or open_rows.isEmpty():
            break
        rows, above, bits = open_rows, bits + 1, min(BITS, bits + STEP)
    out = reduce(DataFrame.unionByName, (p.drop("_cell") for p in parts))
    per_page = F.greatest(F.lit(1), F.expr(f"{limit} div greatest(_bytes, 1)"))
    over = F.col("_at._bucket") > limit
    one = out.select("_id", "_bytes", "_n", "_at", over.alias("_over"), per_page.alias("_per"), F.explode(F.expr("sequence(0L, _n - 1)")).alias("_copy"))
    page = F.when(F.col("_over"), F.expr("_copy div _per")).otherwise(F.lit(0)).cast("long")
    on_page = F.least(F.col("_per"), F.col("_n") - page * F.col("_per")) * F.col("_bytes")
    depth = F.col("_at._depth")
    return one.select(
        F.col("_id").alias(id_col),
        F.col("_bytes").alias("n_bytes"),
        F.when(depth == 0, "").otherwise(F.expr("lpad(bin(_at._prefix), _at._depth, '0')")).alias("shard"),
        depth.cast("long").alias("depth"),
        page.alias("page"),
        F.when(F.col("_over"), on_page).otherwise(F.col("_at._bucket")).alias("shard_bytes"),
    )


SQL = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, COALESCE(strlen(text), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '') || ':' || md5(COALESCE(text, ''))), 1, {BITS // 4}))::BIGINT AS h
  FROM documents),
splits AS (
  SELECT 0::BIGINT AS depth, 0::BIGINT AS prefix, sum(n_bytes)::BIGINT AS bytes, min(h) AS low, max(h) AS high FROM rows_
  UNION ALL
  SELECT s.depth + 1, r.h >> ({BITS} - s.depth - 1)::INTEGER, sum(r.n_bytes)::BIGINT, min(r.h), max(r.h)
  FROM splits s JOIN rows_ r ON (r.h >> ({BITS} - s.depth)::INTEGER) = s.prefix
  WHERE s.bytes > {LIMIT} AND s.low < s.high
  GROUP BY s.depth, r.h >> ({BITS} - s.depth - 1)::INTEGER),
shards AS (SELECT * FROM splits WHERE bytes <= {LIMIT} OR low = high)
SELECT r.doc_id, r.n_bytes, CASE WHEN s.depth = 0 THEN '' ELSE right(lpad(bin(s.prefix), 60, '0'), s.depth::INTEGER) END AS shard,
  s.depth, 0::BIGINT AS page, s.bytes AS shard_bytes
FROM rows_ r JOIN shards s ON (r.h >> ({BITS} - s.depth)::INTEGER) = s.prefix
"""
