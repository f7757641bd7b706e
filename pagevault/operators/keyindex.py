"""A key index that grows batch by batch, while a look-up reads about the same number of bytes: levels of runs, buckets, Bloom filters.

Each batch adds one run. A run holds its entries in buckets of a hash of the key, one folder and about ROWS entries each, and a Bloom filter for
each bucket. When FANOUT runs of one level exist they are merged into one of the next level, in which the last entry of each (key, id) is left. So
there are few runs, whatever the number of batches; a look-up opens the filters of the buckets that its keys fall into, and then only
the buckets that may hold one of them. A deletion is an entry too, and vanishes when it is merged into the oldest run.

The runs that count after a batch are listed in its manifest. A batch reads the manifest of the batch before it and writes only its own run and
manifest and runs merged from finished batches, so running it again after a failure gives the same index.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagevault.operators.rows import first_of
from pagevault.session import shared_table

ROWS = 1_000_000  # entries of a bucket, about
FANOUT = 4
BITS_PER_KEY, PROBES = 16, 6
STEP = 1 << 16  # hashes whose bits are worked out at a time


@dataclass(frozen=True)
class Run:
    """The entries of the batches `first` to `last`."""

    level: int
    first: int
    last: int
    buckets: int
    n_rows: int


_RUN = "level int, first long, last long, buckets long, n_rows long"


def _positions(h: np.ndarray, size: int) -> np.ndarray:
    """Bits of a filter of `size` bits (a power of two) for each hash."""
    h = h.view(np.uint64)
    low, high = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + high[:, None] * np.arange(1, PROBES + 1, dtype=np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def _filters(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The distinct hashes of a bucket -> its Bloom filter."""
    h = rows["h"].to_numpy()
    size = 1 << max(6, int(BITS_PER_KEY * len(h) - 1).bit_length())
    bits = np.zeros(size, np.uint8)
    for at in range(0, len(h), STEP):
        bits[_positions(h[at : at + STEP], size).ravel()] = 1
    return pa.table({"bucket": pa.array([key[0].as_py()], pa.int64()), "bloom": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def _possible(key: tuple[pa.Scalar, ...], keys: pa.Table, blooms: pa.Table) -> pa.Table:
    """The keys of a bucket that its filter does not rule out."""
    if not keys.num_rows or not blooms.num_rows:
        return keys.slice(0, 0)
    bits = np.frombuffer(blooms["bloom"][0].as_py(), np.uint8)
    h, found = keys["h"].to_numpy(), []
    for begin in range(0, len(h), STEP):
        at = _positions(h[begin : begin + STEP], 8 * len(bits))
        found.append(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1))
    return keys.filter(pa.array(np.concatenate(found)))


def _bucket(n: int | Column) -> Column:
    return F.pmod(F.col("h"), F.lit(n) if isinstance(n, int) else n)


class KeyIndex:
    """Entries (k, id and the columns of `value`) below `path`; batches are numbered upwards."""

    def __init__(self, spark: SparkSession, path: str, value: str = "", rows: int = ROWS, fanout: int = FANOUT):
        self.spark, self.path, self.rows, self.fanout = spark, path, rows, fanout
        self.schema = ", ".join(filter(None, ["k string", "id string", value, "deleted boolean", "batch long", "h long", "bucket long"]))
        self.columns = [c.split()[0] for c in self.schema.split(", ")]

    # --- runs ----------------------------------------------------------------------------------------------------

    def runs(self, batch: int) -> list[Run]:
        """The runs that hold all batches before `batch`, oldest first: one row for each."""
        read = self.spark.read.schema(_RUN)
        for path in (f"{self.path}/manifest/batch={batch - 1}", f"{self.path}/manifest"):  # the batch before, else the last before it
            try:
                df = read.parquet(path) if "=" in path else read.schema(f"{_RUN}, batch long").parquet(path)
                if "=" not in path:
                    last = df.filter(F.col("batch") < batch).agg(F.max("batch")).first()[0]
                    df = df.filter(F.col("batch") == F.lit(last))
                return sorted((Run(r.level, r.first, r.last, r.buckets, r.n_rows) for r in df.collect()), key=lambda r: r.first)
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
        return []

    def _at(self, kind: str, run: Run) -> str:
        return f"{self.path}/{kind}/{run.first}-{run.last}"

    def _read(self, run: Run, buckets: Sequence[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(self.schema).parquet(self._at("entries", run))
        return df if buckets is None else df.filter(F.col("bucket").isin(list(buckets)))

    def _write(self, entries: DataFrame, level: int, first: int, last: int) -> Run:
        """A run of these entries; they are read twice."""
        n_rows = entries.count()
        run = Run(level, first, last, max(1, -(-n_rows // self.rows)), n_rows)
        rows = entries.withColumn("h", F.xxhash64("k")).withColumn("bucket", _bucket(run.buckets)).select(*self.columns)
        rows = rows.repartition(min(run.buckets, 2000), "bucket").sortWithinPartitions("bucket", "h")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(self._at("entries", run))
        if n_rows:
            hashes = self._read(run).select("bucket", "h").distinct()
            blooms = hashes.groupBy("bucket").applyInArrow(_filters, "bucket long, bloom binary")
            blooms.write.mode("overwrite").partitionBy("bucket").parquet(self._at("blooms", run))
        return run

    def add(self, entries: DataFrame, batch: int) -> None:
        """Add the entries of a batch: k, id, the value columns and deleted, one for each (k, id). They are read twice."""
        runs = self._merged(self.runs(batch))
        runs.append(self._write(entries.withColumn("batch", F.lit(batch).cast("long")), 0, batch, batch))
        manifest = self.spark.createDataFrame([astuple(r) for r in runs if r.n_rows], _RUN)
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")

    def _merged(self, runs: list[Run]) -> list[Run]:
        """The runs after merging those of a level, lowest level first, wherever there are enough."""
        level = 0
        while runs and level <= max(r.level for r in runs):
            some = [r for r in runs if r.level == level]
            if len(some) >= self.fanout:
                every = reduce(DataFrame.unionByName, (self._read(r) for r in some))
                newest = first_of(every, ["k", "id"], [F.desc("batch")])
                if some[0].first == runs[0].first:
                    newest = newest.filter("not deleted")  # nothing older is left to be hidden
                merged = self._write(shared_table(newest), level + 1, some[0].first, some[-1].last)
                runs = sorted((r for r in [*(r for r in runs if r.level != level), merged] if r.n_rows), key=lambda r: r.first)
            level += 1
        return runs

    # --- look-ups ------------------------------------------------------------------------------------------------

    def possible(self, keys: DataFrame, batch: int) -> tuple[list, DataFrame, dict[int, list[int]]]:
        """The runs before `batch`; which keys `k` each of them may hold; and the buckets, by number of the run, that these fall into."""
        runs = self.runs(batch)
        sizes = F.array(*[F.struct(F.lit(i).alias("run"), F.lit(r.buckets).alias("n")) for i, r in enumerate(runs)])
        asked = shared_table(keys.select("k").filter("k is not null").distinct().withColumn("h", F.xxhash64("k")))
        if not runs:
            return [], asked.withColumn("run", F.lit(0)).limit(0), {}
        spread = asked.withColumn("_r", F.explode(sizes)).select("k", "h", F.col("_r.run").alias("run"), _bucket(F.col("_r.n")).alias("bucket"))
        blooms = []
        for i, buckets in self._buckets(spread).items():
            df = self.spark.read.schema("bloom binary, bucket long").parquet(self._at("blooms", runs[i]))
            blooms.append(df.filter(F.col("bucket").isin(buckets)).select(F.lit(i).alias("run"), "bucket", "bloom"))
        if not blooms:
            return runs, spread.limit(0).select("k", "h", "run"), {}
        blooms = reduce(DataFrame.union, blooms)
        sides = spread.groupBy("run", "bucket").cogroup(blooms.groupBy("run", "bucket"))
        hits = shared_table(sides.applyInArrow(_possible, "k string, h long, run int, bucket long"))
        return runs, hits, self._buckets(hits)

    @staticmethod
    def _buckets(rows: DataFrame) -> dict[int, list[int]]:
        """Buckets by run: at most as many numbers as the index has buckets."""
        out: dict[int, list[int]] = {}
        for r in rows.select("run", "bucket").distinct().collect():
            out.setdefault(r.run, []).append(r.bucket)
        return out

    def lookup(self, keys: DataFrame, batch: int) -> DataFrame:
        """The entries of these keys (a column k) after the batches before `batch`: the last of each (k, id), without deleted ones."""
        runs, hits, buckets = self.possible(keys, batch)
        if not buckets:
            return self.spark.createDataFrame([], self.schema).drop("h", "bucket")
        found = reduce(DataFrame.union, (self._read(runs[i], b).drop("h", "bucket").join(hits.filter(F.col("run") == i).select("k"), "k", "left_semi") for i, b in buckets.items()))
        return first_of(found, ["k", "id"], [F.desc("batch")]).filter("not deleted")

    def everything(self, batch: int) -> DataFrame:
        """All entries after the batches before `batch`."""
        runs = self.runs(batch)
        if not runs:
            return self.spark.createDataFrame([], self.schema).drop("h", "bucket")
        every = reduce(DataFrame.unionByName, (self._read(r) for r in runs)).drop("h", "bucket")
        return first_of(every, ["k", "id"], [F.desc("batch")]).filter("not deleted")
