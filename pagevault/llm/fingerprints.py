"""SimHash fingerprints of texts, their likeness, and all fingerprints within a Hamming radius.

Terms are runs of SHINGLE words; a term that occurs n times weighs 1 + ln n. Every bit of a term's hash votes for or against the
same bit of the fingerprint with the term's weight. The share of differing bits tends to the angle between two weighted term vectors over pi,
so the likeness is the cosine of that angle (0 where it is negative): 1 for equal texts, about 0 for unrelated ones.

Two fingerprints at most `radius` bits apart agree on at least one of radius + 1 disjoint blocks of bits. There is one
table per block, keyed by it: the fingerprint permuted so that this block comes first. A pair is taken from the
first table where it meets, after its distance is verified inside the join.

Wide radii are counted, not paired (`near_counts`): of more than radius / 3 disjoint blocks at least one differs in at most two
bits, so each fingerprint looks up its blocks with every choice of up to two bits flipped in the block tables of the queries.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.frames import buckets, text_bytes, with_uid

BITS = 256
SHINGLE = 2
RADIUS = 8
#: Five-word Jaccard 0.8 on 200 words is about 24 differing bits, with a standard deviation of 4.7: three of them more.
COPY_RADIUS = 38
QUERIES = 1 << 18  # fingerprints asked for in one scan: about 10 MB on the driver and in each worker
_PAIRS = 1 << 20  # candidates verified at once
PART = 2 << 20
RANGE_BYTES, RANGES = 4 << 20, 1 << 16  # text in a range of ids, about; ranges at most (then they grow)
_LANES = BITS // 64


def simhash(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Fingerprints of texts (bytes and offsets): n x BITS/64 numbers. Texts without words have all bits 0."""
    n = len(offs) - 1
    starts, ends, doc = W.spans(data, offs, W.NOT_SPACE)
    count, first, at = W.within(doc, n)
    words = W.word_hashes(data, starts, ends)
    # terms begin where SHINGLE words are left; a text with fewer words has them all as one term
    width = np.minimum(SHINGLE, count)
    pick = np.flatnonzero(at + width[doc] <= count[doc])
    if len(pick) == 0:
        return np.zeros((n, _LANES), np.uint64)
    term = words[pick].copy()
    long = width[doc[pick]] > 1
    for k in range(1, SHINGLE):
        more = np.flatnonzero(long & (at[pick] + k < count[doc[pick]]))
        term[more] = W.mix(term[more]) + words[pick[more] + k]
    term = W.mix(term)
    of = doc[pick]
    order = np.lexsort((term, of))
    term, of = term[order], of[order]
    new = np.ones(len(term), bool)
    new[1:] = (term[1:] != term[:-1]) | (of[1:] != of[:-1])
    cut = np.flatnonzero(new)
    often = np.diff(np.append(cut, len(term)))
    term, of, weight = term[cut], of[cut], (1 + np.log(often)).astype(np.float32)
    rows, where = np.unique(of, return_index=True)
    total = np.add.reduceat(weight, where)
    out = np.zeros((n, _LANES), np.uint64)
    for lane in range(_LANES):
        h = W.mix(term + np.uint64(lane))
        votes = np.zeros((len(rows), 64), np.float32)
        for a in range(0, len(rows), 64):  # in groups of texts, so that the unpacked bits stay small
            b = min(len(rows), a + 64)
            lo, hi = where[a], where[b] if b < len(rows) else len(term)
            step = 1 << 16
            if hi - lo <= step:
                bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                bits *= weight[lo:hi, None]
                votes[a:b] = np.add.reduceat(bits, where[a:b] - lo, axis=0)
            else:
                for r in range(a, b):
                    end = where[r + 1] if r + 1 < len(rows) else len(term)
                    for p in range(where[r], end, step):
                        q = min(end, p + step)
                        bits = np.unpackbits(h[p:q].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                        votes[r] += weight[p:q] @ bits.astype(np.float32)
        ones = votes * 2 > total[:, None]
        out[rows, lane] = np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _fingerprints(batches):
    for whole in batches:
        for batch in W.slices(whole, "_text", PART):
            data, offs = W.utf8(batch["_text"])
            lanes = simhash(data, offs).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, lanes.size + 1, _LANES), pa.int32()), pa.array(lanes.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "_fp"])


def fingerprints(rows: DataFrame, *, keep_text: bool = False) -> DataFrame:
    """Adds _fp (array of longs) to rows with _text; all other columns stay, _text only on request."""
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    out = rows.mapInArrow(_fingerprints, f"{schema}, _fp array<bigint>")
    return out if keep_text else out.drop("_text")


def hexadecimal(fp: str):
    """The fingerprint as text: 16 hexadecimal digits for each 64 bits."""
    return F.concat(*(F.lower(F.lpad(F.hex(F.col(fp)[i]), 16, "0")) for i in range(_LANES)))


def distance(a, b):
    """Bits in which two fingerprints differ."""
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for i in range(1, _LANES):
        out = out + F.bit_count(a[i].bitwiseXOR(b[i]))
    return out


def likeness(a, b):
    return F.greatest(F.lit(0.0), F.cos(distance(a, b) * F.lit(math.pi / BITS)))


def _block(fp, bits: int, k: int, radius: int):
    """Bits of block k of radius + 1 as one number (at most 63 bits of them: a shorter key only finds more candidates)."""
    lo, hi = bits * k // (radius + 1), bits * (k + 1) // (radius + 1)
    hi = min(hi, lo + 63)
    lane, shift, width = lo // 64, lo % 64, hi - lo
    here = min(width, 64 - shift)
    part = F.shiftrightunsigned(fp[lane], shift).bitwiseAND(F.lit((1 << here) - 1 if here < 64 else -1))
    if width > here:
        rest = fp[lane + 1].bitwiseAND(F.lit((1 << (width - here)) - 1))
        part = part.bitwiseOR(F.shiftleft(rest, here))
    return part


def within_radius(queries: DataFrame, fps: DataFrame, radius: int = RADIUS, key: str = "key", fp: str = "fp") -> DataFrame:
    """Rows (query, key, distance): all of `fps` at most `radius` bits from each of `queries` (both with `key` and `fp`).

    Both sides should hold each fingerprint once: collapse equal ones first. Pairs of a key with itself are left out.
    """
    if not 0 <= radius < BITS:
        raise ValueError("the radius is at least 0 and below the number of bits")

    def tables(df: DataFrame, name: str) -> DataFrame:
        blocks = F.array(*(_block(F.col(fp), BITS, k, radius) for k in range(radius + 1)))
        return df.select(F.col(key).alias(name), F.col(fp).alias(f"_{name}"), F.posexplode(blocks).alias("_table", "_block"))

    q, d = tables(queries, "query"), tables(fps, "near").withColumnsRenamed({"_table": "_t", "_block": "_b"})
    earlier = F.lit(False)
    for k in range(radius):
        same = _block(F.col("_query"), BITS, k, radius) == _block(F.col("_near"), BITS, k, radius)
        earlier = earlier | ((F.col("_table") > k) & same)
    apart = distance(F.col("_query"), F.col("_near"))
    on = (F.col("_table") == F.col("_t")) & (F.col("_block") == F.col("_b")) & (F.col("query") != F.col("near")) & (apart <= radius) & ~earlier
    return q.join(d, on).select("query", F.col("near").alias(key), apart.cast("long").alias("distance"))


def _blocks(radius: int) -> list[tuple[int, int, np.ndarray]]:
    """First bit and width of each block, and what up to radius // blocks flips (two at most) make of it. No block is wider than 22 bits."""
    m = max(radius // 3 + 1, 12)
    out = []
    for k in range(m):
        lo, hi = BITS * k // m, BITS * (k + 1) // m
        flips = [sum(1 << i for i in c) for n in range(radius // m + 1) for c in itertools.combinations(range(hi - lo), n)]
        out.append((lo, hi - lo, np.array(flips, np.int32)))
    return out


def _key(lanes: np.ndarray, lo: int, width: int) -> np.ndarray:
    lane, shift = lo // 64, lo % 64
    part = lanes[:, lane] >> np.uint64(shift)
    if shift + width > 64:
        part = part | lanes[:, lane + 1] << np.uint64(64 - shift)
    return (part & np.uint64((1 << width) - 1)).astype(np.int32)


def _lanes(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, _LANES)


def _counted(given, radii):
    blocks = _blocks(max(radii))

    def run(batches):
        asked = np.frombuffer(given.value, np.uint64).reshape(-1, _LANES)
        tables = []
        for lo, width, _ in blocks:
            keys = _key(asked, lo, width)
            order = np.argsort(keys, kind="stable")
            tables.append((keys[order], order))
        there = np.zeros(1 << max(width for _, width, _ in blocks), bool)
        counts = np.zeros((len(radii), len(asked)), np.int64)

        def verify(own, size, row, q, k):
            differ = own[row] ^ asked[q]
            apart = np.bitwise_count(differ).sum(axis=1, dtype=np.int64)
            keep = (apart > 0) & (apart <= max(radii))
            differ, apart, row, q = differ[keep], apart[keep], row[keep], q[keep]
            first = np.ones(len(q), bool)
            for lo, width, _ in blocks[:k]:
                first &= np.bitwise_count(_key(differ, lo, width)) > max(radii) // len(blocks)
            for i, radius in enumerate(radii):
                take = first & (apart <= radius)
                np.add.at(counts[i], q[take], size[row[take]])

        for batch in batches:
            fps, sizes = _lanes(batch["fp"]), batch["size"].to_numpy()
            for a in range(0, len(fps), 4096):
                own, size = fps[a : a + 4096], sizes[a : a + 4096]
                for k, (lo, width, flips) in enumerate(blocks):
                    keys, order = tables[k]
                    there[keys] = True
                    tries = _key(own, lo, width)[:, None] ^ flips
                    hits = np.flatnonzero(there[tries])
                    there[keys] = False
                    tried = tries.ravel()[hits]
                    begin = np.searchsorted(keys, tried)
                    many = np.searchsorted(keys, tried, side="right") - begin
                    row = hits // len(flips)
                    part = np.cumsum(many) // _PAIRS
                    for p in np.unique(part):
                        x = np.flatnonzero(part == p)
                        at = np.arange(many[x].sum()) - np.repeat(np.cumsum(many[x]) - many[x], many[x])
                        verify(own, size, np.repeat(row[x], many[x]), order[np.repeat(begin[x], many[x]) + at], k)
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(c[some]) for c in counts)], ["at", *(f"n{i}" for i in range(len(radii)))])

    return run


def near_counts(queries: DataFrame, classes: DataFrame, radii: tuple[int, ...]) -> DataFrame:
    """Rows (fp, n0, n1 ...): for the `fp` of each query the sum of `size` over all other fingerprints of `classes` within each radius.

    Both sides hold each fingerprint once; a query without any other within the greatest radius gives no row. Exact: every
    fingerprint is looked up in all block tables. Each QUERIES of the queries are one scan of `classes`, without a shuffle of it; near copies are
    summed in the task, so no pairs are emitted.
    """
    if not 0 <= max(radii) < BITS:
        raise ValueError("the radius is at least 0 and below the number of bits")
    spark, parts = classes.sparkSession, max(1, -(-queries.count() // QUERIES))
    names = [f"n{i}" for i in range(len(radii))]
    out = None
    for part in range(parts):
        asked = queries.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(parts)) == part).toArrow()["fp"].combine_chunks()
        lanes = _lanes(asked)
        given = spark.sparkContext.broadcast(lanes.tobytes())
        found = classes.select("fp", "size").mapInArrow(_counted(given, radii), ", ".join(["at long", *(f"{n} long" for n in names)]))
        total = found.groupBy("at").agg(*(F.sum(n).alias(n) for n in names))
        fps = spark.createDataFrame(pa.table({"at": pa.array(np.arange(len(lanes))), "fp": asked}))
        total = total.join(fps, "at").select("fp", *names)
        out = total if out is None else out.unionByName(total)
    return out


def _range_heads(cuts: np.ndarray):
    def run(batches):
        for b in batches:
            uid = b["_uid"].to_numpy()
            part = np.searchsorted(cuts, uid, side="right")
            order = np.lexsort((uid, part))
            parts, where = np.unique(part[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(uid[order][where], pa.int64())], ["part", "head"])

    return run


def _dealt(given):
    """Fingerprints and the range of each row; the first row of a range also goes to the range before (the first of all to the last)."""

    def run(batches):
        cuts, heads = given.value
        order = np.argsort(heads[:, 1])
        first, before = heads[order, 1], np.roll(heads[:, 0], 1)[order]
        for b in _fingerprints(batches):
            uid = b["_uid"].to_numpy()
            at = np.minimum(np.searchsorted(first, uid), len(first) - 1)
            twice = np.flatnonzero(first[at] == uid)
            pick = np.concatenate((np.arange(len(uid)), twice))
            part = np.concatenate((np.searchsorted(cuts, uid, side="right"), before[at[twice]]))
            out = b.take(pa.array(pick))
            guest = pa.array(np.arange(len(pick)) >= len(uid))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(part, pa.int32()), guest], [*out.schema.names, "part", "guest"])

    return run


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the edited text of each row.

    The edited text is the text with its last half (rounded down) replaced by as many code points from the beginning of the next row's
    text by id (or all of it); the last row's next is the first. Null texts count as empty; null ids come first; rows with one
    id are ordered by text. An empty table gives an empty result.

    The texts are shuffled once, into ranges of ids; the first row of a range also goes to the range before it.
    """
    rows, same = with_uid(docs, id_col, text_col)
    n = min(RANGES, buckets(text_bytes(rows), RANGE_BYTES))
    cuts = rows.agg(F.percentile_approx("_uid", [i / n for i in range(n)], 100_000).alias("c")).first().c or [0]
    cuts = np.unique(np.array(cuts, np.int64))[1:]
    least = rows.select("_uid").mapInArrow(_range_heads(cuts), "part int, head long").groupBy("part").agg(F.min("head").alias("head"))
    heads = sorted((r.part, r.head) for r in least.collect())  # one row per range
    given = rows.sparkSession.sparkContext.broadcast((cuts, np.array(heads, np.int64).reshape(-1, 2)))
    texts = rows.select("_uid", F.coalesce("_text", F.lit("")).alias("_text"))
    dealt = texts.mapInArrow(_dealt(given), "_uid long, _text string, _fp array<bigint>, part int, guest boolean")
    w = Window.partitionBy("part").orderBy("guest", "_uid")
    chars = F.length("_text")
    half = F.floor(chars / 2).cast("int")
    nxt = dealt.select("*", F.lead("_text").over(w).alias("_next"), F.lead("_fp").over(w).alias("_next_fp")).filter("not guest")
    head, tail = F.substring(F.col("_text"), F.lit(1), chars - half), F.substring(F.col("_next"), F.lit(1), half)
    edited = nxt.select("_uid", chars.cast("long").alias("n_chars"), F.concat(head, tail).alias("_text"), F.col("_fp").alias("_own"), "_next_fp")
    done = fingerprints(edited, keep_text=True).select(
        "_uid", "n_chars", F.col("_text").alias("edited"), F.sha2(F.col("_text"), 256).alias("edited_sha256"),
        hexadecimal("_own").alias("fingerprint"), hexadecimal("_fp").alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_fp")).alias("near_edited"), likeness(F.col("_own"), F.col("_next_fp")).alias("near_next"),
        F.col("_own").alias("fp"),
    )
    if same:
        out = done.withColumn(id_col, F.col("_uid").cast(dict(docs.dtypes)[id_col]))
    else:
        out = done.join(rows.select("_uid", F.col(f"_in_{id_col}").alias(id_col)), "_uid")
    return out.select(id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited", "fp")
