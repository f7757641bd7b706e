"""Importance resampling towards a target: hashed word features of a corpus and of a target corpus give each bucket a gain, a text's weight is the
mean gain of its features, and noise that follows from its id turns drawing without replacement into taking the highest scores.

Features are hashed by CRC-32 from position tables. A CRC is linear over XOR: the contribution of a byte depends on its value and its
distance from the end of the span only, so a span's CRC is the XOR of table entries, one gather and one bitwise_xor.reduceat for all spans
of a part, and a constant that depends on the length. Longer spans are folded blockwise: each block is one such XOR, moved
on by its number of blocks with tables for powers of two. Corpus counts are exact: each task counts all its features, Spark adds the counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.frames import written
from pagevault.operators.ordered import arrange, number_rows

PART = 2 << 20
BUCKETS, WIDEST, SEED, LEAST_WORDS, PERCENT = 10_000, 1, "2024", 20, 10
BLOCK = 64  # bytes of a position table
POLYNOMIAL = 0xEDB88320  # fixed value: the reflected CRC-32 polynomial


class Crc:
    """CRC-32 of many spans of bytes at once."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
        self.step = step
        self.at = np.empty((BLOCK, 256), np.uint32)  # contribution of a byte by distance from the end
        self.at[0] = step
        for d in range(1, BLOCK):
            self.at[d] = self._next(self.at[d - 1])
        self.blank = np.empty(BLOCK, np.uint32)  # what the start value becomes after so many zero bytes
        self.blank[0] = 0xFFFFFFFF
        for d in range(1, BLOCK):
            self.blank[d] = self._next(self.blank[d - 1 : d])[0]
        move = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
        for _ in range(BLOCK):
            move = self._next(move)
        self.moves = [move]  # tables that move a state on by BLOCK * 2**j bytes

    def _next(self, state: np.ndarray) -> np.ndarray:
        return (state >> np.uint32(8)) ^ self.step[state & np.uint32(255)]

    @staticmethod
    def _moved(state: np.ndarray, by: np.ndarray) -> np.ndarray:
        a, b, c, d = (by[k][(state >> np.uint32(8 * k)) & np.uint32(255)] for k in range(4))
        return a ^ b ^ c ^ d

    def _by_blocks(self, state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        """Each state moved on by its own number of blocks."""
        state, j = state.copy(), 0
        while (blocks >> j).any():
            if j == len(self.moves):
                self.moves.append(self._moved(self.moves[-1], self.moves[-1]))
            some = np.flatnonzero((blocks >> j) & 1)
            state[some] = self._moved(state[some], self.moves[j])
            j += 1
        return state

    def _short(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """XOR of the contributions of each span of 1 to BLOCK bytes, in pieces of about a megabyte."""
        size = ends - starts
        upto = np.cumsum(size)
        out = np.empty(len(starts), np.uint32)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + W.PIECE)))
            n, head = size[i:j], upto[i:j] - size[i:j] - (upto[i] - size[i])
            span = np.repeat(np.arange(j - i), n)
            place = np.arange(len(span)) - head[span]
            out[i:j] = np.bitwise_xor.reduceat(self.at[n[span] - 1 - place, data[starts[i:j][span] + place]], head)
            i = j
        return out

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The CRC of each span; spans may overlap, and none is empty."""
        size = ends - starts
        blocks, rest = size // BLOCK, size % BLOCK
        constant = self._by_blocks(self.blank[rest], blocks) ^ np.uint32(0xFFFFFFFF)
        whole = -(-size // BLOCK)  # counted from the end: the first block of a span may be short
        if not (whole > 1).any():
            return self._short(data, starts, ends) ^ constant if len(starts) else constant
        head = np.cumsum(whole) - whole
        span = np.repeat(np.arange(len(starts)), whole)
        behind = whole[span] - 1 - (np.arange(len(span)) - head[span])  # blocks that follow
        end = ends[span] - behind * BLOCK
        parts = self._by_blocks(self._short(data, np.maximum(starts[span], end - BLOCK), end), behind)
        return np.bitwise_xor.reduceat(parts, head) ^ constant


def features(texts, widest: int, crc: Crc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to `widest` words joined by one space, the text of each, and the number of words of each text."""
    data, offs = W.utf8(texts)
    starts, ends, doc = W.spans(data, offs, W.ALNUM)
    data = W.LOWER[data]
    count, _, at = W.within(doc, len(texts))
    if widest > 1:  # the words with one space after each: every run is a span of it
        size = ends - starts + 1
        upto = np.cumsum(size)
        word = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(word)) - (upto - size)[word]
        data = np.where(place < size[word] - 1, data[np.minimum(starts[word] + place, max(len(data) - 1, 0))], 0x20)
        starts, ends = upto - size, upto - 1
    out, docs = [], []
    for k in range(1, widest + 1):
        begin = np.flatnonzero(at + k <= count[doc])
        out.append(crc(data, starts[begin], ends[begin + k - 1]))
        docs.append(doc[begin])
    return np.concatenate(out), np.concatenate(docs), count


def _counter(buckets: int, widest: int):
    def run(batches):
        crc, total = Crc(), np.zeros(buckets, np.int64)
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                total += np.bincount(features(batch["_text"], widest, crc)[0] % buckets, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    return run


def counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, widest: int = WIDEST) -> np.ndarray:
    """How many features of all texts fall into each bucket; `buckets` numbers come to the driver."""
    found = docs.select(F.col(text_col).alias("_text")).mapInArrow(_counter(buckets, widest), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed frequencies) for each bucket."""
    s, t, size = float(source.sum()), float(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + size) / ((a + 1.0) * (t + size)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(shared, widest: int):
    def run(batches):
        gain, crc = shared.value, Crc()
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                h, doc, n_words = features(batch["_text"], widest, crc)
                n = np.bincount(doc, minlength=batch.num_rows)
                total = np.zeros(batch.num_rows, np.int64)
                np.add.at(total, doc, gain[h % len(gain)])
                weight = total // np.maximum(n, 1)
                cols = [batch["_uid"], *(pa.array(c, pa.int64()) for c in (n_words, n, weight))]
                yield pa.RecordBatch.from_arrays(cols, ["_uid", "n_words", "n_features", "weight"])

    return run


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS,
    widest: int = WIDEST, seed: str = SEED, least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """The id, n_features, weight, score and rank of each row; rank is null where the row is not drawn.

    Words are runs of ASCII letters (in lower case), digits and characters outside ASCII. Of the rows with at least `least_words` words, `percent`
    in a hundred are drawn (rounded down): the highest scores, ties to the smaller id, null ids first, then to the higher weight. Equal rows
    get different ranks, which of them which is open. Null texts have no words and weight 0; null ids hash as ''. Empty tables give no
    rows, or, as a target, no target features.
    """
    shared = docs.sparkSession.sparkContext.broadcast(gains(counts(docs, text_col, buckets, widest), counts(target, target_text_col, buckets, widest)))
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
    weighed = rows.mapInArrow(_weigher(shared, widest), f"_uid {kind}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_uid").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise))
    long_ones = scored.filter(F.col("n_words") >= least_words).withColumns({"_down": -F.col("score"), "_light": -F.col("weight")})
    drawn = long_ones.count() * percent // 100
    ranked = number_rows(arrange(long_ones, [], ["_down", "_uid", "_light"]), "rank").result()
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short_ones = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    names = ["n_features", "weight", "score", "rank"]
    out = ranked.select("_uid", *names).unionByName(short_ones.select("_uid", *names))
    return out.withColumnRenamed("_uid", id_col)


_WORDS = "regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"

#: for single words (WIDEST = 1); CRCs byte by byte over the distinct words
SQL = f"""
WITH doc_words AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
said AS (SELECT r, unnest(w) AS word FROM doc_words),
aimed AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
step AS (
  SELECT list(c ORDER BY b) AS s FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: {_STEP}) AS c FROM (SELECT unnest(range(256)) AS b))),
vocabulary AS (SELECT word, hex(encode(word)) AS x FROM (SELECT word FROM said UNION SELECT word FROM aimed)),
hashed AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, s[(xor(c, b) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM vocabulary, step),
source AS (SELECT h.bucket, count(*) AS n FROM said JOIN hashed h USING (word) GROUP BY h.bucket),
target AS (SELECT h.bucket, count(*) AS n FROM aimed JOIN hashed h USING (word) GROUP BY h.bucket),
totals AS (SELECT COALESCE((SELECT sum(n) FROM source), 0)::DOUBLE AS s, COALESCE((SELECT sum(n) FROM target), 0)::DOUBLE AS t),
gain AS (
  SELECT a.bucket, floor(1000 * ln((COALESCE(b.n, 0) + 1)::DOUBLE * (t.s + {BUCKETS}) / ((a.n + 1)::DOUBLE * (t.t + {BUCKETS}))))::BIGINT AS g
  FROM source a LEFT JOIN target b ON a.bucket = b.bucket CROSS JOIN totals t),
weighed AS (SELECT r, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM said JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (
  SELECT d.r, d.doc_id, len(d.w)::BIGINT AS n_features, COALESCE(v.weight, 0)::BIGINT AS weight, COALESCE(v.weight, 0)::BIGINT
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || COALESCE(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296.0)))::BIGINT AS score
  FROM doc_words d LEFT JOIN weighed v ON d.r = v.r),
ranked AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight DESC) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, s.n_features, s.weight, s.score, CASE WHEN k.rank <= ({PERCENT} * k.n) // 100 THEN k.rank::BIGINT END AS rank
FROM scored s LEFT JOIN ranked k ON s.r = k.r
"""
