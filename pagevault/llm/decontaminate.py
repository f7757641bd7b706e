"""Benchmark decontamination with suffix arrays over the training texts.

Each shard of texts (a few megabytes of an Arrow batch) gets a suffix array over its words: suffixes in order of their first
`depth` words, refined only where suffixes are still equal; texts end in a symbol of their own, so no match runs over an end.
Every suffix of every benchmark item is binary-searched in it, word by word, all suffixes at once. The range that is left
holds all places of its longest prefix of up to `depth` words; longer matches are extended word by word from there.

The documents are read once and never shuffled. Items come in blocks of bounded size, each broadcast for one pass; a benchmark of
one block (the usual case) takes one pass.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.llm import words as W
from pagevault.llm.frames import attach, with_uid, written

WINDOW = 10
BLOCK = 8 << 20  # bytes of benchmark text in a block, about
SHARD = 3 << 20
SIFTED = 1 << 20  # bytes of text that `decontaminated` judges at a time, about


class SuffixArray:
    """Suffixes of the word sequences of several texts, sorted by their first `depth` words."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, depth: int):
        starts, ends, self.doc = W.spans(data, offs, W.ALNUM)
        self.count, self.first, self.at = W.within(self.doc, len(offs) - 1)
        self.vocab, rank = np.unique(W.word_hashes(W.LOWER[data], starts, ends), return_inverse=True)
        n = len(rank)
        self.depth = depth
        # symbol 0 ends each text; `place` is the position of a word in the sequence
        self.place = np.arange(n) + self.doc
        self.seq = np.zeros(n + len(offs) - 1 + depth + 1, np.int64)
        self.seq[self.place] = rank + 1
        self.word = np.full(len(self.seq), -1, np.int64)
        self.word[self.place] = np.arange(n)
        key = self.seq[self.place] << 32 | self.seq[self.place + 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.ones(n, bool)
        new[1:] = key[1:] != key[:-1]
        self.pairs = key
        for d in range(2, depth, 2):
            tied = ~new
            tied[:-1] |= tied[1:]
            here = np.flatnonzero(tied)
            if not len(here):
                break
            group = np.cumsum(new)[here]
            p = self.place[order[here]]
            end = len(self.seq) - 1
            more = self.seq[np.minimum(p + d, end)] << 32 | self.seq[np.minimum(p + d + 1, end)]
            sub = np.lexsort((more, group))
            order[here] = order[here[sub]]
            more, group = more[sub], group[sub]
            fresh = np.ones(len(here), bool)
            fresh[1:] = (more[1:] != more[:-1]) | (group[1:] != group[:-1])
            new[here] = fresh
        self.order = order  # word numbers

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of words given by hash; -1 for words that no text has."""
        if not len(self.vocab):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, hashes), len(self.vocab) - 1)
        return np.where(self.vocab[at] == hashes, at + 1, -1)

    def _bound(self, lo, hi, d, want, right: bool):
        """Binary search in each range: first suffix whose word d is not below `want` (right: is above it)."""
        lo, hi = lo.copy(), hi.copy()
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            got = self.seq[self.place[self.order[mid]] + d]
            up = got <= want[live] if right else got < want[live]
            lo[live[up]] = mid[up] + 1
            hi[live[~up]] = mid[~up]

    def search(self, symbols: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """For each query symbols[begin : begin + length]: how many of its first words occur together, and the range of such suffixes."""
        q = len(begin)
        lo, hi, matched = np.zeros(q, np.int64), np.full(q, len(self.order)), np.zeros(q, np.int64)
        live = np.arange(q) if len(self.order) else np.zeros(0, np.int64)
        for d in range(self.depth):
            live = live[length[live] > d]
            want = symbols[begin[live] + d]
            live, want = live[want > 0], want[want > 0]
            if not len(live):
                break
            left = self._bound(lo[live], hi[live], d, want, False)
            right = self._bound(left, hi[live], d, want, True)
            some = left < right
            live = live[some]
            lo[live], hi[live], matched[live] = left[some], right[some], d + 1
        return matched, lo, hi


class Items:
    """Benchmark items of one block: their words, and their distinct windows."""

    def __init__(self, rows: list[tuple], window: int):
        texts = pa.array([t for _, t in rows], pa.string())
        data, offs = W.utf8(texts)
        starts, ends, doc = W.spans(data, offs, W.ALNUM)
        self.hashes = W.word_hashes(W.LOWER[data], starts, ends)
        self.count, self.first, self.at = W.within(doc, len(rows))
        self.item = doc
        self.ids = [i for i, _ in rows]
        self.width = np.minimum(window, self.count)
        start = np.flatnonzero(self.at + self.width[doc] <= self.count[doc])
        width = self.width[doc[start]]
        names: dict[bytes, int] = {}
        self.of_start = np.array([names.setdefault(self.hashes[s : s + w].tobytes(), len(names)) for s, w in zip(start, width, strict=True)], np.int64)
        _, pick = np.unique(self.of_start, return_index=True)
        self.begin, self.length = start[pick], width[pick]  # of distinct windows
        self.items_of: list[list[int]] = [[] for _ in names]
        pairs = np.unique(np.stack((self.of_start, doc[start])), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        for w, i in pairs.T:
            self.items_of[w].append(int(i))


def _hits(sa: SuffixArray, items: Items):
    """Words that lie in an occurrence of a window, and (text, window) pairs that occur."""
    n = len(sa.doc)
    edge = np.zeros(n + 1, np.int64)
    symbols = sa.symbols(items.hashes)
    matched, lo, hi = sa.search(symbols, items.begin, items.length)
    full = np.flatnonzero(matched == items.length)
    docs, windows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for w in full:  # windows that occur here; each takes its places at once
        at = sa.order[lo[w] : hi[w]]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + items.length[w], -1)
        docs.append(found := np.unique(sa.doc[at]))
        windows.append(np.full(len(found), w))
    return np.cumsum(edge[:-1]) > 0, np.concatenate(docs), np.concatenate(windows)


_FOUND = "n_words long, hit binary, items array<string>"


def _scan(block, window: int):
    def run(batches):
        items = Items(block.value, window)
        for whole in batches:
            for batch in W.slices(whole, "_text", SHARD):
                sa = SuffixArray(*W.utf8(batch["_text"]), window)
                hit, docs, windows = _hits(sa, items)
                ids: dict[int, set[str]] = {}
                for d, w in zip(docs.tolist(), windows.tolist(), strict=True):
                    ids.setdefault(d, set()).update(items.ids[i] for i in items.items_of[w])
                bits = [
                    np.packbits(hit[f : f + n]).tobytes() if d in ids else None
                    for d, (f, n) in enumerate(zip(sa.first.tolist(), sa.count.tolist(), strict=True))
                ]
                names = [sorted(ids[d]) if d in ids else [] for d in range(batch.num_rows)]
                cols = [batch["_uid"], pa.array(sa.count, pa.int64()), pa.array(bits, pa.binary()), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, ["_uid", "n_words", "hit", "items"])

    return run


def _digest(batches):
    """Hits of all blocks of each row -> the result columns."""
    for b in batches:
        n_hit, n_items, shas, spans = [], [], [], []
        for hits, names in zip(b["hits"].to_pylist(), b["names"].to_pylist(), strict=True):
            bits = np.zeros(0, np.uint8)
            for h in hits:
                h = np.frombuffer(h, np.uint8)
                bits = h if not len(bits) else bits | h
            flags = np.unpackbits(bits)
            step = np.diff(np.concatenate(([0], flags, [0])).astype(np.int8))
            spans.append(np.stack((np.flatnonzero(step == 1), np.flatnonzero(step == -1)), axis=1).tolist())
            n_hit.append(int(flags.sum()))
            names = sorted(set(names))
            n_items.append(len(names))
            shas.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64())))
        cols = [pa.array(c, k) for c, k in zip((n_hit, n_items, shas, spans), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b["_uid"], b["n_words"], *cols], ["_uid", "n_words", "n_hit", "n_items", "items_sha256", "spans"])


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, size: int) -> list:
    """Broadcasts of the items, each of about `size` bytes of text; one block is on the driver at a time."""
    spark = benchmark.sparkSession
    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    total = rows.agg(F.sum(F.octet_length("t") + 32)).first()[0] or 0
    n = -(-total // size) or 1
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return [spark.sparkContext.broadcast([(r.i, r.t) for r in rows.filter(part == k).orderBy("i", "t").collect()]) for k in range(n)]


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """The id, n_words, n_hit, n_items, items_sha256, contaminated and spans ([begin, end) words that are hit) of each row.

    Words are runs of ASCII letters (in lower case), digits and characters outside ASCII. A window is `window` consecutive words of
    an item, or a shorter item whole; items and texts without words take no part. Items with one id count once; a null item id
    counts as ''. Rows are independent, so ids may be null or repeated. Empty tables give no rows, or no hits.
    """
    blocks = _blocks(benchmark, item_col, item_text_col, block)
    kind = dict(docs.dtypes)[id_col]
    if len(blocks) == 1:
        rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
        found = rows.mapInArrow(_scan(blocks[0], window), f"_uid {kind}, {_FOUND}")
        merged = found.select("_uid", "n_words", F.array_compact(F.array("hit")).alias("hits"), F.col("items").alias("names"))
    else:
        rows, same = with_uid(docs, id_col, text_col)
        texts = rows.select("_uid", "_text")
        passes = [written(texts.mapInArrow(_scan(b, window), f"_uid long, {_FOUND}")) for b in blocks]
        every = passes[0]
        for p in passes[1:]:
            every = every.union(p)
        merged = every.groupBy("_uid").agg(F.first("n_words").alias("n_words"), F.collect_list("hit").alias("hits"), F.flatten(F.collect_list("items")).alias("names"))
        merged = merged.join(rows.select("_uid", F.col(f"_in_{id_col}").alias("_id")), "_uid").drop("_uid").withColumnRenamed("_id", "_uid")
        merged = merged.select("_uid", "n_words", "hits", "names")
    out = merged.mapInArrow(_digest, f"_uid {kind}, n_words long, n_hit long, n_items long, items_sha256 string, spans array<array<long>>")
    return out.select(F.col("_uid").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans")


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """The rows in whose text no window of an item occurs, unchanged.

    Rows are independent: repeated rows stay or go together, rows with a null or empty text stay, and texts of any length are judged whole.
    """

    def hit(items: Items, texts):
        sa = SuffixArray(*W.utf8(texts), window)
        flags = np.zeros(len(texts), bool)
        flags[_hits(sa, items)[1]] = True
        return [pa.array(flags)]

    added = T.StructType([T.StructField("hit", T.BooleanType())])
    for items in _blocks(benchmark, item_col, item_text_col, block):
        out, (flag,) = attach(docs, text_col, lambda items=items: Items(items.value, window), hit, added, SIFTED)
        docs = out.filter(~F.col(flag)).drop(flag)
    return docs


def _longest(block, window: int):
    def run(batches):
        items = Items(block.value, window)
        left = items.count[items.item] - items.at
        for whole in batches:
            for batch in W.slices(whole, "_text", SHARD):
                sa = SuffixArray(*W.utf8(batch["_text"]), window)
                symbols = np.append(sa.symbols(items.hashes), -1)
                begin = np.arange(len(items.hashes))
                matched, lo, hi = sa.search(symbols, begin, np.minimum(left, window))
                some = np.flatnonzero(matched > 0)
                query = np.repeat(some, hi[some] - lo[some])
                at = sa.order[np.concatenate([np.arange(a, b) for a, b in zip(lo[some], hi[some], strict=True)] or [np.zeros(0, np.int64)])]
                size = matched[query]
                live = np.flatnonzero(size == window)
                while len(live):  # longer than the array is sorted: word by word
                    q, p = query[live] + size[live], np.minimum(sa.place[at[live]] + size[live], len(sa.seq) - 1)
                    live = live[(size[live] < left[query[live]]) & (symbols[np.minimum(q, len(symbols) - 1)] == sa.seq[p]) & (sa.seq[p] > 0)]
                    size[live] += 1
                best = np.lexsort((at, -size, query))
                best = best[np.unique(query[best], return_index=True)[1]] if len(best) else best
                q, a = query[best], at[best]
                ids = pa.array([items.ids[i] for i in items.item[q]], pa.string())
                cols = [ids, pa.array(items.at[q], pa.int64()), batch["_uid"].take(pa.array(sa.doc[a])), pa.array(sa.at[a], pa.int64()), pa.array(size[best], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["item_id", "item_word", "_uid", "word", "n_words"])

    return run


def longest_matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", depth: int = WINDOW, block: int = BLOCK,
) -> DataFrame:
    """For each suffix of each item that shares a word with the texts: item_id, item_word (where it begins), the id of a text and the
    word where its longest verbatim match begins, and its length n_words (of equally long ones the smallest id, then word)."""
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
    found = None
    for b in _blocks(benchmark, item_col, item_text_col, block):
        one = rows.mapInArrow(_longest(b, depth), f"item_id string, item_word long, _uid {kind}, word long, n_words long")
        found = one if found is None else found.union(one)
    best = found.groupBy("item_id", "item_word").agg(F.min(F.struct((-F.col("n_words")).alias("l"), "_uid", "word")).alias("m"))
    return best.select("item_id", "item_word", F.col("m._uid").alias(id_col), F.col("m.word").alias("word"), (-F.col("m.l")).alias("n_words"))


SQL = f"""
WITH doc_words AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS width, array_to_string(w[s:s + least({WINDOW}, len(w)) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS s FROM item_words WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM item_windows),
doc_windows AS (
  SELECT doc_id, width, s, array_to_string(w[s:s + width - 1], ' ') AS k
  FROM (SELECT doc_id, width, w, unnest(range(1, len(w) - width + 2)) AS s FROM doc_words, widths WHERE len(w) >= width)),
found AS (SELECT d.doc_id, d.s, d.width, i.item_id FROM doc_windows d JOIN item_windows i ON d.k = i.k AND d.width = i.width),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + width)) AS p FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, COALESCE(h.n_hit, 0)::BIGINT AS n_hit, COALESCE(i.n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(i.ids, '')) AS items_sha256, COALESCE(h.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN items i ON d.doc_id = i.doc_id
"""
