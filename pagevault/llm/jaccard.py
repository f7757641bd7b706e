"""Exact Jaccard join of texts on word shingles: grouped prefix filtering, then verification, then components.

Shingles are ordered by one total order: the frequent ones, counted over all texts, last, the others by hash. Two sets whose
Jaccard similarity reaches the threshold share a shingle within their first |x| - ceil(t |x|) + 1 ones, their *prefix*. Texts with the same prefix
and size form a *group*, and only groups are dealt out: a thousand copies count once. A bucket of prefix shingles yields the lists of groups
that share one; lists of two are filtered by size and position at once, longer ones are cut where sizes are too far apart.
Lists then expand to members, one for each distinct set. Pairs of members first pass a bitmap filter: hashed bitmaps in which each shingle flips a
bit differ in at most as many bits as the sets differ in shingles. Those that pass are verified on their full sets.

The result is which texts hang together, so no list is turned into all its pairs at first: each list verifies its
members against its smallest one. What hangs together then needs no more tests; only pairs of one list that
are still in different components are left, and all of them are verified (by further pivots first while they are many).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm import words as W
from pagevault.llm.components import components
from pagevault.llm.frames import buckets, text_bytes, with_uid, written

WIDTH, PERCENT = 5, 80
PART = 4 << 20
FREQUENT_AT, FREQUENT_MOST = 48, 1 << 20  # texts with a shingle from which it is frequent, and how many are ranked; it only shapes the order of shingles, not the result
LANES = ((256, 4), (640, 8), (1280, 16), (1 << 62, 32))  # 64-bit parts of the bitmap of a set of at most so many shingles
BROADCAST_IDS = 1_000_000  # ids of candidates that may be broadcast (8 MB); beyond it they are joined by shuffle
_TOP = np.uint64(1 << 63)


def _sets(data: np.ndarray, offs: np.ndarray, width: int):
    """Distinct shingle hashes of each text, sorted."""
    starts, ends, doc = W.spans(data, offs, W.NOT_SPACE)
    n = len(offs) - 1
    count, first, at = W.within(doc, n)
    words = W.word_hashes(W.LOWER[data], starts, ends)
    full = np.flatnonzero(at + width <= count[doc])
    h = W.window_hashes(words, full, width)
    sizes = np.maximum(count - width + 1, 0)
    at_full = np.concatenate(([0], np.cumsum(sizes)))
    out = []
    for i in range(n):
        if sizes[i]:
            out.append(np.unique(h[at_full[i] : at_full[i + 1]]))
        elif count[i]:
            out.append(W.window_hashes(words, np.array([first[i]]), int(count[i])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _ordered(tokens: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Sort keys of a set's shingles, ascending; a key also stands for its shingle."""
    key = tokens >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, tokens), len(frequent) - 1)
        hit = frequent[at] == tokens
        key[hit] = _TOP + rank[at[hit]]
    return np.sort(key)


def _prefix(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _group(keys: np.ndarray, n: int) -> np.uint64:
    """Identity of a group: its prefix and size."""
    with np.errstate(over="ignore"):
        powers = W.mix(np.arange(len(keys), dtype=np.uint64) + np.uint64(n) * np.uint64(1 << 32)) | np.uint64(1)
        return W.mix(np.array([(W.mix(keys) * powers).sum()], np.uint64))[0]


def _read(batches):
    for whole in batches:
        for batch in W.slices(whole, "_text", PART):
            data, offs = W.utf8(batch["_text"])
            yield batch, data, offs


def _counted(width: int, parts: int):
    """Shingles of each part of the texts by bucket, with the number of texts of the part that have them."""

    def run(batches):
        for _, data, offs in _read(batches):
            token, count = np.unique(np.concatenate([*_sets(data, offs, width), np.zeros(0, np.uint64)]), return_counts=True)
            packed = W.pack((W.mix(token) >> np.uint64(8)).astype(np.int64) & (parts - 1), token=token, count=count.astype(np.uint32))
            yield pa.RecordBatch.from_arrays(list(packed.values()), list(packed))

    return run


def _frequent(t: pa.Table) -> pa.Table:
    token, at = np.unique(W.unpack(t["token"], np.uint64), return_inverse=True)
    count = np.bincount(at, weights=W.unpack(t["count"], np.uint32), minlength=len(token)).astype(np.int64)
    often = count >= FREQUENT_AT
    return pa.table({"token": token[often].view(np.int64), "count": count[often]})


def _bitmap(tokens: np.ndarray) -> np.ndarray:
    bits = 64 * next(lanes for most, lanes in LANES if len(tokens) <= most)
    flips = np.bincount((W.mix(tokens) >> np.uint64(50)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def _nodes(width: int, percent: int, shared):
    def run(batches):
        frequent, rank = shared.value
        for batch, data, offs in _read(batches):
            n, s1, s2, gid, maps = [], [], [], [], []
            for t in _sets(data, offs, width):
                n.append(len(t))
                maps.append(_bitmap(t))
                s1.append(W.mix(t).sum(dtype=np.uint64))
                s2.append(W.mix(t ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64))
                gid.append(_group(_ordered(t, frequent, rank)[: _prefix(len(t), percent)], len(t)) if len(t) else np.uint64(0))
            cols = [np.array(c, np.uint64).view(np.int64) for c in (s1, s2, gid)]
            ends = np.concatenate(([0], np.cumsum([len(m) for m in maps])))
            bits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(maps)))
            yield pa.RecordBatch.from_arrays([batch["_uid"], pa.array(n, pa.int64()), *map(pa.array, cols), bits], ["_uid", "n", "s1", "s2", "gid", "bits"])

    return run


_TOKENS = "bucket long, token binary, gid binary, n binary, at binary"


def _tokens(width: int, percent: int, parts: int, shared):
    def run(batches):
        frequent, rank = shared.value
        for _, data, offs in _read(batches):
            seen: set[int] = set()
            tokens, gids, sizes, places = [], [], [], []
            for t in _sets(data, offs, width):
                if not len(t):
                    continue
                keys = _ordered(t, frequent, rank)[: _prefix(len(t), percent)]
                g = _group(keys, len(t))
                if int(g) in seen:
                    continue
                seen.add(int(g))
                tokens.append(keys)
                gids.append(np.full(len(keys), g))
                sizes.append(np.full(len(keys), len(t), np.uint32))
                places.append(np.minimum(np.arange(len(keys)), 65535).astype(np.uint16))
            if tokens:
                token = np.concatenate(tokens)
                bucket = (W.mix(token) >> np.uint64(8)).astype(np.int64) & (parts - 1)
                packed = W.pack(bucket, token=token, gid=np.concatenate(gids), n=np.concatenate(sizes), at=np.concatenate(places))
                yield pa.RecordBatch.from_arrays(list(packed.values()), list(packed))

    return run


def _lists(percent: int):
    """Bucket of prefix shingles -> rows (l1, l2, gid): lists of groups that share one. For a list of two, l1 and l2 are the groups and gid is null."""

    def run(t: pa.Table) -> pa.Table:
        token, gid = W.unpack(t["token"], np.uint64), W.unpack(t["gid"], np.uint64)
        n, at = W.unpack(t["n"], np.uint32).astype(np.int64), W.unpack(t["at"], np.uint16).astype(np.int64)
        order = np.argsort(token, kind="stable")  # shingles of one text alone go first
        ts = token[order]
        first = np.ones(len(ts), bool)
        first[1:] = ts[1:] != ts[:-1]
        order = order[~(first & np.append(first[1:], True))]
        order = order[np.lexsort((gid[order], n[order], token[order]))]
        token, gid, n, at = token[order], gid[order], n[order], at[order]
        keep = np.ones(len(token), bool)
        keep[1:] = (token[1:] != token[:-1]) | (gid[1:] != gid[:-1])
        token, gid, n, at = token[keep], gid[keep], n[keep], at[keep]
        new = np.ones(len(token), bool)  # a list ends with its shingle, and where the next size is too large for all before
        new[1:] = (token[1:] != token[:-1]) | (100 * n[:-1] < percent * n[1:])
        cut = np.flatnonzero(new)
        size = np.diff(np.append(cut, len(token)))
        a = cut[size == 2]
        b = a + 1
        need = -(-percent * (n[a] + n[b]) // (100 + percent))
        good = 1 + np.minimum(n[a] - at[a] - 1, n[b] - at[b] - 1) >= need
        a, b = a[good], b[good]
        pairs = np.unique(np.stack((np.minimum(gid[a], gid[b]), np.maximum(gid[a], gid[b]))), axis=1) if len(a) else np.zeros((2, 0), np.uint64)
        of = np.cumsum(new) - 1
        long = size > 2
        rows1, rows2, rows3 = [pairs[0]], [pairs[1]], [np.zeros(0, np.uint64)]
        if long.any():
            h1 = np.add.reduceat(W.mix(gid), cut)
            h2 = np.add.reduceat(W.mix(gid ^ np.uint64(0x9FB21C651E98DF25)), cut)
            _, pick = np.unique(np.stack((h1, h2))[:, long], axis=1, return_index=True)
            chosen = np.zeros(len(cut), bool)
            chosen[np.flatnonzero(long)[pick]] = True
            rows = np.flatnonzero(chosen[of])
            rows1, rows2, rows3 = [*rows1, h1[of[rows]]], [*rows2, h2[of[rows]]], [gid[rows]]
        l1, l2, g = (np.concatenate(x).view(np.int64) for x in (rows1, rows2, rows3))
        nulls = pa.nulls(pairs.shape[1], pa.int64())
        return pa.table({"l1": l1, "l2": l2, "gid": pa.chunked_array([nulls, pa.array(g)])})

    return run


def _verify(width: int, percent: int):
    def run(batches):
        def one(text):
            raw = np.frombuffer((text or "").encode(), np.uint8)
            return _sets(raw, np.array([0, len(raw)]), width)[0]

        last, last_set = None, None
        for batch in batches:
            good = []
            for p, a, b in zip(batch["a"].to_pylist(), batch["a_text"], batch["b_text"], strict=True):
                if p != last:
                    last, last_set = p, one(a.as_py())
                other = one(b.as_py())
                both = len(last_set) + len(other)
                common = both - len(np.unique(np.concatenate((last_set, other))))
                good.append(100 * common >= percent * (both - common))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(good, pa.bool_())], ["a", "b", "good"])

    return run


def _may_link(n, bits, m, other, percent: int):
    """Size and bitmap filters. A bitmap of twice the width is folded first: its halves, combined, are the narrower bitmap of the same set."""

    def xor(x, y):
        return x.bitwiseXOR(y)

    def apart(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda t, v: t + v)

    def folded(x):
        half = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), xor)

    a, b = F.size(bits), F.size(other)
    bound = F.when(a == b, apart(bits, other)).when(a == 2 * b, apart(folded(bits), other)).when(b == 2 * a, apart(bits, folded(other))).otherwise(0)
    near = bound * (100 + percent) <= (n + m) * (100 - percent)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & near


def _verified(pairs: DataFrame, tested: DataFrame | None, texts: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of members that link, and all pairs tested so far. Spark splits a pivot that has very many partners."""
    left = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
    tested = left if tested is None else tested.union(left)
    ids = left.select(F.explode(F.array("a", "b")).alias("_uid")).distinct()
    found = texts.join(ids if ids.count() > BROADCAST_IDS else F.broadcast(ids), "_uid", "left_semi")
    one, two = (found.select(F.col("_uid").alias(x), F.col("_text").alias(f"{x}_text")) for x in ("a", "b"))
    rows = left.join(two, "b").join(one, "a").select("a", "b", "a_text", "b_text")
    return rows.mapInArrow(W.tidy(_verify(width, percent)), "a long, b long, good boolean").filter("good").drop("good"), tested


def _pairs(entries: DataFrame, percent: int, salt: int) -> DataFrame:
    """Members of each list with its pivot: the smallest member, or with a salt the one whose salted hash is smallest."""
    order = F.col("rep") if salt == 0 else F.xxhash64("rep", F.lit(salt))
    pivot = entries.groupBy("l1", "l2").agg(F.min(F.struct(order.alias("o"), "rep", "n", "comp", "bits")).alias("p"))
    may = _may_link(F.col("n"), F.col("bits"), F.col("p.n"), F.col("p.bits"), percent)
    rows = entries.join(pivot, ["l1", "l2"]).filter((F.col("comp") != F.col("p.comp")) & may)
    return rows.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct()


def _all_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """All pairs of members of one list that are in different components and pass the filters."""
    names = {"l1": "k1", "l2": "k2", "rep": "b", "n": "m", "comp": "d", "bits": "other"}
    two = entries.select(*(F.col(c).alias(x) for c, x in names.items()))
    on = (F.col("l1") == F.col("k1")) & (F.col("l2") == F.col("k2")) & (F.col("rep") < F.col("b")) & (F.col("comp") != F.col("d"))
    may = _may_link(F.col("n"), F.col("bits"), F.col("m"), F.col("other"), percent)
    return entries.join(two, on & may).select(F.col("rep").alias("a"), "b").distinct()


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The id, n_shingles and component_id (the smallest id that links reach) of each row.

    Words are runs without ASCII white space, A-Z in lower case. A set has the distinct runs of `width` words, or all words as one if there
    are fewer; without words (or with a null text) it is empty and links with nothing. Two rows link if 100 |x & y| >= percent |x | y|. Rows with
    equal or null ids are ordered by text, null id first; a component that holds a null id has it as its smallest. No rows give no rows.
    """
    rows, same = with_uid(docs, id_col, text_col)
    out = _homes(rows.select("_uid", F.coalesce("_text", F.lit("")).alias("_text")), width, percent)
    kind = dict(docs.dtypes)[id_col]
    if same:
        return out.select(F.col("_uid").cast(kind).alias(id_col), "n_shingles", F.col("comp").cast(kind).alias("component_id"))
    ids = rows.select("_uid", F.col(f"_in_{id_col}").alias("_id"))
    named = out.join(ids, "_uid").withColumnRenamed("_id", id_col)
    return named.join(ids.select(F.col("_uid").alias("comp"), F.col("_id").alias("component_id")), "comp").select(id_col, "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The rows that are the first of their component (see jaccard_components), unchanged; rows with empty sets all stay."""
    rows, same = with_uid(docs, id_col, text_col, *docs.columns)
    homes = _homes(rows.select("_uid", F.coalesce("_text", F.lit("")).alias("_text")), width, percent)
    gone = written(homes.filter("comp <> _uid").select("_uid"))
    gone = gone if gone.count() > BROADCAST_IDS else F.broadcast(gone)
    if same:
        return docs.join(gone, docs[id_col] == gone["_uid"], "left_anti")
    return rows.join(gone, "_uid", "left_anti").select(*(F.col(f"_in_{c}").alias(c) for c in docs.columns))


def _homes(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """_uid, n_shingles and comp, the smallest _uid of the component, of rows with unique _uid."""
    spark = rows.sparkSession
    texts = rows.select("_uid", "_text")
    parts = buckets(text_bytes(rows), 4 * PART)
    counts = texts.mapInArrow(W.tidy(_counted(width, parts)), "bucket long, token binary, count binary").groupBy("bucket").applyInArrow(_frequent, "token long, count long")
    top = counts.orderBy(F.desc("count"), "token").limit(FREQUENT_MOST).toArrow()
    frequent = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(frequent)
    shared = spark.sparkContext.broadcast((frequent[order], (len(frequent) - order).astype(np.uint64)))  # 16 bytes for each of FREQUENT_MOST at most

    nodes = written(texts.mapInArrow(W.tidy(_nodes(width, percent, shared)), "_uid long, n long, s1 long, s2 long, gid long, bits array<bigint>"))
    sets = nodes.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("_uid").alias("rep"), F.min("gid").alias("gid"), F.first("bits").alias("bits"))
    sets = written(sets)
    tokens = texts.mapInArrow(W.tidy(_tokens(width, percent, parts, shared)), _TOKENS)
    lists = tokens.groupBy("bucket").applyInArrow(_lists(percent), "l1 long, l2 long, gid long").distinct()
    of_two = lists.filter("gid is null").select("l1", "l2", F.explode(F.array("l1", "l2")).alias("gid"))
    same_group = sets.groupBy("gid").count().filter("count > 1").select(F.col("gid").alias("l1"), F.col("gid").alias("l2"), "gid")
    grouped = lists.filter("gid is not null").union(of_two).union(same_group)
    entries = written(grouped.distinct().join(sets.select("gid", "rep", "n", "bits"), "gid").select("l1", "l2", "rep", "n", "bits"))

    links, tested = _verified(_pairs(entries.withColumn("comp", F.col("rep")), percent, 0), None, texts, width, percent)
    labels = components(links)
    before, salt = None, 0
    while True:
        named = entries.join(labels, entries.rep == labels.node, "left").select("l1", "l2", "rep", "n", "bits", F.coalesce("label", "rep").alias("comp"))
        per = named.groupBy("l1", "l2", "comp").agg(F.count(F.lit(1)).alias("c"))
        stats = per.groupBy("l1", "l2").agg(F.sum("c").alias("t"), F.sum(F.col("c") * F.col("c")).alias("q"), F.count(F.lit(1)).alias("k"))
        # lists of two are settled; so are those within one component
        open_lists = stats.filter("k > 1 and t > 2").select("l1", "l2", ((F.col("t") * F.col("t") - F.col("q")) / 2).alias("cross"), "t")
        left = open_lists.agg(F.sum("cross"), F.sum("t")).first()
        if not left[0]:
            break
        rest = written(named.join(open_lists.select("l1", "l2"), ["l1", "l2"]))
        last = left[0] <= 4 * left[1] or (before is not None and left[0] > before / 2)
        before, salt = left[0], salt + 1
        pairs = _all_pairs(rest, percent) if last else _pairs(rest, percent, salt)
        # components so far are stars; new links join them
        stars = labels.select(F.col("node").alias("a"), F.col("label").alias("b"))
        links, tested = _verified(pairs, tested, texts, width, percent)
        labels = components(stars.union(links))
        if last:
            break
    home = sets.join(labels, sets.rep == labels.node, "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("comp"))
    return nodes.join(home, ["n", "s1", "s2"], "left").select("_uid", F.col("n").alias("n_shingles"), F.coalesce("comp", "_uid").alias("comp"))
