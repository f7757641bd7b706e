"""Byte-level BPE by speculation: propose by longest match, verify adjacent pairs, merge exactly only where a pair fails.

A token sequence is what merging by rank gives if, and only if, that holds for each two adjacent tokens. Whether it holds for a pair
is found by undoing their merges from the last one back: whenever the piece that ends the left token and the piece that begins the
right one were there at the same time, a merge of the two must not have come before one of them was used up. The check runs for all
distinct new pairs of a part of the table at once, in numpy. Words whose proposal has a failing pair are merged by rank: short ones all together,
one merge of each at a time, long ones with a heap.

Words are what the vocabulary's splitting rule gives. Each worker keeps the words it has met in two generations of up to CACHE words:
when the younger is full it becomes the older, and words of the older that occur again are carried over.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagevault.llm import words as W

CACHE = 80_000
PART = 2 << 20
SHORT = 48  # bytes of a word that is worked on together with others
TOGETHER = 4096
# fixed values: the public splitting rule of this vocabulary, with white space spelled out as Unicode has it
_WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WHITE}\p{{L}}\p{{N}}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable in Latin-1, else the next one from 256 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one vocabulary file (its JSON text)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        vocab, alphabet = spec["model"]["vocab"], _alphabet()
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        self.ids = {b: i for i, b in enumerate(self.bytes) if b}
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.made_at = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1 for single bytes
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((a, b), (rank, c))
            if self.made_at[c] < 0:
                self.left[c], self.right[c], self.made_at[c] = a, b, rank
        keys = np.array([a << 32 | b for a, b in self.merge], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.made = np.array([vocab[a + b] for a, b in merges] or [-1], np.int64)  # by rank
        self.longest: dict[bytes, int] = {}
        for b in self.ids:
            self.longest[b[:2]] = max(self.longest.get(b[:2], 1), len(b))
        # a trie of all tokens: `steps` are sorted keys of node and byte, `child` the node that each leads to
        nodes = {b"": 0}
        for b in self.ids:
            for j in range(1, len(b) + 1):
                nodes.setdefault(b[:j], len(nodes))
        steps = np.array([nodes[b[:-1]] << 8 | b[-1] for b in nodes if b], np.int64)
        order = np.argsort(steps)
        self.steps, self.child = steps[order], order + 1
        self.token_at = np.array([self.ids.get(b, -1) for b in nodes], np.int64)
        self.byte_id = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.names = list(map(str, range(size)))
        self.split = regex.compile(SPLIT)
        self.parts = regex.compile("|".join(regex.escape(t) for t in self.special)) if self.special else None
        self.coded: dict[str, str] = {}
        self.decoded: dict[str, bytes] = {}
        self.older: tuple[dict[str, str], dict[str, bytes]] = ({}, {})

    def propose(self, word: bytes) -> list[int]:
        """Greedy: the longest token that fits at each place."""
        ids, longest, out, i, n = self.ids, self.longest, [], 0, len(word)
        while i < n:
            j = min(n, i + longest.get(word[i : i + 2], 1))
            while word[i:j] not in ids:
                j -= 1
            out.append(ids[word[i:j]])
            i = j
        return out

    def propose_all(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """`propose` for all words data[offs[i] : offs[i + 1]] at once, a byte of each at a time: their tokens in order, and how many each has."""
        word, at, end = np.arange(len(offs) - 1), offs[:-1].copy(), offs[1:].copy()
        node, best, stop = np.zeros(len(word), np.int64), np.full(len(word), -1), at.copy()
        words, tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(word):
            key = node << 8 | data[np.minimum(at, len(data) - 1)]
            k = np.minimum(np.searchsorted(self.steps, key), len(self.steps) - 1)
            on = (self.steps[k] == key) & (at < end)
            at += on
            node = np.where(on, self.child[k], 0)
            token = self.token_at[node]
            some = on & (token >= 0)
            best, stop = np.where(some, token, best), np.where(some, at, stop)
            off = np.flatnonzero(~on)  # nothing longer: the longest token so far is taken, and the next begins after it
            words.append(word[off])
            tokens.append(best[off])
            at[off] = stop[off]
            if (stop[off] == end[off]).any():
                more = on | (stop < end)
                word, at, end, node, best, stop = (v[more] for v in (word, at, end, node, best, stop))
        words, tokens = np.concatenate(words), np.concatenate(tokens)
        return tokens[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(offs) - 1)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair; a very large number if there is none."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.int64(1) << 40)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of adjacent tokens: does merging by rank leave both as they are?"""
        good = np.ones(len(a), bool)
        never = np.int64(1) << 40
        live = np.arange(len(a))
        x, y = a.copy(), b.copy()  # the pieces on either side of the boundary, going back in time
        x_end, y_end = np.full(len(a), never), np.full(len(a), never)  # rank of the merge that uses each up
        while len(live):
            m = np.maximum(self._rank(x, y), np.maximum(self.made_at[x], self.made_at[y]))
            # of two merges of one rank the left one comes first
            crossed = (m < x_end) & (m <= y_end) & (m < never)
            good[live[crossed]] = False
            back_x = self.made_at[x] >= self.made_at[y]  # undo the later merge of the two; of equal ones the right one is the later
            back_x &= ~((self.made_at[x] == self.made_at[y]) & (self.made_at[y] >= 0))
            more = ~crossed & (np.maximum(self.made_at[x], self.made_at[y]) >= 0)
            live, x, y, x_end, y_end, back_x = (v[more] for v in (live, x, y, x_end, y_end, back_x))
            x_end, y_end = np.where(back_x, self.made_at[x], x_end), np.where(back_x, y_end, self.made_at[y])
            x, y = np.where(back_x, self.right[x], x), np.where(back_x, y, self.left[y])
        return good

    def merged(self, word: bytes) -> list[int]:
        """Exact merging by rank, leftmost first: by scanning for short words, with a heap for long ones (n log n for any word)."""
        tok = [self.ids[word[i : i + 1]] for i in range(len(word))]
        if len(tok) <= SHORT:
            rank, never = self.merge.get, (1 << 40, -1)
            ranks = [rank(p, never) for p in zip(tok, tok[1:], strict=False)]
            while ranks:
                best = min(ranks)
                if best is never:
                    break
                i = ranks.index(best)
                tok[i : i + 2] = [best[1]]
                del ranks[i]
                if i < len(ranks):
                    ranks[i] = rank((tok[i], tok[i + 1]), never)
                if i:
                    ranks[i - 1] = rank((tok[i - 1], tok[i]), never)
            return tok
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*self.merge[p], i, *p) for i in range(n - 1) if (p := (tok[i], tok[i + 1])) in self.merge]
        heap = [(r, i, c, a, b) for r, c, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, c, a, b = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j], nxt[i] = c, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
            for k in (prv[i], i):
                if k >= 0 and nxt[k] < n and (p := (tok[k], tok[nxt[k]])) in self.merge:
                    r, made = self.merge[p]
                    heapq.heappush(heap, (r, k, made, *p))
        return [t for t in tok if t >= 0]

    def merged_all(self, data: np.ndarray, offs: np.ndarray) -> list[list[int]]:
        """`merged` for all words data[offs[i] : offs[i + 1]] of up to SHORT bytes at once, a merge of each at a time."""
        size, out = np.diff(offs), [[] for _ in offs[1:]]
        never = np.int64(1) << 46
        by_size = np.argsort(size, kind="stable")
        for some in (by_size[i : i + TOGETHER] for i in range(0, len(by_size), TOGETHER)):
            n, row = int(size[some[-1]]), np.arange(size[some[-1]] + 1)[:, None]
            # a column for each word; the last row stands for what lies beyond either end
            tok = np.where(row < size[some], self.byte_id[data[np.minimum(offs[some] + row, len(data) - 1)]], -1)
            nxt, prv = np.repeat(np.minimum(row + 1, n), len(some), 1), np.repeat(np.where(row > 0, row - 1, n), len(some), 1)
            first = np.full(tok.shape, never)  # rank of the merge with the next token, then place: the least one is next
            first[:-1] = self._rank(tok[:-1], tok[1:]) << 6 | row[:-1]
            live = np.arange(len(some))
            least = first.min(axis=0)
            while len(live := live[least < never]):
                least = least[least < never]
                i = least & 63
                j = nxt[i, live]
                k, h = nxt[j, live], prv[i, live]
                tok[i, live], tok[j, live], first[j, live] = self.made[least >> 6], -1, never
                nxt[i, live], prv[k, live] = k, i
                t = tok[i, live]
                first[i, live] = self._rank(t, tok[k, live]) << 6 | i
                first[h, live] = self._rank(tok[h, live], t) << 6 | h
                least = first[:, live].min(axis=0)
            left = tok.T >= 0
            tokens, cut = tok.T[left].tolist(), np.cumsum(left.sum(axis=1)).tolist()
            for w, a, b in zip(some.tolist(), [0, *cut], cut, strict=False):
                out[w] = tokens[a:b]
        return out

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Tokens of each word: proposals, one vectorised check of all distinct pairs, exact merging of the words that fail.

        Short words are proposed and merged all at once, long ones one by one.
        """
        order = [i for i, w in enumerate(words) if len(w) <= SHORT]
        short = len(order)
        order += [i for i, w in enumerate(words) if len(w) > SHORT]
        data = np.frombuffer(b"".join([words[i] for i in order[:short]]), np.uint8)
        offs = np.cumsum([0, *(len(words[i]) for i in order[:short])])
        tokens, count = self.propose_all(data, offs)
        long = [self.propose(words[i]) for i in order[short:]]
        tokens = np.concatenate([tokens, *(np.array(ids, np.int64) for ids in long)])
        count = np.concatenate([count, np.array([len(ids) for ids in long], np.int64)])
        word = np.repeat(np.arange(len(order)), count)
        at = np.flatnonzero(word[1:] == word[:-1])
        pairs, which = np.unique(tokens[at] << 32 | tokens[at + 1], return_inverse=True)
        bad = np.zeros(len(order), bool)
        bad[word[at[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[which]]]] = True
        out: list[list[int]] = [[]] * len(words)
        listed, cut = tokens.tolist(), np.cumsum(count).tolist()
        for i, a, b in zip(order, [0, *cut], cut, strict=False):
            out[i] = listed[a:b]
        failed = np.flatnonzero(bad)
        again, rest = failed[failed < short], failed[failed >= short]
        data = np.frombuffer(b"".join([words[order[f]] for f in again]), np.uint8)
        for f, ids in zip(again, self.merged_all(data, np.cumsum([0, *(len(words[order[f]]) for f in again)])), strict=True):
            out[order[f]] = ids
        for f in rest:
            out[order[f]] = self.merged(words[order[f]])
        return out

    def decode(self, ids) -> bytes:
        return b"".join([self.bytes[i] for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Words of a text in order; special tokens that it spells out are pieces of their own."""
        if self.parts is None or not any(t in text for t in self.special):
            return self.split.findall(text)
        out, at = [], 0
        for m in self.parts.finditer(text):
            out += self.split.findall(text, at, m.start()) if m.start() > at else []
            out.append(m[0])
            at = m.end()
        return out + self.split.findall(text[at:])

    def learn(self, pieces: set[str]) -> None:
        """Fill the caches for these pieces."""
        if len(self.coded) > CACHE:
            self.older = self.coded, self.decoded
            self.coded, self.decoded = {}, {}
        coded, decoded = self.older
        for p in (pieces - self.coded.keys()) & coded.keys() if coded else ():
            self.coded[p], self.decoded[p] = coded[p], decoded[p]
        for t in pieces & self.special.keys():
            self.coded[t], self.decoded[t] = str(self.special[t]), self.bytes[self.special[t]]
        new = [p for p in pieces if p not in self.coded]
        names = self.names
        for piece, ids in zip(new, self.encode_words([p.encode() for p in new]), strict=True):
            self.coded[piece] = ",".join([names[i] for i in ids])
            self.decoded[piece] = self.decode(ids)

    def encode_texts(self, texts: list[str]) -> list[list[str]]:
        listed = [self.pieces(t) for t in texts]
        self.learn(set().union(*listed))
        return listed


def _encoder(shared) -> Bpe:
    loaded, key = W.worker_store("bpe"), hash(shared.value)
    if key not in loaded:
        loaded.clear()
        loaded[key] = Bpe(shared.value)
    return loaded[key]


def _run(shared, tokens: bool):
    def run(batches):
        bpe = _encoder(shared)
        try:
            yield from encoded(bpe, batches)
        finally:
            bpe.coded, bpe.decoded, bpe.older = {}, {}, ({}, {})  # a worker that turns to other work keeps the tables only

    def encoded(bpe, batches):
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                texts = [t or "" for t in batch["_text"].to_pylist()]
                cols: list[list] = [[], [], [], [], []]
                for pieces in bpe.encode_texts(texts):
                    coded = ",".join(map(bpe.coded.__getitem__, pieces))
                    back = b"".join(map(bpe.decoded.__getitem__, pieces)).decode("utf-8", "replace")
                    row = (
                        coded.count(",") + 1 if coded else 0,
                        hashlib.sha256(coded.encode()).hexdigest(),
                        hashlib.sha256(back.encode()).hexdigest(),
                        np.fromstring(coded, np.int32, sep=",") if tokens and coded else [] if tokens else None,
                        back if tokens else None,
                    )
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = (pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch["_uid"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["_uid", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"],
                )

    return run


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, tokens: bool = True) -> DataFrame:
    """The id, n_tokens, ids_sha256, decoded_sha256 of each row, and with `tokens` also ids and decoded.

    The driver reads the vocabulary file and sends it to the workers; its size does not depend on the data. A null text
    counts as empty and has no tokens. Ids may be null or repeated: rows are independent. An empty table gives an empty result.
    """
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(W.tidy(_run(shared, tokens)), f"_uid {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    out = out.withColumnRenamed("_uid", id_col)
    return out if tokens else out.drop("ids", "decoded")
