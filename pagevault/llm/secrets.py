"""Secret scans by a linear-chain conditional random field over tokens, beside fixed patterns.

Tokens are runs of letters, digits and + / _ -. Each gets one of three tags: a secret begins here, goes on here, or neither. The
score of a tagging is the sum of feature weights for each token and tag (length, shape, digits, hexadecimal, changes between letters and
digits, what stands between it and its neighbours, the neighbours' shapes and whether they are words like `password`, and features of the
whole text) and of a weight for each two successive tags. Training maximises the conditional likelihood (forward-backward) on windows of a
bounded sample that the fixed patterns label; features are dropped at random, so that shape and context each learn to do alone.

Decoding is Viterbi. A token whose own score for "neither" leads by more than its two tag transitions can make up
has that tag in every best path; the path falls apart there, and only the short stretches between such tokens are run through.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.llm import words as W
from pagevault.llm.frames import attach
from pagevault.llm.sample import fitted, window_of

KINDS = ("assign", "access", "hex", "crf")
PART = 1 << 20
SAMPLE = 1200  # texts with and texts without a fixed pattern in the fit
LEAST = 6  # code points of a secret
# fixed values: the patterns of the base
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LENGTHS = {"assign": 6, "access": 20, "hex": 24}
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_CONTEXT = "password passwd pwd pass secret token api apikey api_key key auth bearer credential credentials access private client passphrase kennwort passwort contraseña".split()


def _table(*ranges) -> np.ndarray:
    t = np.zeros(256, bool)
    for r in ranges:
        t[list(r)] = True
    return t


_DIGIT, _UPPER, _LOWERCASE, _HIGH = _table(range(0x30, 0x3A)), _table(range(0x41, 0x5B)), _table(range(0x61, 0x7B)), _table(range(0x80, 0x100))
_SIGN = _table(b"+/_-")
_HEXCHARS = _table(range(0x30, 0x3A), range(0x61, 0x67))
_TOKEN = W.ALNUM | _SIGN
_CLASS = np.zeros(256, np.uint8)
_CLASS[_DIGIT], _CLASS[_UPPER], _CLASS[_LOWERCASE], _CLASS[_SIGN], _CLASS[_HIGH] = 1, 2, 3, 4, 5
_STEPS = np.array([2, 3, 4, 6, 8, 12, 16, 20, 24, 32, 48])

# sizes of the feature groups, in order: length, shape, hexadecimal by length, digits by length, changes by length, keyword before by gap, keyword two before, gap before,
# gap after, shape after, shape before, first characters, mixed tokens in the text, signs of code, length of the text
_GROUPS = (12, 32, 24, 72, 84, 16, 2, 8, 8, 32, 32, 64, 4, 2, 6)
_AT = np.concatenate(([0], np.cumsum(_GROUPS)[:-1])) + 1  # feature 0 is the dropped one and weighs nothing
N_FEATURES = 1 + sum(_GROUPS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, sorted; leftmost and non-overlapping in each kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LENGTHS["assign"]]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LENGTHS["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LENGTHS["hex"]]
    return sorted(out)


class Tokens:
    """Tokens of several texts and their features."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs = data, offs
        self.starts, self.ends, self.doc = W.spans(data, offs, _TOKEN)
        self.n_docs = len(offs) - 1
        self.count, self.first, self.at = W.within(self.doc, self.n_docs)

    def _sums(self, flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int32)
        np.cumsum(flags, out=total[1:])
        return total[self.ends] - total[self.starts]

    def features(self, context: np.ndarray) -> np.ndarray:
        """tokens x groups: numbers of features."""
        data, s, e, n = self.data, self.starts, self.ends, len(self.starts)
        if n == 0:
            return np.zeros((0, len(_GROUPS)), np.int32)
        size = (e - s).astype(np.int32)
        length = np.searchsorted(_STEPS, size, side="right")
        kind = _CLASS[data]
        digits, upper, lower = self._sums(kind == 1), self._sums(kind == 2), self._sums(kind == 3)
        sign, high = self._sums(kind == 4), self._sums(kind == 5)
        changes = np.zeros(len(data), bool)
        changes[1:] = kind[1:] != kind[:-1]
        changed = self._sums(changes) - changes[s]
        hexed = self._sums(_HEXCHARS[data]) == size
        shape = (digits > 0) + 2 * (upper > 0) + 4 * (lower > 0) + 8 * (sign > 0) + 16 * (high > 0)
        head = self.at == 0

        def shifted(values, k, none):
            out = np.full(n, none, np.int64)
            if k > 0:
                out[k:] = np.where(self.doc[k:] == self.doc[:-k], values[:-k], none)
            else:
                out[:k] = np.where(self.doc[:k] == self.doc[-k:], values[-k:], none)
            return out

        low = W.word_hashes(W.LOWER[data], s, e)
        at = np.minimum(np.searchsorted(context, low), len(context) - 1)
        key = (context[at] == low).astype(np.int64)
        # what stands before a token: its last byte, and whether there is : or =
        marks = np.zeros(len(data) + 1, np.int32)
        np.cumsum((data == 0x3A) | (data == 0x3D), out=marks[1:])
        gap_from = np.where(head, self.offs[:-1][self.doc], np.concatenate(([0], e[:-1])))
        assigns = marks[s] - marks[gap_from] > 0
        last = np.where(s > gap_from, data[np.maximum(s - 1, 0)], 0)
        gap = np.select([assigns, s == gap_from, last == 0x20, last == 0x0A, (last == 0x22) | (last == 0x27), last == 0x2E, last == 0x40], [1, 0, 2, 3, 4, 5, 6], 7)
        after = shifted(gap, -1, 0)
        first = np.zeros(n, np.int64)
        for k in range(4):
            first = first * 131 + np.where(k < size, data[np.minimum(s + k, len(data) - 1)], 0)
        first = np.where((upper >= 4) & (size >= 12), 1 + first % 63, 0)
        mixed = (digits > 0) & (upper + lower > 0)
        per_doc = np.bincount(self.doc, weights=mixed, minlength=self.n_docs) / np.maximum(self.count, 1)
        code = np.bincount(self.doc, weights=(last == 0x7B) | (last == 0x3B), minlength=self.n_docs) > 0
        groups = (
            length, shape, length + 12 * hexed, length + 12 * np.minimum(5, 6 * digits // np.maximum(size, 1)), length + 12 * np.minimum(6, changed),
            shifted(key, 1, 0) * 8 + gap, shifted(key, 2, 0), gap, after, shifted(shape, -1, 0), shifted(shape, 1, 0), first,
            np.searchsorted([0.01, 0.05, 0.2], per_doc, side="right")[self.doc], code[self.doc].astype(np.int64),
            np.minimum(5, np.log10(np.maximum(self.count, 1)).astype(np.int64))[self.doc],
        )
        return np.stack([g + a for g, a in zip(groups, _AT, strict=True)], axis=1).astype(np.int32)


def context_hashes() -> np.ndarray:
    data, offs = W.utf8(pa.array(_CONTEXT, pa.string()))
    return np.unique(W.word_hashes(data, offs[:-1], offs[1:]))


def emissions(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """tokens x 3 (neither, begins, goes on)."""
    out = np.zeros((len(features), 3), np.float32)
    for g in range(features.shape[1]):
        out += weights[features[:, g]]
    return out


def viterbi(emit: np.ndarray, move: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The best tags of sequences laid end to end; `cut` marks the first token of each. move[a, b]: b after a."""
    n = len(emit)
    tags = np.zeros(n, np.int8)
    # the lead of "neither" that no two transitions can make up
    sure = emit[:, 0] - emit[:, 1:].max(1) > 2 * (move.max() - move.min()) if n else np.zeros(0, bool)
    open_ = np.flatnonzero(~sure)
    if not len(open_):
        return tags
    new = np.ones(len(open_), bool)
    new[1:] = (open_[1:] != open_[:-1] + 1) | cut[open_[1:]]
    begin = open_[new]
    size = np.diff(np.append(np.flatnonzero(new), len(open_)))
    after = begin + size
    before_sure = ~cut[begin]  # then the token before has tag 0
    after_sure = (after < n) & ~cut[np.minimum(after, n - 1)]
    for low in (1, 2, 4, 8, 16, 32, 64, 128, 512, 4096, 1 << 62):  # stretches of similar length together
        rows = np.flatnonzero(size == 1 if low == 1 else (size > low // 2 if low <= 128 else size > (128 if low == 512 else 512 if low == 4096 else 4096)) & (size <= low))
        if not len(rows):
            continue
        longest = int(size[rows].max())
        best = emit[begin[rows]] + np.where(before_sure[rows][:, None], move[0][None], 0)
        back = np.zeros((longest, len(rows), 3), np.int8)
        for t in range(1, longest):
            live = size[rows] > t
            step = best[:, :, None] + move[None]
            back[t] = step.argmax(1)
            nxt = step.max(1) + emit[np.minimum(begin[rows] + t, n - 1)]
            best = np.where(live[:, None], nxt, best)
        best = best + np.where(after_sure[rows][:, None], move[:, 0][None], 0)
        tag = best.argmax(1)
        for t in range(longest - 1, -1, -1):
            live = size[rows] > t
            tags[begin[rows[live]] + t] = tag[live]
            if t:
                tag = np.where(live, back[t][np.arange(len(rows)), tag], tag)
    return tags


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def train(features: np.ndarray, tags: np.ndarray, inside: np.ndarray, rounds: int = 120, seed: int = 3, batch: int = 1024) -> dict:
    """Weights from windows (windows x tokens x groups), their tags, and which tokens are there at all; `batch` of them in a step."""
    rng = np.random.default_rng(seed)
    w, move = np.zeros((N_FEATURES, 3)), np.zeros((3, 3))
    if len(tags) == 0:
        return {"weights": w.astype(np.float32), "move": move.astype(np.float32)}
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(move), np.zeros_like(move)]
    every, every_tag, every_inside = features, tags, inside
    for step in range(1, rounds + 1):
        pick = rng.choice(len(every), min(batch, len(every)), replace=False)
        features, tags, inside = every[pick], every_tag[pick], every_inside[pick]
        n, length = tags.shape
        real = np.zeros((n, length, 3))
        real[np.arange(n)[:, None], np.arange(length)[None], tags] = inside
        both = inside[:, 1:] & inside[:, :-1]
        true_moves = np.zeros((3, 3))
        np.add.at(true_moves, (tags[:, :-1][both], tags[:, 1:][both]), 1)
        f = np.where(rng.random((n, 1, features.shape[2])) < 0.2, 0, features)  # a group is dropped for a whole window
        e = w[f].sum(2) * inside[:, :, None]
        a, b = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        a[:, 0] = e[:, 0]
        for t in range(1, length):
            nxt = _log_sum(a[:, t - 1, :, None] + move[None], 1) + e[:, t]
            a[:, t] = np.where(inside[:, t, None], nxt, a[:, t - 1])
        for t in range(length - 2, -1, -1):
            nxt = _log_sum(move[None] + (e[:, t + 1] + b[:, t + 1])[:, None, :], 2)
            b[:, t] = np.where(inside[:, t + 1, None], nxt, b[:, t + 1])
        z = _log_sum(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None]) * inside[:, :, None]
        g = p - real
        gw = np.stack([np.bincount(f.ravel(), weights=np.broadcast_to(g[:, :, None, k], f.shape).ravel(), minlength=N_FEATURES) for k in range(3)], axis=1)
        gw[0] = 0
        pair = np.exp(a[:, :-1, :, None] + move[None, None] + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * both[:, :, None, None]
        gm = pair.sum((0, 1)) - true_moves
        gw, gm = gw / n + 2e-4 * w, gm / n + 1e-2 * move
        for k, (x, grad) in enumerate(((w, gw), (move, gm))):
            m, s = state[2 * k], state[2 * k + 1]
            m += 0.1 * (grad - m)
            s += 0.02 * (grad * grad - s)
            x -= 0.12 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.98**step)) + 1e-8)
    return {"weights": w.astype(np.float32), "move": move.astype(np.float32)}


def _windows(texts: list[str], width: int = 12, seed: int = 5):
    """Training windows: around labelled tokens, around other tokens that mix letters and digits, and anywhere."""
    rng, context = np.random.default_rng(seed), context_hashes()
    feats, tags, inside = [], [], []
    for text in texts:
        raw = text.encode()
        t = Tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        n = len(t.starts)
        if not n:
            continue
        y = np.zeros(n, np.int64)
        byte = np.cumsum([0, *(len(c.encode()) for c in text)]) if not text.isascii() else None
        for m_start, kind, m_end in base_spans(text):
            if kind == 0:
                m_start = m_end - len(ASSIGN.match(text, m_start)[2])
            a, b = (m_start, m_end) if byte is None else (byte[m_start], byte[m_end])
            inner = np.flatnonzero((t.starts < b) & (t.ends > a))
            y[inner] = 2
            y[inner[:1]] = 1
        f = t.features(context)
        odd = np.flatnonzero((y == 0) & (f[:, 1] - _AT[1] & 1 > 0))
        centres = np.concatenate((np.flatnonzero(y == 1), rng.permutation(odd)[:4], rng.integers(0, n, 3)))
        for c in centres:
            lo, hi = max(0, c - width), min(n, c + width)
            pad = 2 * width - (hi - lo)
            feats.append(np.pad(f[lo:hi], ((0, pad), (0, 0))))
            tags.append(np.pad(y[lo:hi], (0, pad)))
            inside.append(np.arange(2 * width) < hi - lo)
    if not feats:
        return np.zeros((0, 2 * width, len(_GROUPS)), np.int32), np.zeros((0, 2 * width), np.int64), np.zeros((0, 2 * width), bool)
    return np.stack(feats), np.stack(tags), np.stack(inside)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """A model from at most `sample` texts with a fixed pattern and as many others, chosen by a hash of the text, trained in one task.

    Of longer texts a window takes part. Where no text has a token, the field adds no span.
    """
    texts = docs.select(F.col(text_col).alias("t")).filter(F.length("t") > 0).select(F.xxhash64("t").alias("h"), window_of(F.col("t")).alias("t"))
    every = max(1, docs.count() // (20 * sample))
    pattern = F.col("t").rlike(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}")
    some = texts.filter(F.pmod("h", F.lit(every)) == 0).select("h", pattern.alias("p"))  # texts are read again for the chosen ones only
    kinds = [some.filter(F.col("p") == p).select("h").distinct().orderBy("h").limit(sample).select(F.lit(k).alias("kind"), "h") for k, p in enumerate((True, False))]
    picked = F.broadcast(kinds[0].unionByName(kinds[1]))  # 2 x `sample` numbers
    rows = texts.join(picked, "h").groupBy("kind", "h").agg(F.min("t").alias("t"))

    def learn(rows: list[tuple]) -> dict:
        return train(*_windows([r[2] for r in rows])) | {"context": context_hashes()}

    return fitted(rows, learn)


def scan_texts(texts, model: dict, redact: bool) -> list[pa.Array]:
    """Arrays of the columns of scan() after the id."""
    data, offs = W.utf8(texts)
    n = len(texts)
    t = Tokens(data, offs)
    tags = viterbi(emissions(t.features(model["context"]), model["weights"]), model["move"], t.at == 0)
    hit = tags > 0
    starts = hit.copy()
    starts[1:] &= (tags[1:] == 1) | ~hit[:-1] | (t.doc[1:] != t.doc[:-1])
    head = np.flatnonzero(starts)
    run_of = np.cumsum(starts) - 1
    ends = np.zeros(len(head), np.int64)
    np.maximum.at(ends, run_of[hit], t.ends[hit])
    spans: dict[int, list] = {}
    for d, a, b in zip(t.doc[head].tolist(), t.starts[head].tolist(), ends.tolist(), strict=True):
        spans.setdefault(d, []).append((a - int(offs[d]), b - int(offs[d])))
    # texts that can have a base pattern: by its name, by AKIA, by a long enough hexadecimal run
    may = set()
    low, raw = W.LOWER[data].tobytes(), data.tobytes()
    for hay, names in ((low, _NAMES), (raw, (b"AKIA",))):
        for name in names:
            at = hay.find(name)
            while at >= 0:
                d = int(np.searchsorted(offs, at, side="right")) - 1
                may.add(d)
                at = hay.find(name, int(offs[d + 1]) if d + 1 < len(offs) else len(hay))
    s, e, doc = W.spans(data, offs, _HEXCHARS)
    may.update(doc[e - s >= LENGTHS["hex"]].tolist())
    cols: list[list] = [[0] * n, [0] * n, [0] * n, [""] * n, [""] * n, [None] * n]
    for d in may | spans.keys():
        text = raw[offs[d] : offs[d + 1]].decode()
        base = base_spans(text) if d in may else []
        for k in range(3):
            cols[k][d] = sum(x[1] == k for x in base)
        every = list(base)
        for a, b in spans.get(d, ()):
            if len(text) != offs[d + 1] - offs[d]:  # bytes to code points
                part = raw[offs[d] : offs[d] + b]
                a, b = len(part[:a].decode()), len(part.decode())
            if b - a >= LEAST and not any(a < y and x < b for x, _, y in base):
                every.append((a, 3, b))
        cols[3][d] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        cols[4][d] = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(every))
        cols[5][d] = _redacted(text, every) if redact and every else None
    sha = [hashlib.sha256(x.encode()).hexdigest() for x in cols[3]]
    return [pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(c, pa.string()) for c in (sha, cols[4], cols[5])]


def _scan(shared, redact: bool):
    def run(batches):
        for whole in batches:
            for batch in W.slices(whole, "_text", PART):
                cols = scan_texts(batch["_text"], shared.value, redact)
                yield pa.RecordBatch.from_arrays([batch["_uid"], *cols], ["_uid", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "redacted"])

    return run


def _redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True) -> DataFrame:
    """The id, n_assign, n_access, n_hex, base_sha256, spans (kind:start:end in code points) and, with `redacted`, the text with each span replaced (null if there is none).

    Null texts count as empty; rows are independent, so ids may be null or repeated.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(_scan(shared, redacted), f"_uid {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, redacted string")
    out = out.withColumnRenamed("_uid", id_col)
    return out if redacted else out.drop("redacted")


def redacted(docs: DataFrame, model: dict, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows; in those with secrets each span is replaced in the text, and `chars_col` (if the table has it) counts the new text.

    Rows are independent, so repeated rows stay and change alike; null and empty texts stay as they are, and texts of any length are scanned whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = T.StructType([T.StructField("text", T.StringType())])
    out, (new,) = attach(docs, text_col, lambda: shared.value, lambda m, texts: scan_texts(texts, m, True)[5:], added, PART)
    changed = F.col(new).isNotNull()
    if chars_col in docs.columns:
        kind = dict(docs.dtypes)[chars_col]
        out = out.withColumn(chars_col, F.when(changed, F.length(new).cast(kind)).otherwise(F.col(chars_col)))
    return out.withColumn(text_col, F.coalesce(new, text_col)).drop(new)
