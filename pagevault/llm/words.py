"""Words of many texts at once: spans and 64-bit hashes as numpy arrays, straight from Arrow buffers.

Texts are UTF-8. All separators are ASCII, so a word is a run of bytes and no byte has to be decoded. Arithmetic is
modulo 2**64. Work goes through the bytes in pieces of about a megabyte, so scratch arrays stay small for any text.
"""

from __future__ import annotations

import ctypes
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_M = 1 << 64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WINDOW_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

ALNUM = np.zeros(256, bool)  # digits, letters in either case, and everything outside ASCII
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def worker_store(name: str) -> dict:
    """A dict that lives as long as the Python worker. Functions travel by value, so a module's globals are new in every task."""
    return sys.modules.setdefault("_worker_store", types.ModuleType("_worker_store")).__dict__.setdefault(name, {})


def tidy(run):
    """`run` over the batches of a task; at its end, memory that the worker no longer uses goes back to the system.

    Workers wait for further tasks, also of other steps. One that kept what its allocators hold would count beside those that work.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
            if trim:
                trim(0)

    return task


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each maximal run of `inside` bytes within one text, and the number of its text."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = inside[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    cut = offs[1:-1]
    begin = cut[cut < n]
    first[begin] = w[begin]
    end = cut[cut > 0] - 1
    last[end] = w[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every input bit over the output."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of an odd base and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, _M)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            m = max(n, PIECE + 1)
            self.up, self.down = (
                np.cumprod(np.concatenate(([np.uint64(1)], np.full(m - 1, b, np.uint64)))) for b in (self.base, self.inverse)
            )
        return self.up, self.down


_powers: dict[int, _Powers] = {}


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: equal words have equal hashes, in any text and batch."""
    out = np.empty(len(starts), np.uint64)
    powers = _powers.setdefault(seed, _Powers(_BASES[seed]))
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, side="right")))
        s, e = starts[i:j] - starts[i], ends[i:j] - starts[i]
        n = int(e[-1])
        up, down = powers.get(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data[starts[i] : starts[i] + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
        out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
        i = j
    return out


def window_hashes(words: np.ndarray, at: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the `width` word hashes that begin at each position of `at`."""
    base = np.uint64(_WINDOW_BASES[seed])
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = h * base + words[at + k]
    return mix(h)


def within(doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words sorted by text: words per text, first word of each text, and each word's place in its text."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate(([0], np.cumsum(count)[:-1])) if n_docs else np.zeros(0, np.int64)
    return count, first, np.arange(len(doc)) - first[doc]


def slices(batch: pa.RecordBatch, column: str, limit: int):
    """The batch in row ranges of about `limit` bytes of `column` (at least one row each)."""
    i = batch.schema.get_field_index(column)
    offs = utf8(batch.column(i))[1]
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def pack(bucket: np.ndarray, **columns: np.ndarray) -> dict[str, pa.Array]:
    """One row per bucket number: the values of each column in that bucket as raw bytes, in their given order."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1]))) if len(b) else np.zeros(0, np.int64)
    out = {"bucket": pa.array(b[cut].astype(np.int64))}
    for name, values in columns.items():
        values = np.ascontiguousarray(values[order])
        offs = np.concatenate((cut, [len(b)])) * values.itemsize
        arrow = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(values)])
        out[name] = arrow.cast(pa.binary())
    return out


def unpack(column, dtype) -> np.ndarray:
    """All values of a column of pack(), row after row."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)
