"""Fill-in-the-middle: texts are cut at two code points and rewritten as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

Cuts are given in code points, texts are bytes. A learned rank index answers where the k-th code point begins: error-bounded
straight segments are fitted to the offsets of all boundaries, each lookup predicts the offset from its segment and adds the stored
residual, which makes it exact. A segment whose line misses a boundary by more than ERROR bytes is halved until none does,
so residuals take one byte each; a part of plain ASCII is one segment without any residual. All texts of a part share one index.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagevault.llm import words as W

ERROR = 100  # bytes that a segment may be off, at most 127
PART = 4 << 20
SEED, PLAIN_FROM, SPM_BELOW = "1", 90, 20
MARKS = ("<P>", "<S>", "<M>")


class RankIndex:
    """Byte offset of each code point boundary of UTF-8 `data` (its end included): lines by rank, and residuals of one byte."""

    def __init__(self, data: np.ndarray, error: int = ERROR):
        lines, residuals, rank = [], [], 0
        for at in range(0, max(len(data), 1), W.PIECE):
            part = data[at : at + W.PIECE]
            offsets = at + np.flatnonzero((part & 0xC0) != 0x80)
            if at + W.PIECE >= len(data):
                offsets = np.append(offsets, len(data))
            if len(offsets):
                first, line, residual = _fit(offsets, error)
                lines.append((first + rank, *line))
                residuals.append(residual)
                rank += len(offsets)
        self.rank, self.offset, self.rise, self.run = (np.concatenate(c) for c in zip(*lines, strict=True))
        self.residual = np.concatenate(residuals)

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """Where these boundaries are: predicted by their segments, then corrected."""
        s = np.searchsorted(self.rank, ranks, side="right") - 1
        return self.offset[s] + (ranks - self.rank[s]) * self.rise[s] // self.run[s] + self.residual[ranks]

    def ranks(self, offsets: np.ndarray) -> np.ndarray:
        """The number of boundaries before each offset that is a boundary itself: binary search over predicted places."""
        lo, hi = np.zeros(len(offsets), np.int64), np.full(len(offsets), len(self.residual) - 1)
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            below = self.offsets(mid) < offsets
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
        return lo


def _fit(offsets: np.ndarray, error: int):
    """First rank, (offset, rise, run) of each segment, and the residual of each boundary."""
    n = len(offsets)
    residual = np.zeros(n, np.int8)
    first, last = np.zeros(1, np.int64), np.full(1, n - 1)
    done = []
    while len(first):
        size = last - first + 1
        head = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(first)), size)
        step = np.arange(len(segment)) - head[segment]
        rank = first[segment] + step
        rise, run = offsets[last] - offsets[first], np.maximum(last - first, 1)
        off = offsets[rank] - offsets[first][segment] - step * rise[segment] // run[segment]
        worst = np.maximum.reduceat(np.abs(off), head)
        good = worst <= error
        fine = good[segment]
        residual[rank[fine]] = off[fine]
        done.append((first[good], offsets[first[good]], rise[good], run[good]))
        first, last = first[~good], last[~good]
        middle = (first + last) >> 1
        first, last = np.stack((first, middle + 1), 1).ravel(), np.stack((middle, last), 1).ravel()
    first, *line = (np.concatenate(c) for c in zip(*done, strict=True))
    order = np.argsort(first)
    return first[order], [c[order] for c in line], residual


def _rewritten(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offs = W.utf8(batch["_text"])
    index = RankIndex(data)
    begin = index.ranks(offs)
    n = np.diff(begin)
    h = [batch[f"_h{i}"].to_numpy(zero_copy_only=False).astype(np.int64) for i in range(1, 5)]
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    low, high = np.minimum(a, b), np.maximum(a, b)
    cuts = np.stack((offs[:-1], index.offsets(begin[:-1] + low), index.offsets(begin[:-1] + high)), 1)
    edges = np.append(cuts.ravel(), offs[-1]).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(3 * len(n), pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data)))
    prefix, middle, suffix = (pieces.take(pa.array(np.arange(i, 3 * len(n), 3))) for i in range(3))
    text = pc.fill_null(batch["_text"].cast(pa.large_string()), "")
    marked = np.zeros(len(n), bool)
    for m in MARKS:
        marked |= pc.match_substring(text, m).to_numpy(zero_copy_only=False)
    plain = (n == 0) | marked | (h[2] % 100 >= PLAIN_FROM)
    spm = h[3] % 100 < SPM_BELOW
    p, s, m = (pa.scalar(x, pa.large_string()) for x in MARKS)
    none = pa.scalar("", pa.large_string())
    psm_text = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none)
    spm_text = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none)
    output = pc.if_else(pa.array(plain), text, pc.if_else(pa.array(spm), spm_text, psm_text))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    cols = [batch["_uid"], pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string())]
    cols += [pa.array(c, pa.int64(), mask=plain) for c in (low, high - low)]
    return pa.RecordBatch.from_arrays([*cols, output.cast(pa.string())], ["_uid", "n", "form", "prefix_chars", "middle_chars", "output"])


def _run(batches):
    for whole in batches:
        for batch in W.slices(whole, "_text", PART):
            yield _rewritten(batch)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """The id, n (code points), form, prefix_chars, middle_chars and output of each row, in one scan.

    Cuts and form follow from the SHA-256 of `seed`, a colon and the id. Null texts count as empty, null ids as ''; ids may be repeated,
    and equal rows give equal results. Texts that are empty or contain one of MARKS stay plain, with null cuts. An empty table gives no rows.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    parts = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).alias("_uid"), F.col(text_col).alias("_text"), *parts)
    kind = dict(docs.dtypes)[id_col]
    out = rows.mapInArrow(_run, f"_uid {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("_uid", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that fill_in_middle rewrote: marks occur in it at the seams only, so they cut it into its three pieces."""
    pieces = F.split(output, "|".join(MARKS))
    psm, spm = (F.concat(*(F.get(pieces, i) for i in order)) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = f"""
WITH digests AS (SELECT doc_id, COALESCE(text, '') AS t, sha256('{SEED}:' || COALESCE(doc_id::VARCHAR, '')) AS d FROM documents),
numbers AS (SELECT doc_id, t, length(t)::BIGINT AS n, {", ".join(f"('0x' || substr(d, {8 * i + 1}, 8))::BIGINT AS h{i + 1}" for i in range(4))} FROM digests),
cuts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {PLAIN_FROM} THEN 'plain'
      WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers),
pieces AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""
