"""From text to chunks: blocks, kinds, sections, size-bounded packing, interleaved items.

A document is one row and stays one row until its chunks are exploded: nothing in this module shuffles unless an
operator is given a table of parts that may be spread (`number_chunks`, `chunk_totals`, `reconstruct_text`).
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagevault.functions import fixed, resolve_image_path
from pagevault.functions.core import let
from pagevault.functions.jsoncols import ITEMS_TYPE, item, text_items
from pagevault.functions.text import has_text, strip, strip_part
from pagevault.operators.ordered import arrange, group_total, number_rows, running_sum
from pagevault.operators.rows import explode_once, portions

BLANK_LINES = r"\n\n+"
IMAGE = r"!\[([^\]]*)\]\(\s*([^)\s]*)[^)]*\)"
BLOCK_TYPE = "struct<pos:int,kind:string,text:string>"


def _kind_of(t: Column) -> Column:
    """Kind of a stripped block. A look at its first characters spares most blocks the patterns."""
    return (
        F.when(t.startswith("#") & t.rlike(r"^#{1,6}\s+\S"), F.lit("title"))
        .when(F.left(t, F.lit(1)).rlike(r"[-*+0-9]") & t.rlike(r"^([-*+]|\d+[.)])\s+\S"), F.lit("list_item"))
        .when(t.startswith("![") & t.rlike(rf"^{IMAGE}$"), F.lit("image"))
        .when(t.startswith("```") | t.startswith("~~~"), F.lit("code"))
        .otherwise(F.lit("text"))
    )


def block_kind(text: Column) -> Column:
    """title, list_item, image, code or text."""
    return let(strip(text), _kind_of)


def block_array(text: Column, sep: str = BLANK_LINES) -> Column:
    """ARRAY<STRUCT(pos, original, stripped)> of the non-blank blocks, pos from 0 without holes."""
    parts = F.filter(F.split(strip(text), sep), has_text)
    return F.transform(parts, lambda b, i: F.struct(i.alias("pos"), b.alias("original"), strip_part(b).alias("stripped")))


def md_blocks(df: DataFrame, text: str, sep: str = BLANK_LINES) -> DataFrame:
    """One row per non-blank block: pos, original, stripped (the text column goes)."""
    others = [c for c in df.columns if c != text]
    return explode_once(df, block_array(F.col(text), sep), *others, item="_b").select(*others, "_b.*")


def section_ids(
    blocks: DataFrame, key: str = "doc_id", order: Sequence[str] = ("pos",), kind: str = "kind",
    sliced: bool = False,
) -> DataFrame:
    """Adds `section_id`: the number of titles so far."""
    a = arrange(blocks, [key], order, sliced)
    return running_sum(a, section_id=F.when(F.col(kind) == "title", 1).otherwise(0).cast("long")).result()


def _pieces(text: Column, hard: int) -> Column:
    """Parts of at most `hard` characters, cut at white space; runs without any are cut at the limit."""
    pattern = rf"\S(?:[\s\S]{{0,{hard - 2}}}\S)?(?=\s|$)|\S{{{hard}}}"
    return F.when(F.length(text) <= hard, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def typed_blocks(text: Column, sep: str, hard: int) -> Column:
    """ARRAY<STRUCT(kind, text)>: images set apart, over-long blocks cut to pieces."""

    def parts(block: Column) -> Column:
        at_images = F.split(block, r"(?=!\[[^\]]*\]\()")
        cut = F.flatten(
            F.transform(
                at_images,
                lambda p: F.when(
                    p.rlike(rf"^{IMAGE}"),
                    F.array(F.regexp_extract(p, rf"^{IMAGE}", 0), strip(F.regexp_replace(p, rf"^{IMAGE}", ""))),
                ).otherwise(F.array(strip(p))),
            )
        )
        return F.filter(cut, lambda p: p != "")

    def pieces(part: Column, kind: Column) -> Column:
        is_image = part.startswith("![") & part.rlike(rf"^{IMAGE}$")
        return F.when(is_image, F.array(F.struct(F.lit("image").alias("kind"), part.alias("text")))).otherwise(
            F.transform(_pieces(part, hard), lambda q: F.struct(kind.alias("kind"), q.alias("text")))
        )

    def typed(block: Column, kind: Column) -> Column:
        rest = F.when(kind == "image", F.lit("text")).otherwise(kind)
        with_images = F.contains(block, F.lit("![")) & (kind != "code")
        return F.when(with_images, F.flatten(F.transform(parts(block), lambda p: pieces(p, rest)))).otherwise(
            pieces(block, rest)
        )

    def typed_once(raw: Column) -> Column:
        return let(strip_part(raw), lambda block: let(_kind_of(block), lambda kind: typed(block, kind)))

    found = F.filter(F.split(strip(text), sep), has_text)
    return F.flatten(F.transform(found, typed_once))


def _bounds(blocks: list[tuple[int, bool]], hard: int, soft: int, combine: int) -> list[tuple[int, int]]:
    """(first, number) of the blocks of each chunk, from the blocks' lengths and whether they are titles.

    First within sections: a title starts a new group, as does a block that would pass the hard limit or comes
    after the soft one. Then neighbours: a group under the combine limit takes in the next one if both fit.
    Lengths count the blank line between blocks.
    """
    groups: list[list[int]] = []  # first block, number of blocks, length
    for i, (n, title) in enumerate(blocks):
        if groups and not title and groups[-1][2] <= soft and groups[-1][2] + 2 + n <= hard:
            groups[-1][1] += 1
            groups[-1][2] += 2 + n
        else:
            groups.append([i, 1, n])
    out: list[list[int]] = []
    for first, number, n in groups:
        if out and out[-1][2] < combine and out[-1][2] + 2 + n <= hard:
            out[-1][1] += number
            out[-1][2] += 2 + n
        else:
            out.append([first, number, n])
    return [(first, number) for first, number, _ in out]


PACK_BLOCKS = 1 << 15  # blocks that a worker holds as Python objects at a time, at least one text's


def _bounds_of(column: pa.Array, hard: int, soft: int, combine: int) -> pa.Array:
    flat = column.flatten()
    lengths, titles = (flat.field(k).to_pylist() for k in range(2))
    every, offsets = list(zip(lengths, titles, strict=True)), (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    found = [_bounds(every[a:b], hard, soft, combine) for a, b in zip(offsets, offsets[1:])]
    ends = pa.array([0, *itertools.accumulate(map(len, found))], pa.int32())
    pairs = [p for some in found for p in some]
    values = pa.StructArray.from_arrays([pa.array([p[k] for p in pairs], pa.int32()) for k in range(2)], ["first", "number"])
    return pa.ListArray.from_arrays(ends, values)


def _pack(blocks: Column, hard: int, soft: int, combine: int) -> Column:
    """Greedy packing of ARRAY<STRUCT(kind, text)> to ARRAY<ARRAY<STRUCT>>: only lengths leave the row, boundaries come back, and each chunk
    is cut out of the array once, so the work is linear in the blocks."""

    def run(column: pa.Array) -> pa.Array:
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        parts = [_bounds_of(column.slice(a, b - a), hard, soft, combine) for a, b in portions(sizes, PACK_BLOCKS)]
        return pa.concat_arrays(parts) if parts else _bounds_of(column, hard, soft, combine)

    sizes = F.transform(blocks, lambda b: F.struct(F.length(b["text"]).alias("n"), (b["kind"] == "title").alias("title")))
    sizes = F.coalesce(sizes, F.array().cast("array<struct<n:int,title:boolean>>"))
    bounds = F.arrow_udf(run, "array<struct<first:int,number:int>>")(sizes)
    return F.transform(bounds, lambda g: F.slice(blocks, g["first"] + 1, g["number"]))


def _combine_limit(hard: int, combine: int | None) -> int:
    return min(hard, fixed.CHUNK_COMBINE if combine is None else combine)


def pack_chunks(
    blocks: DataFrame, col: str = "blocks", hard: int = fixed.CHUNK_HARD, soft: int = fixed.CHUNK_SOFT,
    combine: int | None = None,
) -> DataFrame:
    """Rows with an array of (kind, text) blocks get `chunks`: the array of packed block lists."""
    return blocks.withColumn("chunks", _pack(F.col(col), hard, min(soft, hard), _combine_limit(hard, combine)))


def items_of_blocks(blocks: Column, base_path: str | None = None) -> Column:
    """ARRAY of content items of one chunk: runs of text joined by blank lines, images in their place."""
    start = F.struct(F.array().cast(ITEMS_TYPE).alias("done"), F.lit("").alias("cur"))

    def flush(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.concat(acc["done"], F.array(item("text", acc["cur"])))).otherwise(acc["done"])

    def step(acc: Column, b: Column) -> Column:
        url = resolve_image_path(F.regexp_extract(b["text"], IMAGE, 2), F.lit(base_path).cast("string"))
        image = b["kind"] == "image"
        return F.struct(
            F.when(image, F.concat(flush(acc), F.array(item("image_url", url)))).otherwise(acc["done"]).alias("done"),
            F.when(image, F.lit(""))
            .when(acc["cur"] == "", b["text"])
            .otherwise(F.concat(acc["cur"], F.lit("\n\n"), b["text"]))
            .alias("cur"),
        )

    only_text = F.array(item("text", F.array_join(F.transform(blocks, lambda b: b["text"]), "\n\n")))
    has_image = F.exists(blocks, lambda b: b["kind"] == "image")
    return F.when(has_image, F.aggregate(blocks, start, step, flush)).otherwise(only_text)


def chunk_items(df: DataFrame, col: str = "blocks", base_path: str | None = None) -> DataFrame:
    """Rows with the blocks of one chunk get `content`."""
    return df.withColumn("content", items_of_blocks(F.col(col), base_path))


def chunk_id(doc_id: Column, index: Column) -> Column:
    """An id that every run gives again."""
    return F.sha2(F.concat_ws("|", doc_id.cast("string"), index.cast("string")), 256)


def chunk_docs(
    docs: DataFrame,
    sep: str = BLANK_LINES,
    hard: int = fixed.CHUNK_HARD,
    soft: int = fixed.CHUNK_SOFT,
    combine: int | None = None,
    id_col: str = "doc_id",
    text: str = "text",
    base_path: str | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Documents to chunks: id, doc_id, chunk_index, chunk_total, content, and the columns to keep. Blank texts give none. No shuffle."""
    packed = pack_chunks(
        docs.select(F.col(id_col).alias("doc_id"), *keep, typed_blocks(F.col(text), sep, hard).alias("blocks")),
        hard=hard, soft=soft, combine=combine,
    )
    rows = explode_once(
        packed, "chunks", "doc_id", *keep, F.size("chunks").alias("chunk_total"), pos="chunk_index", item="_blocks"
    )
    return rows.select(
        chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("id"),
        "doc_id",
        "chunk_index",
        "chunk_total",
        items_of_blocks(F.col("_blocks"), base_path).alias("content"),
        *keep,
    )


def number_chunks(df: DataFrame, key: str, order: Sequence[str], sliced: bool = False) -> DataFrame:
    """Adds chunk_index (from 0) and chunk_total to parts of documents that come as rows."""
    a = number_rows(arrange(df, [key], order, sliced), "_n")
    a = group_total(a, chunk_total=F.count(F.lit(1)))
    return a.result().withColumn("chunk_index", F.col("_n") - 1).drop("_n")


def chunk_totals(df: DataFrame, key: str) -> DataFrame:
    """Adds the number of rows of each document to each of its rows: partial counts joined back, so that a document
    with very many rows is never gathered (AQE splits its join partition)."""
    totals = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("chunk_total"))
    return df.join(totals, df[key].eqNullSafe(totals["_key"])).drop("_key")


def chunks_in_order(chunks: DataFrame, doc_id) -> DataFrame:
    return chunks.filter(F.col("doc_id") == F.lit(doc_id)).orderBy("chunk_index")


def reconstruct_text(chunks: DataFrame) -> DataFrame:
    """The text of each document again: its text items in order, joined by blank lines; images are left out."""
    text = F.array_join(F.transform(text_items(F.col("content")), lambda x: x["text"]), "\n\n")
    rows = chunks.select("doc_id", "chunk_index", F.nullif(text, F.lit("")).alias("_t")).filter("_t is not null")
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "_t")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["_t"]), "\n\n").alias("text"))
