"""Ordered work on element tables: runs, posts, sections, look-ahead; and duplicates within a document.

Element tables hold one row per element: a key (document), an order column, a kind and a text. No operator here
assumes that a document fits a task; see `ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagevault.functions import (
    caption_clean,
    extract_hashtags,
    is_month_day,
    is_relative_time,
    month_day_clean,
    normalize_text,
)
from pagevault.functions.classify import contact_tests, funding_tests
from pagevault.functions.text import has_text, strip
from pagevault.functions.urls import url_host, url_path
from pagevault.operators.rows import explode_once, first_of
from pagevault.operators.ordered import ExitTable, arrange, fill_forward, greedy_scan, running_sum, shift


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def ordered_text(order: Sequence[str], text: Column, sep: str) -> Column:
    """Aggregate: texts joined in order; NULLs are left out."""
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct(*order, text.alias("_t")))))
    return F.array_join(F.transform(rows, lambda r: r["_t"]), sep)


def merge_text_runs(
    elements: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    kind: str,
    text: str,
    text_kinds: Sequence[str] = ("text",),
    sliced: bool = False,
) -> DataFrame:
    """Runs of text elements become one element (texts joined by a blank); other elements stay as they are.

    Output: key, first order value, kind, text. Blank texts vanish.
    """
    key = _cols(key)
    is_text = F.col(kind).isin(*text_kinds)
    rows = elements.filter(~is_text | has_text(F.col(text)))
    a = running_sum(arrange(rows, key, order, sliced), _breaks=F.when(is_text, 0).otherwise(1).cast("long"))
    # a run is (text, number of non-text elements before); a non-text element is its own run
    runs = a.result().groupBy(*key, "_breaks", is_text.alias("_is_text"))
    return runs.agg(
        F.min(F.struct(*order)).alias("_at"),
        F.min_by(kind, F.struct(*order)).alias(kind),
        ordered_text(order, F.when(is_text, strip(F.col(text))).otherwise(F.col(text)), " ").alias(text),
    ).select(*key, *[F.col("_at")[o].alias(o) for o in order], kind, text)


def segment_posts(
    elements: DataFrame,
    key: str | Sequence[str],
    order: Sequence[str],
    boundary: Column,
    sliced: bool = False,
) -> DataFrame:
    """Adds `post_index` (from 1): the number of boundary elements so far. Elements before the first are dropped."""
    a = running_sum(
        arrange(elements, _cols(key), order, sliced),
        post_index=F.when(F.coalesce(boundary, F.lit(False)), 1).otherwise(0).cast("long"),
    )
    return a.result().filter("post_index > 0")


def segment_avatar_posts(
    elements: DataFrame, key: str, order: Sequence[str], kind: str = "kind", text: str = "text",
    sliced: bool = False,
) -> DataFrame:
    """Posts that start at a profile picture followed by a plausible user name (2-34 characters, not a time)."""
    a = shift(
        arrange(elements, _cols(key), order, sliced), _next=(F.col(text), -1), _next_kind=(F.col(kind), -1)
    )
    name = strip(F.col("_next"))
    picture = (F.col(kind) == "image") & (
        F.contains(F.lower(text), F.lit("profile picture")) | F.contains(F.col(text), F.lit("User avatar"))
    )
    start = picture & (F.col("_next_kind") == "text") & F.length(name).between(2, 34) & ~is_relative_time(name)
    marked = running_sum(a, post_index=F.when(F.coalesce(start, F.lit(False)), 1).otherwise(0).cast("long"))
    return marked.result().drop("_next", "_next_kind").filter("post_index > 0")


def segment_by_image(
    elements: DataFrame,
    key: str | Sequence[str] = "doc",
    order: Sequence[str] = ("pos",),
    sliced: bool = False,
) -> DataFrame:
    """Feed elements (kind, text, image_url) to posts: a new post at the first sight of each image URL.

    One row per post: image_url, captions joined by newlines, count, user and hashtags. The first sight of a URL
    is a minimum per (document, URL), partially aggregated, so a picture repeated millions of times does not hurt.
    """
    key = _cols(key)
    order = list(order)
    at = F.struct(*order)
    firsts = (
        elements.filter((F.col("kind") == "image") & (F.col("image_url") != ""))
        .groupBy(*key, "image_url")
        .agg(F.min(at).alias("_first"))
        .select(*[F.col(k) for k in key], *[F.col("_first")[o].alias(o) for o in order], F.lit(1).alias("_new"))
    )
    flagged = elements.join(firsts, [*key, *order], "left")
    a = running_sum(
        arrange(flagged, key, order, sliced), post_index=F.coalesce(F.col("_new"), F.lit(0)).cast("long")
    )
    kind, text = F.col("kind"), strip(F.col("text"))
    short = (kind == "list_item") | ((kind == "text") & (F.length(text) < 20))
    count = F.when(short & text.rlike(r"^[\d,]+\.?\d*[KM]?$"), text)
    user = F.when(
        short & count.isNull() & (text.startswith("@") | F.contains(F.lower(text), F.lit("profile"))), text
    )
    ui_words = ["posts", "reels", "explore", "saved", "search", "primary", "general", "requests"]
    body = F.when((kind == "image"), caption_clean(text)).when(
        ~short & (F.length(text) > 3) & ~F.lower(text).isin(*ui_words),
        caption_clean(strip(F.replace(text, F.lit("·"), F.lit("")))),
    )
    rows = a.result().select(
        *key, *order, "post_index", body.alias("_body"), count.alias("_count"), user.alias("_user"),
        F.when(F.col("_new") == 1, F.col("image_url")).alias("_image"),
    )
    # a caption counts once per post, at its first place; counts and users go along, so that the posts are made in one pass
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c)
    once = rows.groupBy(*key, "post_index", "_body").agg(F.min(at).alias("_at"), F.max("_image").alias("_image"), last("_count"), last("_user"))
    captions = F.array_sort(F.collect_list(F.when(F.col("_body").isNotNull(), F.struct("_at", "_body"))))
    posts = once.groupBy(*key, "post_index").agg(
        F.max("_image").alias("image_url"),
        F.max("_count")["value"].alias("count"),
        F.max("_user")["value"].alias("user"),
        F.when(F.count("_body") > 0, F.array_join(F.transform(captions, lambda r: r["_body"]), "\n")).alias("text"),
    )
    tags = F.array_sort(F.array_distinct(extract_hashtags(F.coalesce("text", F.lit("")))))
    return posts.withColumn("hashtags", tags).filter(F.col("text").isNotNull() | F.col("image_url").isNotNull())


def section_by_title(
    elements: DataFrame,
    title: str,
    max_title_len: int = 30,
    key: str | Sequence[str] = "doc",
    order: Sequence[str] = ("pos",),
    kind: str = "kind",
    text: str = "text",
    title_kind: str = "title",
    sliced: bool = False,
) -> DataFrame:
    """Elements after the first title that contains a text, up to the next short title.

    Titles that contain the text again keep the section open and are not part of it.
    """
    shown = strip(F.col(text))
    is_title = F.col(kind) == title_kind
    opens = is_title & F.contains(F.lower(shown), F.lit(title.lower()))
    a = arrange(elements, _cols(key), order, sliced)
    a = running_sum(a, _opened=F.when(opens, 1).otherwise(0).cast("long"))
    stops = is_title & ~opens & (F.length(shown) < max_title_len) & (F.col("_opened") > 0)
    a = running_sum(a, _stopped=F.when(stops, 1).otherwise(0).cast("long"))
    return (
        a.having(a.df.filter((F.col("_opened") > 0) & (F.col("_stopped") == 0) & ~opens))
        .result()
        .drop("_opened", "_stopped")
    )


def title_sections(
    elements: DataFrame, key: str | Sequence[str], order: Sequence[str], kind: str, text: str,
    title_kind: str = "title", sliced: bool = False,
) -> DataFrame:
    """Adds `section_id` (titles so far) and `section_title` (the last title, NULL before the first)."""
    is_title = F.col(kind) == title_kind
    a = arrange(elements, _cols(key), order, sliced)
    a = running_sum(a, section_id=F.when(is_title, 1).otherwise(0).cast("long"))
    return fill_forward(a, section_title=F.when(is_title, F.col(text))).result()


def first_seen_dedup(df: DataFrame, key: str | Sequence[str], order: Sequence[str], text: str) -> DataFrame:
    """The first row of each text in its document; of equal ones one row per task goes through the shuffle."""
    return first_of(df, [*_cols(key), text], list(order))


def prefix_dedup_lines(
    lines: DataFrame, prefix: int = 40, min_len: int = 100, key: str = "doc_id", pos: str = "pos", text: str = "line"
) -> DataFrame:
    """Of the lines of a document that share their first characters keep the longest, at the place of the first.

    Documents under `min_len` characters (newlines counted) stay whole. On equal length the earlier line stays.
    """
    in_doc, alike = Window.partitionBy(key), Window.partitionBy(key, F.substring(text, 1, prefix))
    chars = F.sum(F.length(text)).over(in_doc) + F.count(F.lit(1)).over(in_doc) - 1
    sized = lines.select(key, pos, text, chars.alias("_chars"))
    rank = F.row_number().over(alike.orderBy(F.desc(F.length(text)), pos))
    ranked = sized.select(key, pos, text, "_chars", rank.alias("_rank"), F.min(pos).over(alike).alias("_first"))
    short = F.col("_chars") < min_len
    kept = ranked.filter(short | (F.col("_rank") == 1))
    return kept.select(key, F.when(short, F.col(pos)).otherwise(F.col("_first")).alias(pos), text)


_GRAM = 8


def inside_others(lines: list[str]) -> list[bool]:
    """For lines without newlines: is this one a repetition of an earlier one, or part of another?

    The distinct lines are joined by newlines; a line is part of another if it occurs at a second place. Places are looked up by the
    rarest eight bytes of the line, compared as one number at every place of the joined text, so the work grows with
    the text and not with the number of lines. Lines under eight bytes are searched for directly.
    """
    first: dict[bytes, int] = {}
    for i, line in enumerate(lines):
        first.setdefault(line.encode(), i)
    texts = list(first)
    whole = b"\n".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])) if texts else sizes
    inside = [False] * len(texts)
    long = np.flatnonzero(sizes >= _GRAM)
    if len(long):
        grams = np.lib.stride_tricks.sliding_window_view(np.frombuffer(whole, np.uint8), _GRAM)
        grams = np.ascontiguousarray(grams).view(np.uint64).ravel()
        order = np.argsort(grams, kind="stable")
        new = np.concatenate(([True], grams[order][1:] != grams[order][:-1]))
        cut = np.flatnonzero(new)
        count = np.empty(len(grams), np.int64)
        rank = np.empty(len(grams), np.int64)
        group = np.cumsum(new) - 1
        count[order] = np.diff(np.append(cut, len(grams)))[group]
        rank[order] = group
        for k in long.tolist():
            a, n = int(begin[k]), int(sizes[k])
            at = int(count[a : a + n - _GRAM + 1].argmin())
            g = rank[a + at]
            places = order[cut[g] : cut[g] + count[a + at]] - at
            inside[k] = any(p != a and p >= 0 and whole[p : p + n] == texts[k] for p in places.tolist())
    for k in np.flatnonzero(sizes < _GRAM).tolist():
        p = whole.find(texts[k])
        inside[k] = p != begin[k] or whole.find(texts[k], p + 1) >= 0
    number = {t: k for k, t in enumerate(texts)}
    return [first[t] != i or inside[number[t]] for i, t in enumerate(line.encode() for line in lines)]


def _inside_all(rows: pd.Series) -> pd.Series:
    return pd.Series([inside_others(list(r)) if r is not None else None for r in rows])


_inside_udf = F.pandas_udf(_inside_all, T.ArrayType(T.BooleanType()))


def containment_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", sep: str = "\n") -> DataFrame:
    """Lines of each document that are not blank, not repeated and not part of a longer line.

    Compared after white space is normalised; the first of equal lines stays, in its original form. A kept line is
    never inside another and being inside is transitive, so "inside a kept line" is "inside any other line". Each
    document is settled inside its own row (see `inside_others`). No lines are paired and nothing is shuffled.
    """
    lines = F.split(F.col(text), sep)
    clean = F.filter(
        F.transform(lines, lambda x, i: F.struct(i.alias("pos"), x.alias("line"), normalize_text(x).alias("norm"))),
        lambda x: x["norm"] != "",
    )

    def kept_of(found: Column) -> Column:
        both = F.transform(found, lambda x, i: F.struct(x.alias("_clean"), F.get("_inside", i).alias("inside")))
        return F.filter(both, lambda z: ~z["inside"])

    cleaned = docs.select(key, clean.alias("_clean")).withColumn("_inside", _inside_udf(F.col("_clean")["norm"]))
    rows = explode_once(cleaned, kept_of(F.col("_clean")), key, item="_l")
    return rows.select(key, F.col("_l")["_clean"]["pos"].alias("pos"), F.col("_l")["_clean"]["line"].alias("line"))


def image_dedup(links: DataFrame, key: str = "doc_id", pos: str = "pos", url: str = "url") -> DataFrame:
    """The first image of each resource (host and path) in its document."""
    return first_of(links, [F.col(key), url_host(F.col(url)), url_path(F.col(url))], [F.col(pos)])


def _profile_step(skip: int | None, rows: dict[str, np.ndarray]) -> tuple[np.ndarray, int]:
    """0 = not a start, 1 = name and handle, 2 = name, handle and biography; the state is how many rows to skip."""
    pair, bio = rows["_pair"], rows["_bio"]
    flags = np.zeros(len(pair), dtype=np.int32)
    i = skip or 0
    while i < len(pair):
        if pair[i]:
            flags[i] = 2 if bio[i] else 1
            i += 3 if bio[i] else 2
        else:
            i += 1
    return flags, i - len(pair)


class _ProfileExits(ExitTable):
    """A slice is entered with 0, 1 or 2 rows to skip."""

    def __init__(self):
        self.states: list[int] = [0, 1, 2]

    def feed(self, rows: dict[str, np.ndarray]) -> None:
        self.states = [_profile_step(s, rows)[1] for s in self.states]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array([1, 2]), np.array(self.states)


def name_handle_bio(
    elements: DataFrame,
    key: str | Sequence[str] = "doc",
    order: Sequence[str] = ("pos",),
    text: str = "text",
    sliced: bool = False,
) -> DataFrame:
    """Profiles from sequences of name, handle and perhaps biography, matched from the start without overlap."""
    key = _cols(key)
    e = strip(F.col(text))
    a = shift(arrange(elements, key, order, sliced), _t1=(e, -1), _t2=(e, -2), _t3=(e, -3))
    h, b = F.col("_t1"), F.col("_t2")
    is_handle = F.contains(h, F.lit("@")) | h.endswith(".bsky.social") | h.endswith(".com")
    next_pair = F.coalesce(F.contains(F.col("_t3"), F.lit("@")), F.lit(False))
    is_bio = (F.length(b) > 10) & ~b.startswith("@") & ~F.contains(b, F.lit("‪@")) & ~next_pair
    a = a.having(
        a.df.withColumns(
            {"_pair": F.coalesce(is_handle, F.lit(False)), "_bio": F.coalesce(is_bio, F.lit(False))}
        )
    )
    a = greedy_scan(a, "_hit", "int", ["_pair", "_bio"], _profile_step, _ProfileExits)
    marks = strip(F.regexp_replace(h, "[‪‬]", ""))
    handle = F.when(~marks.startswith("@") & F.contains(marks, F.lit(".")), F.concat(F.lit("@"), marks)).otherwise(marks)
    return (
        a.result()
        .filter("_hit > 0")
        .select(*key, *order, e.alias("name"), handle.alias("handle"), F.when(F.col("_hit") == 2, b).alias("bio"))
    )


def nearby_date(
    elements: DataFrame,
    key: str | Sequence[str] = "doc",
    order: Sequence[str] = ("pos",),
    text: str = "text",
    sliced: bool = False,
) -> DataFrame:
    """Adds `nearby_date`: the first month-day text among the next two elements, else among the two before."""
    e = strip(F.col(text))
    a = shift(
        arrange(elements, _cols(key), order, sliced),
        _n1=(e, -1), _n2=(e, -2), _p2=(e, 2), _p1=(e, 1),
    )
    found = [F.when(is_month_day(F.col(c)), month_day_clean(F.col(c))) for c in ("_n1", "_n2", "_p2", "_p1")]
    return a.result().withColumn("nearby_date", F.coalesce(*found)).drop("_n1", "_n2", "_p2", "_p1")


def post_hashtags(df: DataFrame, key: str, text: str) -> DataFrame:
    """Distinct sorted hashtags of each post."""
    tags = F.array_sort(F.array_distinct(extract_hashtags(F.col(text))))
    return df.select(key, tags.alias("hashtags"))


def _fields_by_rule(lines: DataFrame, tests: dict[str, Column], key: str, pos: str, text: str) -> DataFrame:
    """One column per field: each line serves the first field that it fits and that is still free, in line order.

    Lines that fit the same set of fields are interchangeable but for their order, and at most as many of them as
    there are fields can be used. So the few earliest lines of each set are enough (a rank filter, which Spark
    applies before its shuffle as well), and the sequential rule is settled on those.
    """
    mask = F.lit(0)
    for i, test in enumerate(tests.values()):
        mask = mask + F.when(test, 1 << i).otherwise(0)
    n = len(tests)
    hits = lines.withColumn("_mask", mask).filter("_mask > 0").select(key, "_mask", pos, strip(F.col(text)).alias("_t"))
    w = Window.partitionBy(key, "_mask").orderBy(pos)
    few = hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    ordered = few.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_mask").alias("m"), F.col("_t").alias("t")))).alias("_ls")
    )
    blank = F.struct(*[F.lit(None).cast("string").alias(f) for f in tests])

    def settle(acc: Column, line: Column) -> Column:
        out, taken = [], F.lit(False)
        for i, f in enumerate(tests):
            fits = (F.shiftright(line["m"], i).bitwiseAND(F.lit(1)) == 1) & acc[f].isNull() & ~taken
            out.append(F.when(fits, line["t"]).otherwise(acc[f]).alias(f))
            taken = taken | fits
        return F.struct(*out)

    return ordered.select(key, F.aggregate("_ls", blank, settle).alias("_f")).select(key, "_f.*")


def contact_fields(lines: DataFrame, key: str = "doc_id", pos: str = "pos", text: str = "line") -> DataFrame:
    """website, phone, email and address of each document that has any."""
    return _fields_by_rule(lines, contact_tests(strip(F.col(text))), key, pos, text)


def funding_fields(lines: DataFrame, key: str = "doc_id", pos: str = "pos", text: str = "line") -> DataFrame:
    """stage, amount and investors of each document that has any."""
    return _fields_by_rule(lines, funding_tests(strip(F.col(text))), key, pos, text)
