"""Page metadata by documented precedence, from the same parsed tokens as the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagevault.functions import fixed, jsonld_fields, split_keywords, strip_affixes
from pagevault.functions.core import constant_array, let
from pagevault.functions.text import strip
from pagevault.operators.rows import explode_once


def _attr(t: Column, name: str) -> Column:
    return F.try_element_at(t["attrs"], F.lit(name))


def _starts(tokens: Column, tag: str | None, name: str, value: str) -> Column:
    def test(t: Column) -> Column:
        is_tag = t["kind"] == "start" if tag is None else (t["kind"] == "start") & (t["tag"] == tag)
        return is_tag & (_attr(t, name) == value)

    return F.filter(tokens, test)


def _one(nodes: Column) -> Column:
    return F.try_element_at(nodes, F.lit(1))


def _filled(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


_NAMED_BY = ["property", "name", "itemprop"]


def _meta_index(tokens: Column) -> Column:
    """STRUCT(keys, contents) of all <meta> tags in order, one entry per naming attribute: `property:og:title`."""
    metas = F.filter(tokens, lambda t: (t["kind"] == "start") & (t["tag"] == "meta"))

    def entries(t: Column) -> Column:
        return F.filter(
            F.transform(
                constant_array(_NAMED_BY),
                lambda n: F.struct(
                    F.concat(n, F.lit(":"), F.try_element_at(t["attrs"], n)).alias("key"),
                    _filled(_attr(t, "content")).alias("content"),
                ),
            ),
            lambda e: e["key"].isNotNull(),
        )

    return let(
        F.flatten(F.transform(metas, entries)),
        lambda e: F.struct(e["key"].alias("keys"), e["content"].alias("contents")),
    )


def _meta(index: Column, name: str, value: str) -> Column:
    """Content of the first <meta> with this name, NULL when there is none or it is blank."""
    at = F.array_position(index["keys"], F.lit(f"{name}:{value}")).cast("int")
    return F.try_element_at(index["contents"], F.nullif(at, F.lit(0)))


def _node_text(tokens: Column, node: Column) -> Column:
    def text_of(n: Column) -> Column:
        inner = F.filter(tokens, lambda t: (t["kind"] == "text") & (t["pos"] > n["pos"]) & (t["pos"] < n["end_pos"]))
        return _filled(F.array_join(F.transform(inner, lambda t: strip(t["text"])), ""))

    return let(node, lambda n: F.when(n.isNotNull(), text_of(n)))


_DAY_FORMATS = ("MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy", "yyyyMMdd", "yyyy/MM/dd", "M/d/yyyy")
_TIME_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy/MM/dd HH:mm:ss", "MMMM d, yyyy h:mm a")


def _iso(text: Column) -> Column:
    """A timestamp from an ISO text, else from the other usual forms of pages and feeds (a leading day of the week is
    passed over); other text is NULL, so that the next source is tried."""
    plain = F.regexp_replace(strip(text), r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+", "")
    others = [F.try_to_timestamp(plain, F.lit(f)) for f in (*_DAY_FORMATS, *_TIME_FORMATS)]
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    return F.coalesce(iso, F.when(plain.rlike(r"^(\d{8}$|\d{1,4}[/ ]|[A-Za-z]{3,9}\.? \d)"), F.coalesce(*others)))


def title_of(tokens: Column, index: Column | None = None) -> Column:
    """The shared title, else the text of <title>."""
    node = _one(F.filter(tokens, lambda t: (t["kind"] == "start") & (t["tag"] == "title")))
    plain = _node_text(tokens, node)
    if index is None:
        return let(_meta_index(tokens), lambda i: F.coalesce(_meta(i, "property", "og:title"), plain))
    return F.coalesce(_meta(index, "property", "og:title"), plain)


def _first_filled(names: list[tuple[str, str]], index: Column, ready=lambda c: c) -> Column:
    """First usable content of the named <meta> tags, in order (the names are constants)."""
    keys = constant_array([f"{n}:{v}" for n, v in names])

    def content(key: Column) -> Column:
        at = F.array_position(index["keys"], key).cast("int")
        return ready(F.try_element_at(index["contents"], F.nullif(at, F.lit(0))))

    return _one(F.filter(F.transform(keys, content), lambda c: c.isNotNull()))


def _author(tokens: Column, index: Column, ld: Column) -> Column:
    def item_author(node: Column) -> Column:
        inside = F.filter(tokens, lambda t: t["pos"].between(node["pos"], node["end_pos"]))
        return F.coalesce(_node_text(tokens, _one(_starts(inside, None, "itemprop", "name"))), _node_text(tokens, node))

    def byline(cls: Column) -> Column:
        node = _one(
            F.filter(
                tokens,
                lambda t: (t["kind"] == "start")
                & F.array_contains(F.split(F.coalesce(_attr(t, "class"), F.lit("")), r"\s+"), cls),
            )
        )
        return _filled(strip_affixes(_node_text(tokens, node), prefixes=fixed.BYLINE_PREFIXES))

    bylines = F.transform(constant_array(fixed.BYLINE_CLASSES), byline)
    return F.coalesce(
        _first_filled(fixed.AUTHOR_METAS_FIRST, index),
        let(_one(_starts(tokens, None, "itemprop", "author")), item_author),
        _meta(index, "name", "DC.creator"),
        _filled(_attr(_one(_starts(tokens, "link", "rel", "author")), "title")),
        _node_text(tokens, _one(_starts(tokens, "a", "rel", "author"))),
        F.regexp_replace(_meta(index, "name", "twitter:creator"), "^@", ""),
        _one(F.filter(bylines, lambda b: b.isNotNull())),
        _one(F.filter(F.transform(ld, lambda x: x["author"]), lambda x: x.isNotNull())),
    )


def _keywords(tokens: Column, index: Column, ld: Column) -> Column:
    tags = F.filter(
        F.transform(_starts(tokens, "meta", "property", "article:tag"), lambda t: _filled(_attr(t, "content"))),
        lambda v: v.isNotNull(),
    )
    return F.coalesce(
        split_keywords(_meta(index, "name", "keywords")),
        let(tags, lambda v: F.when(F.size(v) > 0, v)),
        split_keywords(_first_filled([("name", "news_keywords"), ("itemprop", "keywords")], index)),
        _one(F.filter(F.transform(ld, lambda x: x["keywords"]), lambda x: F.size(x) > 0)),
    )


def _published(tokens: Column, index: Column, ld: Column) -> Column:
    times = F.transform(
        F.filter(tokens, lambda t: (t["kind"] == "start") & (t["tag"] == "time")),
        lambda t: _iso(strip(_attr(t, "datetime"))),
    )
    return F.coalesce(
        _first_filled(fixed.DATE_METAS, index, _iso),
        _one(F.filter(times, lambda x: x.isNotNull())),
        _one(F.filter(F.transform(ld, lambda x: x["published_at"]), lambda x: x.isNotNull())),
    )


def page_metadata(parsed: DataFrame, col: str = "tokens") -> DataFrame:
    """Adds title, description, author, og_image, favicon, keywords, published_at.

    Tokens must still hold scripts (JSON-LD), so give the parsed pages, not the stripped ones. Only the few tokens
    that can carry metadata are looked at more than once.
    """
    tokens = F.col(col)
    scripts = F.filter(tokens, lambda t: (t["kind"] == "start") & (t["tag"] == "script") & (_attr(t, "type") == "application/ld+json"))
    texts = F.filter(tokens, lambda t: (t["kind"] == "text") & t["path"].endswith("/script"))
    ld_texts = let(
        texts,
        lambda found: F.filter(
            F.transform(scripts, lambda s: _one(F.filter(found, lambda t: t["pos"] == s["pos"] + 1))["text"]),
            lambda x: x.isNotNull(),
        ),
    )
    rows = parsed.withColumns(
        {"_ld": F.transform(ld_texts, lambda x: jsonld_fields(strip(x))), "_metas": _meta_index(tokens)}
    )
    ld, index = F.col("_ld"), F.col("_metas")
    links = F.filter(tokens, lambda t: (t["kind"] == "start") & (t["tag"] == "link"))

    def icon(found: Column, rel: Column) -> Column:
        def fits(t: Column) -> Column:
            value = F.coalesce(_attr(t, "rel"), F.lit(""))
            return (value == rel) | F.array_contains(F.split(value, r"\s+"), rel)

        return _filled(_attr(_one(F.filter(found, fits)), "href"))

    rels = constant_array(fixed.FAVICON_RELS)
    icons = let(links, lambda found: F.transform(rels, lambda rel: icon(found, rel)))
    return rows.withColumns(
        {
            "title": title_of(tokens, index),
            "description": _first_filled([("property", "og:description"), ("name", "description")], index),
            "author": _author(tokens, index, ld),
            "og_image": _meta(index, "property", "og:image"),
            "favicon": _one(F.filter(icons, lambda x: x.isNotNull())),
            "keywords": _keywords(tokens, index, ld),
            "published_at": _published(tokens, index, ld),
        }
    ).drop("_ld", "_metas")


def meta_rows(parsed: DataFrame, key: str = "page_id", col: str = "tokens") -> DataFrame:
    """Candidate values as rows (key, field, priority, pos, value) for `meta_pick`: titles and descriptions."""
    rules = [
        ("title", 1, "property", "og:title"),
        ("description", 1, "property", "og:description"),
        ("description", 2, "name", "description"),
        ("og_image", 1, "property", "og:image"),
    ]
    def rule_rows(field: str, prio: int, name: str, value: str) -> Column:
        return F.transform(
            _starts(F.col(col), "meta", name, value),
            lambda t: F.struct(
                F.lit(field).alias("field"),
                F.lit(prio).alias("priority"),
                t["pos"].alias("pos"),
                _filled(_attr(t, "content")).alias("value"),
            ),
        )

    metas = F.flatten(F.array(*[rule_rows(*rule) for rule in rules]))
    titles = F.transform(
        F.filter(col, lambda t: (t["kind"] == "text") & t["path"].endswith("/title")),
        lambda t: F.struct(F.lit("title").alias("field"), F.lit(2).alias("priority"), t["pos"].alias("pos"), _filled(t["text"]).alias("value")),
    )
    rows = explode_once(parsed, F.concat(metas, titles), key, item="m").select(key, "m.*")
    return rows.filter("value is not null")


def meta_pick(meta: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page and field the value with the best (lowest) priority and position."""
    return meta.groupBy(key, "field").agg(F.min_by("value", F.struct("priority", "pos")).alias("value"))


def doc_from_page(pages: DataFrame) -> DataFrame:
    """Rows with page columns and metadata to documents: extracted title over tab title, author as contact name,
    publication time as creation time, image, icon and page type in the metadata map."""
    have = set(pages.columns)

    def col(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    extras = F.map_filter(
        F.create_map(F.lit("og_image"), col("og_image"), F.lit("favicon"), col("favicon")), lambda k, v: v.isNotNull()
    )
    visit = [F.col(c).cast("string") for c in ("url", "page_id", "ingested_at") if c in have]
    times = [F.col("ingested_at").cast("timestamp").alias("ingested_at")] if "ingested_at" in have else []
    return pages.select(
        F.sha2(F.concat_ws("|", *visit), 256).alias("id"),
        F.col("page_id"),
        F.col("url"),
        F.coalesce(F.nullif(col("title"), F.lit("")), col("tab_title")).alias("title"),
        col("description").alias("description"),
        col("author").alias("contact_name"),
        F.lit("chrome").alias("source"),
        (F.col("published_at") if "published_at" in have else F.lit(None).cast("timestamp")).alias("created_at"),
        (F.col("keywords") if "keywords" in have else F.lit(None).cast("array<string>")).alias("keywords"),
        *times,
        extras.alias("metadata"),
        col("markdown").alias("text_content"),
    )
