"""Columns that read and write short Markdown texts: headers, links, posts, handles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions import fixed
from pagevault.functions.core import let
from pagevault.functions.text import strip

HTTP_OR_WWW = r"https?://[^\s'\"<>()]+|www\.[^\s'\"<>().]+"


def _line(label: str, value: Column) -> Column:
    """`Label: value`, NULL when the value is NULL or empty, so that concat_ws leaves it out."""
    return F.when(value != "", F.concat(F.lit(label + ": "), value))


def _joined(values: Column) -> Column:
    return F.array_join(values, ", ")


def chunk_header(
    *,
    title: Column | None = None,
    description: Column | None = None,
    source: Column | None = None,
    url: Column | None = None,
    contact_name: Column | None = None,
    contact_identifier: Column | None = None,
    participant_names: Column | None = None,
    source_location_name: Column | None = None,
    keywords: Column | None = None,
    metadata: Column | None = None,
) -> Column:
    """The metadata header put before each chunk. Empty lines are left out; `Source:` is always there."""
    lines = []
    if title is not None:
        lines.append(_line("Title", title))
    if description is not None:
        lines.append(_line("Description", description))
    source = F.lit(None).cast("string") if source is None else source
    lines.append(F.concat(F.lit("Source: "), F.coalesce(source, F.lit("None"))))
    if url is not None:
        lines.append(_line("URL", url))
    if contact_name is not None:
        lines.append(_line("Contact", contact_name))
    if contact_identifier is not None:
        lines.append(_line("Contact ID", contact_identifier))
    if participant_names is not None:
        lines.append(_line("Participants", _joined(participant_names)))
    if source_location_name is not None:
        lines.append(_line("Source Location", source_location_name))
    if keywords is not None:
        lines.append(_line("Keywords", _joined(keywords)))
    if metadata is not None:
        pairs = F.transform(F.map_entries(metadata), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
        lines.append(_line("Metadata", _joined(pairs)))
    return F.concat_ws("\n", *lines)


def metrics_line(**counts: Column) -> Column:
    """Icons and counts of replies, retweets, likes and views that are not zero."""
    icons = {"replies": "💬", "retweets": "⟲", "likes": "❤️", "views": "👁️"}  # fixed values
    parts = [
        F.when(counts[k].cast("string") != "0", F.concat(F.lit(icon + " "), counts[k].cast("string")))
        for k, icon in icons.items()
        if k in counts
    ]
    return F.concat_ws(" ", *parts)


def author_link(name: Column, handle: Column, url: Column, site: str = "https://x.com") -> Column:
    """`[name](url) (@handle)`; the handle stands in for an empty name, relative URLs get the site."""
    bare = F.regexp_replace(handle, "^@+", "")
    shown = F.coalesce(F.nullif(strip(name), F.lit("")), bare)
    link = F.when(url.startswith("/"), F.concat(F.lit(site), url)).otherwise(url)
    return F.concat(F.lit("["), shown, F.lit("]("), link, F.lit(") (@"), bare, F.lit(")"))


def post_markdown(
    *,
    author: Column,
    handle: Column,
    time: Column,
    text: Column,
    profile_url: Column | None = None,
    post_url: Column | None = None,
    reposter: Column | None = None,
    media: Column | None = None,
    replies: Column | None = None,
    reposts: Column | None = None,
    likes: Column | None = None,
) -> Column:
    """Repost line, header, text, media and counts, joined by blank lines; empty parts are left out."""

    def linked(shown: Column, url: Column | None) -> Column:
        if url is None:
            return shown
        return F.when(url != "", F.concat(F.lit("["), shown, F.lit("]("), url, F.lit(")"))).otherwise(shown)

    def count(c: Column | None) -> Column:
        return F.lit("0") if c is None else F.coalesce(c.cast("string"), F.lit("0"))

    header = F.concat(
        F.lit("### "), linked(author, profile_url), F.lit(" ("), handle, F.lit(") · "), linked(time, post_url)
    )
    footer = F.concat(
        F.lit("💬 "), count(replies), F.lit("   🔄 "), count(reposts), F.lit("   ❤️ "), count(likes)
    )
    parts = []
    if reposter is not None:
        parts.append(F.when(reposter != "", F.concat(F.lit("> Reposted by "), reposter)))
    parts += [header, F.nullif(text, F.lit(""))]
    if media is not None:
        parts.append(F.nullif(F.array_join(F.filter(media, lambda m: m != ""), "\n\n"), F.lit("")))
    parts.append(footer)
    return F.concat_ws("\n\n", *parts)


def extract_urls(text: Column) -> Column:
    """http(s) and www URLs without one trailing punctuation mark."""
    found = F.regexp_extract_all(text, F.lit(HTTP_OR_WWW), F.lit(0))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?\"']$", ""))


def linkify(text: Column) -> Column:
    """Bare URLs to `[host](url)`, long hosts cut to 27 characters; linked and quoted URLs stay as they are."""
    bare = r"(?<![\"'(\[\w/.])"
    end = r"(?<![.,;:!?\"'])(?![\"'])"
    long_host = rf"{bare}(https?://([^/?#\s'\"<>()]{{27}})[^/?#\s'\"<>()]{{4,}}[^\s'\"<>()]*){end}"
    short_host = rf"{bare}(https?://([^/?#\s'\"<>()]{{1,30}})(?![^/?#\s'\"<>()])[^\s'\"<>()]*){end}"
    www = rf"{bare}(www\.[^\s'\"<>().]+){end}"
    out = F.regexp_replace(text, long_host, "[$2...]($1)")
    out = F.regexp_replace(out, short_host, "[$2]($1)")
    return F.regexp_replace(out, www, "[$1]($1)")


def extract_hashtags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)#\w+"), F.lit(0))


def name_handle(text: Column) -> Column:
    """STRUCT(name, handle) from `Name@handle...` and looser forms."""
    tight = text.rlike(r"(?s)^[^@]+@[^\s·]")
    name = strip(F.regexp_extract(text, r"(?s)^([^@]+)@", 1))
    token = F.substring_index(F.regexp_extract(text, r"(?s)^[^@]+@([^\s·]+)", 1), "Follow", 1)
    handle = F.regexp_replace(strip(token), r"(?s)[^a-zA-Z0-9_].*$", "")
    loose_handle = F.nullif(F.regexp_extract(text, r"@([a-zA-Z0-9_]+)", 1), F.lit(""))
    guesses = F.regexp_extract_all(F.substring(text, 1, 100), F.lit(r"([A-Za-z][A-Za-z\s'\-\.]{2,25})"), F.lit(1))
    guess = F.try_element_at(F.filter(guesses, lambda g: ~F.contains(F.lower(g), F.lit("follow"))), F.lit(1))
    before = F.nullif(strip(F.regexp_extract(text, r"(?s)^([^@]+)@", 1)), F.lit(""))

    def beside(sep: str) -> Column:
        """The short part before the part with the handle."""
        parts = F.split(text, sep)
        named = F.filter(
            F.transform(parts, lambda p, i: F.struct(strip(p).alias("name"), F.try_element_at(parts, i + 2).alias("next"))),
            lambda x: F.contains(x["next"], F.concat(F.lit("@"), loose_handle)) & (x["name"] != "") & (F.length(x["name"]) < 30),
        )
        return F.try_element_at(named, F.lit(1))["name"]

    near = F.when(loose_handle.isNotNull(), F.coalesce(before, *(beside(s) for s in ("\n", "•", "·", "\\|", "-"))))
    return F.struct(
        F.when(tight, name).otherwise(F.coalesce(near, strip(guess))).alias("name"),
        F.when(tight, handle).otherwise(loose_handle).alias("handle"),
    )


def bio_after_action(text: Column) -> Column:
    """The text after a follow action, without interface words, a leading handle and bare numbers."""

    def bio(action: str) -> Column:
        rest = strip(F.substring(text, F.instr(text, action) + len(action), F.length(text)))
        for words in fixed.FOLLOW_WORDS:
            rest = strip(F.replace(rest, F.lit(words), F.lit("")))
        rest = strip(F.regexp_replace(rest, r"^[a-zA-Z0-9_]{4,}", ""))
        found = let(rest, lambda r: F.when(~r.rlike(r"^\s*\d*\s*$"), r))
        return F.when(F.contains(text, F.lit(action)), found)

    return F.coalesce(*[bio(a) for a in fixed.FOLLOW_ACTIONS], F.lit(""))
