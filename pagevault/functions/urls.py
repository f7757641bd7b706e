"""URL columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions.text import strip


def _resolve_dots(path: Column) -> Column:
    """Remove `.` segments and let `..` take its parent away."""
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(
            s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
        ).otherwise(F.concat(acc, F.array(s))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def normalize_url(url: Column) -> Column:
    """Canonical form without scheme, `www.` and trailing slashes; host in lower case; NULL for other schemes."""
    url = strip(url)
    scheme = F.lower(F.regexp_extract(url, r"^(.*?)://", 1))
    has_scheme = F.instr(url, "://") > 0
    rest = F.when(has_scheme, F.regexp_replace(url, r"^.*?://", "")).otherwise(url)
    rest = F.regexp_replace(rest, r"^www\.", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/]*/(.*)$", 1)
    web = F.regexp_replace(F.concat(host, F.when(path != "", F.concat(F.lit("/"), path)).otherwise("")), "/+$", "")

    file_rest = F.regexp_replace(F.regexp_replace(url, r"(?i)^file://", ""), r"[?#].*$", "")
    file_rest = F.regexp_replace(file_rest, r"(?i)^localhost(?=/|$)", "")
    file_path = F.regexp_replace(F.translate(file_rest, "\\", "/"), "/+", "/")
    file_url = (
        F.when(file_path == "", F.lit("file:///"))
        .when(F.contains(file_path, F.lit("..namedfork")), F.concat(F.lit("file://"), F.regexp_replace(file_path, "^(?!/)", "/")))
        .otherwise(F.concat(F.lit("file://"), _resolve_dots(file_path)))
    )
    return (
        F.when(has_scheme & (scheme == "file"), file_url)
        .when(has_scheme & ~scheme.isin("http", "https"), F.lit(None))
        .otherwise(web)
    )


def base_url(url: Column) -> Column:
    """`scheme://host` of http(s) URLs, else NULL."""
    return F.nullif(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def absolute_url(link: Column, base: Column) -> Column:
    """A relative link joined to a `scheme://host` base; absolute and special links stay as they are."""
    keep = link.rlike(r"^(https?://|mailto:|tel:|#|data:|//|javascript:)")
    rooted = F.when(link == "", base).when(link.startswith("/"), F.concat(base, link)).when(
        link.startswith("?"), F.concat(base, link)
    )
    # "./a" and "../a" against a bare host both mean "/a"
    relative = F.concat(base, F.lit("/"), F.regexp_replace(link, r"^(\.{1,2}/)+", ""))
    return F.when(link.isNull() | base.isNull() | keep, link).otherwise(F.coalesce(rooted, relative))


def same_resource(a: Column, b: Column) -> Column:
    """Equal host and path, whatever the query and the fragment."""
    return (url_host(a) == url_host(b)) & (url_path(a) == url_path(b))


def strip_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def is_url(text: Column) -> Column:
    """A scheme with a host, or any file URL."""
    return text.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+|(?i:file):)")


def is_plain_text(text: Column) -> Column:
    return text.isNotNull() & ~text.rlike(r"^(http|https|file)://")


def resolve_image_path(path: Column, base: Column) -> Column:
    """`/x` and `./x` under a base folder; other paths unchanged."""
    folder = F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"))
    return (
        F.when(base.isNull() | (base == ""), path)
        .when(path.startswith("/"), F.concat(folder, F.regexp_replace(path, "^/+", "")))
        .when(path.startswith("./"), F.concat(folder, F.regexp_replace(path, r"^\./", "")))
        .otherwise(path)
    )
