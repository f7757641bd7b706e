"""Text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions import fixed
from pagevault.functions.core import let


def _lit_pattern(text: str) -> str:
    """A literal as a Java and RE2 pattern."""
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\-" else ch for ch in text)


def any_of(words: Sequence[str]) -> str:
    return "(?:" + "|".join(_lit_pattern(w) for w in words) + ")"


# The white space that is stripped from texts (Unicode white space and the four ASCII separators).
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Strip all white space. trim() with a character set looks at the ends only, where a pattern scans the text."""
    return F.trim(text, F.lit(WHITE_SPACE))


def strip_part(text: Column) -> Column:
    """`strip` for columns and lambda variables: texts without white space at an end are passed on untouched.

    The argument is used several times, so it must not be a costly expression.
    """
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(r"(?U)\s"), strip(text)).otherwise(text)


def has_text(text: Column) -> Column:
    """Not blank; stops at the first character that is not white space."""
    return text.rlike(r"(?U)\S")


def slugify(text: Column, max_length: int = 150) -> Column:
    dashed = F.translate(F.lower(text), " _/?=&.", "-------")
    slug = F.regexp_replace(F.regexp_replace(dashed, "[^a-z0-9-]", ""), "-+", "-")
    return F.coalesce(F.nullif(F.substring(slug, 1, max_length), F.lit("")), F.lit("unknown"))


def clean_whitespace(text: Column) -> Column:
    """Tabs, returns and no-break spaces to blanks; runs of blanks to one; stripped."""
    blanks = F.translate(text, "\t\r ", "   ")
    return F.coalesce(strip(F.regexp_replace(strip(blanks), " +", " ")), F.lit(""))


def normalize_text(text: Column) -> Column:
    """Every run of white space to one blank; stripped."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def clip_text(text: Column, n: int) -> Column:
    """Without middle dots, stripped, cut to n characters with an ellipsis."""
    cleaned = strip(F.replace(text, F.lit("·"), F.lit("")))
    return F.coalesce(
        F.when(F.length(cleaned) > n, F.concat(F.substring(cleaned, 1, n), F.lit("..."))).otherwise(cleaned),
        F.lit(""),
    )


def dedup_words(text: Column) -> Column:
    """Each word once, in order of first use."""
    return F.array_join(F.array_distinct(F.split(normalize_text(text), " ")), " ")


def strip_affixes(text: Column, prefixes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """Remove each given prefix and suffix once, in order, then strip."""
    out = text
    for prefix in prefixes:
        out = F.regexp_replace(out, "^" + _lit_pattern(prefix), "")
    for suffix in suffixes:
        out = F.regexp_replace(out, _lit_pattern(suffix) + "$", "")
    return strip(out)


def trim_code_head(text: Column) -> Column:
    """Drop leading blank lines; if the first line left looks like code, start at the first content line."""

    def cut(body: Column) -> Column:
        lines = F.split(body, "\n")
        flags = F.transform(lines, lambda x: x.rlike(r"(?U)^\s*(#|[A-Z]|[*>-])"))
        start = F.greatest(F.array_position(flags, F.lit(True)).cast("int"), F.lit(1))
        return F.array_join(F.slice(lines, start, F.size(lines)), "\n")

    def trimmed(body: Column) -> Column:
        looks_like_code = F.substring_index(body, "\n", 1).rlike(fixed.CODE_HEAD_PATTERN)
        return F.when(strip(body) == "", F.lit("")).when(looks_like_code, cut(body)).otherwise(body)

    return let(F.regexp_replace(text, r"(?U)^(?:[^\S\n]*\n)+", ""), trimmed)


def drop_banner(text: Column, pattern: str) -> Column:
    """Text without what matches the pattern of a tool's own banner."""
    return F.regexp_replace(text, pattern, "")


def caption_clean(text: Column) -> Column:
    """Image captions without machine-made parts: NULL when too short, `Image` when nothing else is left."""
    marker = any_of(fixed.CAPTION_MARKERS)
    head = strip(F.element_at(F.split(text, marker, 2), 1))
    cleaned = F.when(
        text.rlike(marker), F.when(F.length(head) > 10, head).otherwise(F.lit("Image"))
    ).otherwise(text)
    only_credit = strip(cleaned).rlike(r"(?i)^Photo by [\p{L}\p{N}_\s]+ on [\p{L}\p{N}_]+ \d+, \d{4}\.?$")
    final = F.when(only_credit, F.lit("Image")).otherwise(strip(F.replace(cleaned, F.lit("·"), F.lit(""))))
    return F.when((F.length(text) >= 5) & (F.length(final) > 3), final)
