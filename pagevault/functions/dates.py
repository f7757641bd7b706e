"""Date columns read from text. The current year is always an argument, so that results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions import fixed
from pagevault.functions.text import any_of, strip

_MONTH = "(?:" + "|".join(f"{m}|{m[:3]}" for m in fixed.MONTHS) + ")"
_TEXT_DATE = rf"(?i)({_MONTH})\s+(\d{{1,2}})(?:,\s+(\d{{4}}))?"
_SHORT_MONTHS = "|".join(m[:3].title() for m in fixed.MONTHS)


def parse_date(text: Column, year: int | Column) -> Column:
    """ISO with `T` (Z allowed), else `Month D[, YYYY]`; a missing year is the given one; else NULL. TIMESTAMP."""
    year = F.lit(year) if isinstance(year, int) else year
    text = strip(text)
    iso = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?(Z|[+-]\d{2}:\d{2})?$"),
        text.try_cast("timestamp"),
    )
    month = F.array_position(
        F.array(*[F.lit(m[:3]) for m in fixed.MONTHS]), F.upper(F.substring(F.regexp_extract(text, _TEXT_DATE, 1), 1, 3))
    )
    day = F.regexp_extract(text, _TEXT_DATE, 2)
    found_year = F.coalesce(F.nullif(F.regexp_extract(text, _TEXT_DATE, 3), F.lit("")), year.cast("string"))
    written = F.concat_ws("-", found_year, F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))
    return F.coalesce(iso, F.when(month > 0, written.try_cast("date").cast("timestamp")))


def date_candidates(text: Column) -> Column:
    """The first text that looks like a date, trying the patterns in order."""
    found = [F.nullif(F.regexp_extract(text, p, 0), F.lit("")) for p in fixed.DATE_PATTERNS]
    return strip(F.coalesce(*found))


def is_relative_time(text: Column) -> Column:
    """`5m`, `1h`, `now`, `3 minutes ago`."""
    return strip(text).rlike(r"(?i)^(?:\d+\s?[smhd]|now|\d+\s+(?:second|minute|hour|day)s?\s+ago)$")


def is_month_day(text: Column) -> Column:
    """Starts like `Apr 8`."""
    return strip(text).rlike(rf"^(?:{_SHORT_MONTHS})\s+[\d,]*\d[\d,]*(?:\s|[,:;.]*$)")


def month_day_clean(text: Column) -> Column:
    """`Apr 8 Apr 8` -> `Apr 8`, and a longer text that starts with a month and a day -> these two words."""
    word = r"(\S+)\s+(\S+)"
    twice = text.rlike(rf"^\s*{word}\s+\1\s+\2(?:\s|$)")
    dated = text.rlike(rf"^\s*(?:{_SHORT_MONTHS})\s+,*\d[\d,]*(?:\s|$)")
    pair = F.concat_ws(" ", F.regexp_extract(text, rf"^\s*{word}", 1), F.regexp_extract(text, rf"^\s*{word}", 2))
    return F.when(twice | dated, pair).otherwise(text)


def founded_year(text: Column) -> Column:
    """First year 1900-2029 in a text with a founding word, or a text that is only a year."""
    year = F.nullif(F.regexp_extract(text, r"\b(19\d{2}|20[0-2]\d)\b", 1), F.lit(""))
    founding = F.lower(text).rlike(any_of(fixed.FOUNDING_WORDS))
    alone = strip(text).rlike(r"^(19\d{2}|20[0-2]\d)$")
    return F.when(founding | alone, year)
