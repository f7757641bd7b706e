"""Columns that judge a line: noise, person, job title, connection, contact and funding fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions import fixed
from pagevault.functions.text import any_of, normalize_text, strip

ALL_ROLES = list(
    dict.fromkeys(fixed.LEADERSHIP_ROLES + fixed.TECHNICAL_ROLES + fixed.BUSINESS_ROLES + fixed.SENIORITY_ROLES)
)
NOISE_LINE = r"^(follow|\.\.\.|\d+|\d+(\.\d+)?x(,\s*selected)?|\d+:\d{2}|\d{1,2}\s?[hdwmy])$"
ROLE_PATTERN = (
    rf"(^|\s){any_of(ALL_ROLES)}($|[\s,.])|{any_of(ALL_ROLES)}[,. ]| {any_of(ALL_ROLES)}"
)


def is_noise(text: Column) -> Column:
    """Blank, an interface phrase, a playback speed, a clock or age text, or digits only."""
    low = F.lower(strip(text))
    return (low == "") | low.rlike(any_of([p.lower() for p in fixed.NOISE_PHRASES])) | low.rlike(NOISE_LINE)


def classify_person(text: Column) -> Column:
    """3-40 characters, two words or more, three quarters of them capitalised, no word that rules a name out."""
    words = F.split(normalize_text(text), " ")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    ruled_out = F.lower(text).rlike(any_of(fixed.NON_NAME_WORDS + ALL_ROLES + fixed.LOCATION_WORDS))
    return (
        F.length(text).between(3, 40)
        & (F.size(words) >= 2)
        & (capital >= F.size(words) * 0.75)
        & ~ruled_out
    )


def classify_title(text: Column) -> Column:
    """A relationship word, a role word, a bullet in a short text, a bar, or `X at Y`."""
    low = F.lower(text)
    x_at_y = low.rlike(r"(^|\s)(?!(?:university|school|college)\s)\S+\s+(at|of|for|with)\s+\S")
    return low.rlike(any_of(fixed.RELATIONSHIP_WORDS)) | low.rlike(ROLE_PATTERN) | x_at_y


def classify_connection(text: Column) -> Column:
    """Connection degree, mutual contacts, a follower count or a connection phrase."""
    low = F.lower(text)
    words = fixed.CONNECTION_DEGREES + fixed.CONNECTION_MUTUAL + fixed.CONNECTION_PHRASES
    return low.rlike(any_of(words)) | (low.rlike("follower|following") & text.rlike(r"\d"))


def contact_tests(text: Column) -> dict[str, Column]:
    """Contact field -> test, in order: a line serves the first field that it fits and that is still free."""
    return {
        "website": F.lower(text).rlike(r"https?:|www\."),
        "phone": text.rlike(r"\d") & text.rlike(r"[+(-]"),
        "email": F.contains(text, F.lit("@")),
        "address": F.contains(text, F.lit(",")) & text.rlike(any_of(fixed.ADDRESS_WORDS)),
    }


def funding_tests(text: Column) -> dict[str, Column]:
    return {
        "stage": F.contains(text, F.lit("Series")),
        "amount": text.rlike("[$€£]"),
        "investors": F.contains(F.lower(text), F.lit("investors")),
    }


def _first_kind(tests: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(kind)) for kind, test in tests.items()])


def contact_kind(text: Column) -> Column:
    return _first_kind(contact_tests(text))


def funding_kind(text: Column) -> Column:
    return _first_kind(funding_tests(text))
