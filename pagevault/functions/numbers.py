"""Number columns read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagevault.functions.text import strip


def parse_metric(text: Column) -> Column:
    """`2.6K` -> 2600, `1.1M` -> 1100000, commas ignored, anything else -> 0; fractions are cut off."""
    plain = F.replace(strip(text), F.lit(","), F.lit(""))
    factor = F.when(plain.endswith("K"), 1000).when(plain.endswith("M"), 1000000).otherwise(1)
    number = F.regexp_replace(plain, "[KM]$", "")
    ok = number.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$")
    value = F.when(ok, number.try_cast("double")) * factor
    return F.coalesce(value.try_cast("long"), F.lit(0).cast("long"))


def counts_from_text(text: Column, label: str) -> Column:
    """The number before a label such as `repl(?:y|ies)` or `Followers`, NULL when there is none."""
    found = F.regexp_extract(text, rf"(?i)(\d[\d,]*)\s+{label}", 1)
    return F.replace(found, F.lit(","), F.lit("")).try_cast("long")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")
