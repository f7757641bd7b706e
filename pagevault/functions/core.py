"""Helpers for writing column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once per row.

    An expression that is used inside a lambda is otherwise computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)




def sql_string(text: str) -> str:
    """A Python text as a SQL string literal."""
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\t", "\\t")
    return f"'{escaped}'"


def constant_map(values: dict[str, str]) -> Column:
    """A constant MAP<STRING, STRING>, built in one call."""
    return F.expr("map(" + ", ".join(sql_string(x) for pair in values.items() for x in pair) + ")")


def constant_array(values: list[str]) -> Column:
    """A constant ARRAY<STRING>, built in one call."""
    return F.expr("array(" + ", ".join(sql_string(x) for x in values) + ")")
