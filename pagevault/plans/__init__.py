"""Plans: the ingest job, and the registered queries with their SQL twins."""

from __future__ import annotations

import importlib

_MODULES = ("columns", "records", "groups", "pages", "search", "streams")


def _merged(attribute: str) -> dict:
    out = {}
    for name in _MODULES:
        out.update(getattr(importlib.import_module(f"pagevault.plans.{name}"), attribute))
    return out


def all_queries() -> dict:
    return _merged("QUERIES")


def all_oracles() -> dict:
    return _merged("ORACLE")
