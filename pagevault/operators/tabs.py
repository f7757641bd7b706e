"""Differences between tab snapshots, routing of pages to types, unique names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagevault.functions import fixed, slugify
from pagevault.operators.rows import rule_blocks
from pagevault.operators.ordered import arrange, number_rows, shift


def tabs_added(prev: DataFrame, cur: DataFrame, key: Sequence[str] = ("tab_id",)) -> DataFrame:
    return cur.join(prev.select(*key), list(key), "left_anti")


def tabs_removed(prev: DataFrame, cur: DataFrame, key: Sequence[str] = ("tab_id",)) -> DataFrame:
    return prev.join(cur.select(*key), list(key), "left_anti")


def tabs_common(prev: DataFrame, cur: DataFrame, key: Sequence[str] = ("tab_id",)) -> DataFrame:
    return cur.join(prev.select(*key), list(key), "left_semi")


def snapshot_diff(prev: DataFrame, cur: DataFrame, key: Sequence[str] = ("tab_id",)) -> DataFrame:
    """(tab_id, url) of two polls -> change_type new/closed/navigated/kept, url and old_url. Tabs are unique per poll."""
    key = list(key)
    old = prev.select(*key, F.col("url").alias("old_url"), F.lit(True).alias("_old"))
    now = cur.select(*key, "url", F.lit(True).alias("_now"))
    both = now.join(old, key, "full_outer")
    change = (
        F.when(F.col("_old").isNull(), F.lit("new"))
        .when(F.col("_now").isNull(), F.lit("closed"))
        .when(~F.col("url").eqNullSafe(F.col("old_url")), F.lit("navigated"))
        .otherwise(F.lit("kept"))
    )
    return both.select(*key, change.alias("change_type"), "url", "old_url")


def poll_changes(
    polls: DataFrame, *, tab: str = "tab_id", poll: str = "poll", url: str = "url", sliced: bool = False
) -> DataFrame:
    """The change log of a whole series of polls, numbered 0, 1, 2 ... without holes.

    A tab is new when its last poll is not the one before, closed in the poll after its last one. Look-back and
    look-ahead along each tab replace the poll-by-poll comparison, so all polls are diffed in one pass.
    """
    rows = polls.select(F.col(tab).alias("tab_id"), F.col(poll).cast("long").alias("poll"), F.col(url).alias("url"))
    last_poll = rows.agg(F.max("poll")).scalar()
    a = shift(
        arrange(rows, ["tab_id"], ["poll"], sliced),
        _before=(F.col("poll"), 1),
        old_url=(F.col("url"), 1),
        _after=(F.col("poll"), -1),
    )
    seen_before = F.col("_before") == F.col("poll") - 1
    here = F.struct(
        F.col("poll"),
        F.when(~F.coalesce(seen_before, F.lit(False)), F.lit("new"))
        .when(~F.col("url").eqNullSafe(F.col("old_url")), F.lit("navigated"))
        .otherwise(F.lit("kept"))
        .alias("change_type"),
        F.col("url"),
        F.when(seen_before, F.col("old_url")).alias("old_url"),
    )
    gone = F.struct(
        (F.col("poll") + 1).alias("poll"),
        F.lit("closed").alias("change_type"),
        F.lit(None).cast("string").alias("url"),
        F.col("url").alias("old_url"),
    )
    closes = ~F.coalesce(F.col("_after") == F.col("poll") + 1, F.lit(False)) & (F.col("poll") < last_poll)
    return (
        a.result().select("tab_id", F.explode(F.when(closes, F.array(here, gone)).otherwise(F.array(here))).alias("c"))
        .select("tab_id", "c.*")
    )


def fetch_list(diff: DataFrame) -> DataFrame:
    """Tabs whose page must be fetched: the new and the navigated ones."""
    return diff.filter(F.col("change_type").isin("new", "navigated"))


def change_counts(diff: DataFrame, by: Sequence[str] = ("poll",)) -> DataFrame:
    return diff.groupBy(*by).agg(
        *[
            F.count_if(F.col("change_type") == kind).alias(f"n_{kind}")
            for kind in ("new", "closed", "navigated", "kept")
        ]
    )


def page_type(url: Column, rules: Sequence[tuple[str, str]] = tuple(fixed.PAGE_TYPE_RULES)) -> Column:
    """Type of the first rule whose pattern matches at the start of the URL, else `generic`.

    A chain of constant patterns compiles once per task and stops at the first match, which a join with a rules
    table cannot do. For rules that live in a table see `route_pages`.
    """
    chain = None
    for pattern, name in rules:
        test = url.rlike("^(?:" + pattern + ")")
        chain = F.when(test, F.lit(name)) if chain is None else chain.when(test, F.lit(name))
    return F.coalesce(chain, F.lit("generic")) if chain is not None else F.lit("generic")


def route_pages(pages: DataFrame, rules: DataFrame | None = None, key: str = "page_id", url: str = "url") -> DataFrame:
    """Pages with `page_type`. A rules table (prio, pattern, page_type) replaces the built-in rules.

    The rules are packed into single rows of bounded size and tested in order inside each page row: no page is copied per
    rule and nothing is grouped afterwards.
    """
    if rules is None:
        return pages.withColumn("page_type", page_type(F.col(url)))
    matches = lambda r: F.regexp_like(F.col(url), F.concat(F.lit("^(?:"), r["pattern"], F.lit(")")))
    out, hits = pages, []
    for block in rule_blocks(rules, "pattern"):
        packed = block.agg(F.array_sort(F.collect_list(F.struct("prio", "pattern", "page_type")))).scalar()
        hit = f"_hit{len(hits)}"
        first = F.try_element_at(F.filter("_rules", matches), F.lit(1))
        out = out.withColumn("_rules", packed).withColumn(hit, first).drop("_rules")
        hits.append(hit)
    best = F.array_min(F.array(*hits))["page_type"] if hits else F.lit(None)
    return out.withColumn("page_type", F.coalesce(best, F.lit("generic"))).drop(*hits)


def slug_unique(df: DataFrame, url: str, order: Sequence[str], sliced: bool = False) -> DataFrame:
    """Adds `slug`, with `_2`, `_3` ... after equal slugs in the given order."""
    slugged = df.withColumn("_slug", slugify(F.col(url)))
    a = number_rows(arrange(slugged, ["_slug"], order, sliced), "_n")
    return a.result().withColumn(
        "slug", F.when(F.col("_n") > 1, F.concat_ws("_", "_slug", F.col("_n").cast("string"))).otherwise(F.col("_slug"))
    ).drop("_slug", "_n")
