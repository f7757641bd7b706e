"""Filters for interface noise in lines and elements."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagevault.functions import fixed, is_noise
from pagevault.functions.text import any_of, strip
from pagevault.operators.rows import rule_blocks

AUTOMATON_BYTES = 16 << 20  # of phrases in one automaton


def noise_filter(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text is not interface noise (one compiled pattern, no join)."""
    return df.filter(~is_noise(F.col(col)))


def _phrase_finder(phrases: Broadcast, name: str) -> Callable[[pa.Array], pa.Array]:
    """Whether each text holds one of the phrases: an Aho-Corasick automaton, built once in each Python worker and kept under `name`."""

    def run(texts: pa.Array) -> pa.Array:
        # functions travel by value, so a module's own globals are new in every task
        kept = sys.modules.setdefault("_phrase_automata", types.ModuleType("_phrase_automata")).__dict__.setdefault("kept", {})
        if name not in kept:
            if len(kept) >= 4:
                kept.clear()
            kept[name] = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
            for p in phrases.value:
                kept[name].add_word(p)
            kept[name].make_automaton()
        found = [None if t is None else next(kept[name].iter(t), None) is not None for t in texts.to_pylist()]
        return pa.array(found, pa.bool_())

    return run


def noise_filter_rules(df: DataFrame, col: str, rules: DataFrame, keep: Column | None = None) -> DataFrame:
    """The same with extra phrases (column `phrase`, any case) and a condition that keeps a row whatever it matches.

    One pass over the texts for all phrases together, whatever their number: they make an automaton, which is broadcast as a list of bounded size.
    Only rule tables beyond AUTOMATON_BYTES take a pass for each part of that size. An empty phrase is in every text; NULL texts go.
    """
    low = F.lower(strip(F.col(col)))
    stays = ~is_noise(F.col(col)) if keep is None else ~is_noise(F.col(col)) | keep
    out = df.filter(stays)
    for block in rule_blocks(rules, "phrase", AUTOMATON_BYTES):
        phrases = [r[0] for r in block.select(F.lower("phrase")).filter(F.col("lower(phrase)").isNotNull()).distinct().collect()]
        if "" in phrases:
            hit = low.isNotNull()
        elif phrases:
            find = _phrase_finder(df.sparkSession.sparkContext.broadcast(phrases), uuid.uuid4().hex)
            hit = F.arrow_udf(find, "boolean")(low)
        else:
            continue
        out = out.withColumn("_hit", hit).filter(~F.col("_hit") if keep is None else ~F.col("_hit") | keep).drop("_hit")
    return out


def node_is_noise(text: Column, attrs: Column, phrases: Sequence[str]) -> Column:
    """A phrase in text or attributes, or an interface word in these and also in a class name."""
    text = F.lower(text)
    joined = F.lower(F.array_join(F.map_values(attrs), " "))
    classes = F.lower(F.coalesce(F.try_element_at(attrs, F.lit("class")), F.lit("")))
    hit = F.lit(False)
    if phrases:
        pattern = any_of([p.lower() for p in phrases])
        hit = text.rlike(pattern) | joined.rlike(pattern)
    for word in fixed.UI_WORDS:
        hit = hit | ((F.contains(text, F.lit(word)) | F.contains(joined, F.lit(word))) & F.contains(classes, F.lit(word)))
    return F.coalesce(hit, F.lit(False))


def node_noise_filter(elements: DataFrame, phrases: Sequence[str]) -> DataFrame:
    return elements.filter(~node_is_noise(F.coalesce(F.col("text"), F.lit("")), F.col("attrs"), phrases))


def section_allow(
    df: DataFrame, col: str, allow: Sequence[str] = fixed.KEPT_SECTIONS, skip: Sequence[str] = fixed.SKIPPED_SECTIONS
) -> DataFrame:
    """Headers that hold an allowed phrase and no skipped one."""
    kept = F.col(col).rlike(any_of(allow))
    if skip:
        kept = kept & ~F.col(col).rlike(any_of(skip))
    return df.filter(kept)
