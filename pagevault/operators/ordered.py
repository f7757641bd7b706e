"""Ordered work inside groups (numbering, running sums, look-back) that survives a group of any size.

The functions below are plain window expressions over one shuffle and one sort. The sort spills and the windows
pass over their rows one by one, so memory does not depend on the size of a group; only time does, since one group is one task's work.
Where a key is known to hold a large share of all rows, `arrange(..., sliced=True)` range-partitions the rows on (key, order)
instead, so that Spark splits that group over many tasks; windows then run per (key, slice) and a small carry table connects the
slices. At most `partitions - 1` keys can span more than one slice, so the carry tables hold at most
2 x partitions rows (times the look-back) and may be broadcast safely. Both ways give the same rows; no job runs while a plan
is built, but for the cut into slices, which is kept in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagevault.session import ensure_checkpoint_dir

SLICE = "_slice"


@dataclass(frozen=True)
class Arranged:
    """Rows with their grouping key and order, and whether groups are cut into slices."""

    df: DataFrame
    key: tuple[str, ...]
    order: tuple[str, ...]
    sliced: bool

    @property
    def group(self) -> list[str]:
        return [*self.key, SLICE] if self.sliced else list(self.key)

    def window(self):
        return Window.partitionBy(*self.group).orderBy(*self.order)

    def having(self, df: DataFrame) -> "Arranged":
        return Arranged(df, self.key, self.order, self.sliced)

    def result(self) -> DataFrame:
        return self.df.drop(SLICE) if self.sliced else self.df


def arrange(df: DataFrame, key: Sequence[str], order: Sequence[str], sliced: bool = False) -> Arranged:
    """Prepare ordered work. `order` must end in a column that is unique in its group.

    `sliced` splits groups over tasks. Without a key all rows are one group, which is always cut into slices.
    """
    if key and not sliced:
        return Arranged(df, tuple(key), tuple(order), False)
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the slice number depends on sampled range bounds: freeze it, so that every later use agrees
    ranged = (
        df.repartitionByRange(n, *[F.col(c) for c in (*key, *order)])
        .withColumn(SLICE, F.spark_partition_id())
        .checkpoint()
    )
    return Arranged(ranged, tuple(key), tuple(order), True)


def _same_key(a: Arranged, left: DataFrame, right: DataFrame, *more: Column) -> Column:
    cond = F.lit(True)
    for k in a.key:
        cond = cond & left[k].eqNullSafe(right["_k_" + k])
    for c in more:
        cond = cond & c
    return cond


def _renamed(a: Arranged, df: DataFrame) -> DataFrame:
    for k in a.key:
        df = df.withColumnRenamed(k, "_k_" + k)
    return df.withColumnRenamed(SLICE, "_k_slice")


def _attach(a: Arranged, carry: DataFrame, on_slice: bool = True) -> DataFrame:
    """Left join of a carry table (bounded by the number of slices, see the module text)."""
    small = _renamed(a, carry)
    cond = [a.df[SLICE] == small["_k_slice"]] if on_slice else []
    joined = a.df.join(F.broadcast(small), _same_key(a, a.df, small, *cond), "left")
    return joined.drop(*["_k_" + k for k in a.key], "_k_slice")


def _spanning(a: Arranged, per_slice: DataFrame) -> DataFrame:
    """Keep the slices of keys that span more than one slice."""
    w = Window.partitionBy(*a.key) if a.key else Window.partitionBy(F.lit(0))
    return per_slice.withColumn("_n_slices", F.count(F.lit(1)).over(w)).filter("_n_slices > 1").drop("_n_slices")


def _slice_window(a: Arranged):
    return (Window.partitionBy(*a.key) if a.key else Window.partitionBy(F.lit(0))).orderBy(SLICE)


def running_sum(a: Arranged, **sums: Column) -> Arranged:
    """Add running sums (this row included)."""
    w = a.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if not a.sliced:
        return a.having(a.df.withColumns({n: F.sum(e).over(w) for n, e in sums.items()}))
    totals = a.df.groupBy(*a.group).agg(*[F.sum(e).alias(n) for n, e in sums.items()])
    before = _slice_window(a).rowsBetween(Window.unboundedPreceding, -1)
    carry = _spanning(a, totals).select(
        *a.group, *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias("_c_" + n) for n in sums]
    )
    local = a.having(a.df.withColumns({n: F.sum(e).over(w) for n, e in sums.items()}))
    out = _attach(local, carry)
    out = out.withColumns({n: F.col(n) + F.coalesce(F.col("_c_" + n), F.lit(0)) for n in sums})
    return a.having(out.drop(*["_c_" + n for n in sums]))


def number_rows(a: Arranged, name: str) -> Arranged:
    """Add the row number in the group, from 1."""
    if not a.sliced:
        return a.having(a.df.withColumn(name, F.row_number().over(a.window()).cast("long")))
    return running_sum(a, **{name: F.lit(1).cast("long")})


def group_total(a: Arranged, **totals: Column) -> Arranged:
    """Add aggregates over the whole group to each row. The expressions must be sums of rows, given as sum()."""
    if not a.sliced:
        w = Window.partitionBy(*a.key)
        return a.having(a.df.withColumns({n: e.over(w) for n, e in totals.items()}))
    per_key = a.df.groupBy(*a.key).agg(*[e.alias(n) for n, e in totals.items()])
    if not a.key:
        return a.having(a.df.crossJoin(F.broadcast(per_key)))  # one row
    joined = a.df.join(per_key.withColumnsRenamed({k: "_k_" + k for k in a.key}), _same_key_plain(a, per_key), "left")
    return a.having(joined.drop(*["_k_" + k for k in a.key]))


def _same_key_plain(a: Arranged, per_key: DataFrame) -> Column:
    cond = F.lit(True)
    for k in a.key:
        cond = cond & F.col(k).eqNullSafe(F.col("_k_" + k))
    return cond


def shift(a: Arranged, **cols: tuple[Column, int]) -> Arranged:
    """Add values of other rows: name=(expression, n) takes n rows back, or -n rows ahead when negative."""
    w = a.window()

    def moved(e: Column, n: int) -> Column:
        return F.lag(e, n).over(w) if n > 0 else F.lead(e, -n).over(w)

    if not a.sliced:
        return a.having(a.df.withColumns({name: moved(e, n) for name, (e, n) in cols.items()}))
    out = a
    for ahead in (False, True):
        part = {n: v for n, v in cols.items() if (v[1] < 0) == ahead}
        if part:
            out = _shift_sliced(out, part, ahead)
    return out


def _shift_sliced(a: Arranged, cols: dict[str, tuple[Column, int]], ahead: bool) -> Arranged:
    reach = max(abs(n) for _, n in cols.values())
    w = a.window()
    place = F.row_number().over(w if not ahead else Window.partitionBy(*a.group).orderBy(*[F.desc(c) for c in a.order]))
    size = F.count(F.lit(1)).over(Window.partitionBy(*a.group))
    local = a.df.withColumns(
        {
            **{f"_v_{n}": e for n, (e, _) in cols.items()},
            "_place": place.cast("int"),
        }
    )
    # rows at the edge that later (earlier) slices may look at: the last (first) `reach` of each slice
    edge = (
        local.withColumn("_size", size)
        .filter(F.col("_size") - F.col("_place") < reach)
        .select(*a.group, (F.col("_size") - F.col("_place")).alias("_from_edge"), *[f"_v_{n}" for n in cols])
    )
    slices = _spanning(a, a.df.groupBy(*a.group).agg(F.lit(1).alias("_one"))).drop("_one")
    near = _renamed(a, slices)
    edges = edge.join(F.broadcast(near), _same_key(a, edge, near, edge[SLICE] == near["_k_slice"]), "left_semi")
    # nearest first: slices closest to the row, and in a slice the rows closest to its edge
    near_first = F.col(SLICE) if ahead else -F.col(SLICE)
    packed = edges.select(
        *a.key,
        F.struct(near_first.alias("rank"), F.col("_from_edge"), *[F.col(f"_v_{n}") for n in cols]).alias("_e"),
    )
    lists = packed.groupBy(*a.key).agg(F.collect_list("_e").alias("_edges"))
    values = ["rank", "_from_edge"]
    lists = lists.withColumn(
        "_edges",
        F.array_sort(
            "_edges",
            lambda x, y: F.when(F.struct(*[x[v] for v in values]) < F.struct(*[y[v] for v in values]), -1)
            .when(F.struct(*[x[v] for v in values]) > F.struct(*[y[v] for v in values]), 1)
            .otherwise(0),
        ),
    )
    joined = _attach(a.having(local), lists, on_slice=False)
    mine = F.col(SLICE) if ahead else -F.col(SLICE)
    beyond = F.filter("_edges", lambda e: e["rank"] > mine)

    def value(name: str, e: Column, n: int) -> Column:
        inside = F.lag(f"_v_{name}", n).over(w) if n > 0 else F.lead(f"_v_{name}", -n).over(w)
        outside = F.try_element_at(beyond, F.lit(abs(n)) - F.col("_place") + 1)
        return F.when(F.col("_place") > abs(n), inside).otherwise(outside[f"_v_{name}"])

    out = joined.withColumns({n: value(n, e, k) for n, (e, k) in cols.items()})
    return a.having(out.drop("_edges", "_place", *[f"_v_{n}" for n in cols]))


def fill_forward(a: Arranged, **cols: Column) -> Arranged:
    """Add the last non-NULL value up to this row."""
    w = a.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = a.having(a.df.withColumns({n: F.last(e, ignorenulls=True).over(w) for n, e in cols.items()}))
    if not a.sliced:
        return filled
    at = F.struct(*a.order)
    lasts = a.df.groupBy(*a.group).agg(
        *[F.max_by(e, F.when(e.isNotNull(), at)).alias(n) for n, e in cols.items()]
    )
    before = _slice_window(a).rowsBetween(Window.unboundedPreceding, -1)
    carry = _spanning(a, lasts).select(
        *a.group, *[F.last(n, ignorenulls=True).over(before).alias("_c_" + n) for n in cols]
    )
    out = _attach(filled, carry)
    out = out.withColumns({n: F.coalesce(F.col(n), F.col("_c_" + n)) for n in cols})
    return a.having(out.drop(*["_c_" + n for n in cols]))


Step = Callable[[int | None, dict[str, np.ndarray]], tuple[np.ndarray, int | None]]
AS_ENTERED = -(1 << 63)  # in a table of exits: the state leaves the slice as it came


class ExitTable:
    """The state with which a slice is left, for every state it may be entered with, found in one pass over its rows.

    `feed` gets the rows batch by batch. `result` gives sorted bounds and one exit more than bounds: a state is in the class of the number of
    bounds up to it. No state (the first slice) is class 0. Neighbouring classes with one exit are joined, so tables are small once the rule forgets.
    """

    def feed(self, rows: dict[str, np.ndarray]) -> None:
        raise NotImplementedError

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bounds and exits, before classes are joined."""
        raise NotImplementedError

    def result(self) -> tuple[list[int], list[int]]:
        bounds, exits = self.classes()
        keep = np.flatnonzero(exits[1:] != exits[:-1])
        return bounds[keep].tolist(), [int(exits[0]), *exits[keep + 1].tolist()]


def _entered(table, state: int | None) -> int | None:
    """The exit of a slice entered with this state."""
    k = 0 if state is None else int(np.searchsorted(np.array(table.bounds, np.int64), state, side="right"))
    return state if table.exits[k] == AS_ENTERED else table.exits[k]


def _runs(pdf: pd.DataFrame, group: list[str]) -> Iterator[tuple[int, int, tuple]]:
    """Begin, end and key of each run of rows of one group in a batch."""
    keys = pdf[group]
    changed = (keys != keys.shift()) & ~(keys.isna() & keys.shift().isna())
    starts = np.unique(np.concatenate([[0], np.flatnonzero(changed.any(axis=1).to_numpy())]))
    firsts = keys.iloc[starts].astype(object).where(keys.iloc[starts].notna(), None)
    yield from zip(starts, [*starts[1:], len(pdf)], firsts.itertuples(index=False, name=None), strict=True)


def _scanner(group: list[str], inputs: list[str], step: Step, flag: str):
    """Batches of rows sorted by group and order -> flags; the state of a group runs on over batch borders."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current: tuple | None = None
        state: int | None = None
        for pdf in batches:
            if pdf.empty:
                continue
            flags = np.empty(len(pdf), dtype=object)
            columns = {c: pdf[c].to_numpy() for c in inputs}
            for lo, hi, ident in _runs(pdf, group):
                if ident != current:
                    entry = pdf["_entry"].iloc[lo]
                    current, state = ident, None if pd.isna(entry) else int(entry)
                flags[lo:hi], state = step(state, {c: values[lo:hi] for c, values in columns.items()})
            yield pdf.drop(columns=["_entry"]).assign(**{flag: flags})

    return run


def _tabulator(group: list[str], inputs: list[str], new_table: Callable[[], ExitTable]):
    """Batches of rows sorted by group and order -> one row per group with its table of exits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, key, table = None, None, None

        def done() -> pd.DataFrame:
            bounds, exits = table.result()
            return key.assign(bounds=[bounds], exits=[exits])

        for pdf in batches:
            if pdf.empty:
                continue
            columns = {c: pdf[c].to_numpy() for c in inputs}
            for lo, hi, ident in _runs(pdf, group):
                if ident != current:
                    if table is not None:
                        yield done()
                    current, key, table = ident, pdf[group].iloc[[lo]], new_table()
                table.feed({c: values[lo:hi] for c, values in columns.items()})
        if table is not None:
            yield done()

    return run


def greedy_scan(a: Arranged, flag: str, flag_type: str, inputs: Sequence[str], step: Step, new_table: Callable[[], ExitTable]) -> Arranged:
    """Add a column computed by a sequential rule: `step(state, columns) -> (values, state)` on numpy arrays of the
    inputs, with a whole number as state.

    The rule sees the rows of a group in order, batch by batch, with constant memory. Where groups are cut into slices, one pass makes the
    table of exits of each slice of a spanning key (`new_table`), the driver follows the states from slice to slice through these tables,
    and a second pass computes the column from the states found. So there are two passes, however slowly the rule forgets.
    """
    df = a.df
    group = list(a.group)
    fields = [f for f in df.schema.fields]
    out_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{flag}` {flag_type}"
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields if f.name in group)
    inputs = list(inputs)

    if not a.sliced:
        rows = df.withColumn("_entry", F.lit(None).cast("long")).repartition(*a.key).sortWithinPartitions(*a.key, *a.order)
        return a.having(rows.mapInPandas(_scanner(group, inputs, step, flag), out_ddl))

    spanning = _spanning(a, df.groupBy(*group).agg(F.lit(1).alias("_one"))).drop("_one")
    small = _renamed(a, spanning)
    hot = df.join(F.broadcast(small), _same_key(a, df, small, df[SLICE] == small["_k_slice"]), "left_semi")
    hot = hot.select(*dict.fromkeys([*group, *a.order, *inputs])).repartition(*group).sortWithinPartitions(*group, *a.order)
    # one row per slice of a spanning key: bounded by the number of slices
    tables = hot.mapInPandas(_tabulator(group, inputs, new_table), f"{key_ddl}, bounds array<long>, exits array<long>").collect()
    states: dict[tuple, int | None] = {}
    found = []
    for r in sorted(tables, key=lambda r: r[SLICE]):
        key = tuple(r[k] for k in a.key)
        found.append((*(r[f.name] for f in fields if f.name in group), states.get(key)))
        states[key] = _entered(r, states.get(key))
    known = df.sparkSession.createDataFrame(found, f"{key_ddl}, _entry long")
    rows = _attach(a, known).repartition(*group).sortWithinPartitions(*group, *a.order)
    rows = rows.select(*[f.name for f in fields], "_entry")
    return a.having(rows.mapInPandas(_scanner(group, inputs, step, flag), out_ddl))
