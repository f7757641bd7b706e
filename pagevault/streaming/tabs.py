"""Streams of tab snapshots and of visited URLs."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagevault.operators import docs as D
from pagevault.operators.keyindex import KeyIndex
from pagevault.operators.rows import first_of
from pagevault.streaming.inorder import DELAY, IDLE_MS, SLOT_MS, Rule, in_order

CHANGES = "session_id string, poll long, tab_id long, change_type string, url string, old_url string"
_COLUMNS = ["session_id", "poll", "tab_id", "change_type", "url", "old_url"]


class _Diff(Rule):
    """The state is the last poll's number and its tabs, one map entry per tab; a poll without a change writes nothing."""

    def init(self, handle) -> None:
        self.stored_tabs = handle.getMapState("tabs", "tab_id long", "url string")
        self.stored_poll = handle.getValueState("poll", "poll long")
        self.stored = {}

    def forget(self) -> None:
        self.tabs, self.last = {}, None

    def load(self) -> None:
        self.tabs = {k[0]: v[0] for k, v in self.stored_tabs.iterator()}
        self.last = (self.stored_poll.get() or (None,))[0]
        self.stored = dict(self.tabs)

    def save(self) -> None:
        stored, self.stored = self.stored, {}
        for tab in stored.keys() - self.tabs.keys():
            self.stored_tabs.removeKey((tab,))
        for tab, url in self.tabs.items():
            if tab not in stored or stored[tab] != url:
                self.stored_tabs.updateValue((tab,), (url,))
        self.stored_poll.update((self.last,))

    def clear(self) -> None:
        self.stored_tabs.clear()
        self.stored_poll.clear()

    def run(self, key, rows: pd.DataFrame) -> pd.DataFrame:
        tabs, last, out = self.tabs, self.last, []
        for (_, poll), listed in rows.groupby(["_us", "poll"], sort=False):
            if last is not None and poll <= last:
                continue
            listed = listed[listed["tab_id"].notna()]
            now = dict(zip(listed["tab_id"].astype("int64").tolist(), listed["url"].tolist(), strict=True))
            for tab, url in now.items():
                if tab not in tabs:
                    out.append((key[0], poll, tab, "new", url, None))
                elif tabs[tab] != url:
                    out.append((key[0], poll, tab, "navigated", url, tabs[tab]))
            out += [(key[0], poll, tab, "closed", None, url) for tab, url in tabs.items() if tab not in now]
            last, tabs = int(poll), now
        self.tabs, self.last = tabs, last
        return pd.DataFrame(out, columns=_COLUMNS)


def tab_changes_stream(snapshots: DataFrame, ts: str = "ts", delay: str = DELAY, slot_ms: int = SLOT_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """Polls (session_id, poll, ts, tabs ARRAY<STRUCT(tab_id, url)>) to their changes, in event order (see `in_order`).

    An unchanged poll gives no rows; one without tabs closes those that were open. The state of a session is its open tabs; a closed tab leaves it
    at once, and a session without polls for `idle_ms` leaves it whole, so that its tabs are new when it comes back. Numbers of
    polls grow with time; a poll that comes again is left out. The batch twin is `operators.tabs.poll_changes`.
    """
    tabs = snapshots.select("session_id", "poll", ts, F.explode_outer("tabs").alias("_t")).select("session_id", "poll", ts, "_t.tab_id", "_t.url")
    return in_order(tabs, ["session_id"], ts, ["poll"], _Diff(), CHANGES, delay, slot_ms, idle_ms)


def seen_url_stream(
    pages: DataFrame, path: str, checkpoint: str, order: Sequence[str], docs: DataFrame | None = None, **trigger
) -> StreamingQuery:
    """Pages whose URL no earlier page had, however long ago, nor any of `docs`; they are written below `path`/pages, a folder per batch.

    `order` is unique; of pages with one URL in a batch the first by it is kept. Pages without URL were never seen: all are kept. The URLs stored before are
    in a levelled key index below `path`, of which a batch opens only the files that may hold its URLs. A batch writes only its own
    folders, so running it again changes nothing. `path` and `checkpoint` belong together.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        index = KeyIndex(batch.sparkSession, f"{path}/urls")
        has_url = F.coalesce(F.col("url") != "", F.lit(False))
        fresh = first_of(batch.filter(has_url), ["url"], [F.asc(c) for c in order])
        if docs is not None:
            fresh = D.seen_urls_anti(fresh, docs)
        seen = index.lookup(fresh.select(F.col("url").alias("k")), batch_id).select(F.col("k").alias("url"))
        fresh = fresh.join(seen, "url", "left_anti").select(batch.columns)
        out = f"{path}/pages/batch={batch_id}"
        fresh.unionByName(batch.filter(~has_url)).write.mode("overwrite").parquet(out)
        kept = batch.sparkSession.read.schema(pages.schema).parquet(out).filter(has_url)
        index.add(kept.select(F.col("url").alias("k"), F.lit("").alias("id"), F.lit(False).alias("deleted")), batch_id)

    return (
        pages.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
