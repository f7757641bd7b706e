"""Tables of exits against running the rule from each state."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagevault.operators import elements as E
from pagevault.operators import ordered as O
from pagevault.streaming import interactions as X


class Entered:
    def __init__(self, table):
        self.bounds, self.exits = table.result()


@pytest.mark.parametrize("gap_ms", [1, 7, 100, 5000])
def test_throttle_exits(gap_ms):
    rng = random.Random(gap_ms)
    step = X._throttle_step(gap_ms)
    for _ in range(60):
        t = np.sort(np.array([rng.randrange(10_000, 10_000 + rng.choice([50, 3000, 400_000])) for _ in range(rng.randint(1, 80))]))
        table, at = X._ThrottleExits(gap_ms), 0
        while at < len(t):  # in batches of any size
            n = rng.randint(1, 30)
            table.feed({"_us": t[at : at + n]})
            at += n
        table = Entered(table)
        for s in [None, *range(int(t[0]) - gap_ms * 1000 - 3, int(t[0]) + 1, max(1, gap_ms * 7))]:
            assert O._entered(table, s) == step(s, {"_us": t})[1]


def test_profile_exits():
    rng = random.Random(1)
    for _ in range(200):
        rows = {"_pair": np.array([rng.random() < 0.5 for _ in range(20)]), "_bio": np.array([rng.random() < 0.5 for _ in range(20)])}
        table = E._ProfileExits()
        table.feed({k: v[:7] for k, v in rows.items()})
        table.feed({k: v[7:] for k, v in rows.items()})
        table = Entered(table)
        for s in (None, 0, 1, 2):
            assert (O._entered(table, s) or 0) == (E._profile_step(s, rows)[1] or 0)


def test_chains_that_never_meet(spark):
    """One key, events at even distances: where the kept ones lie depends on the very first event, through all slices."""
    df = spark.range(20_000).select(F.lit("u").alias("user"), F.timestamp_millis(F.col("id") * 100 + 50).alias("ts"), F.col("id").alias("event_id"))
    plain, sliced = (X.throttle(df, ["user"], ms=250, sliced=s).select("event_id").collect() for s in (False, True))
    assert sorted(r[0] for r in sliced) == sorted(r[0] for r in plain) == list(range(0, 20_000, 3))
