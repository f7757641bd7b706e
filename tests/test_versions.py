"""Matched blocks against the standard library's matcher."""

import difflib
import random
import time

import numpy as np
import pytest

from pagevault.operators import versions as V


def library(a, b):
    return sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())


@pytest.mark.parametrize("few", [0, V.FEW])
def test_random_pairs(monkeypatch, few):
    monkeypatch.setattr(V, "FEW", few)
    rng = random.Random(1)
    for _ in range(1500):
        kinds = rng.choice([1, 2, 3, 5, 30])
        a = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        b = [rng.randrange(kinds) for _ in range(rng.randint(0, 40))]
        if rng.random() < 0.4:
            b = a[:]
            for _ in range(4):
                b.insert(rng.randint(0, len(b)), rng.randrange(kinds + 5))
        x, y = np.array(a, np.int64), np.array(b, np.int64)
        assert V.matched_blocks(x, y) == library(a, b)
        assert V.matched_blocks(V._shrunk(x, y, -1), V._shrunk(y, x, -2)) == library(a, b)


def test_ten_thousand_blocks():
    rng = random.Random(2)
    pairs = [([rng.randrange(k) for _ in range(10_000)], [rng.randrange(k) for _ in range(10_000)]) for k in (1, 2, 10, 1000)]
    edited = list(range(10_000))
    for _ in range(500):
        edited[rng.randrange(len(edited))] = rng.randrange(10**6, 10**7)
    for _ in range(200):
        edited.insert(rng.randrange(len(edited)), edited.pop(rng.randrange(len(edited))))
    for a, b in [*pairs, (list(range(10_000)), edited)]:
        start = time.perf_counter()
        got = V.matched_blocks(np.array(a), np.array(b))
        assert time.perf_counter() - start < 5  # well under a second on a free machine
        if len(set(a)) > 100:
            assert got == library(a, b)
