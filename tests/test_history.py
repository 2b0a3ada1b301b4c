import random
from statistics import median

import numpy as np
import pytest

from gatelens.plans.history import Ranks, prefix_spread


def test_ranks_against_sorting():
    draw = np.random.default_rng(1)
    for n, top in ((1, 1), (50, 3), (300, 10**9)):
        values = draw.integers(-top, top, n)
        ranks = Ranks(values)
        lo = draw.integers(0, n, 60)
        hi = np.array([draw.integers(a, n) + 1 for a in lo])
        v = draw.integers(-top - 1, top + 2, 60)
        k = np.array([draw.integers(0, b - a) for a, b in zip(lo, hi, strict=True)])
        assert ranks.below(lo, hi, v).tolist() == [(values[a:b] < x).sum() for a, b, x in zip(lo, hi, v, strict=True)]
        assert ranks.kth(lo, hi, k).tolist() == [np.sort(values[a:b])[i] for a, b, i in zip(lo, hi, k, strict=True)]


@pytest.mark.parametrize("large", [10**6, 100])
def test_spread_of_prefixes_against_brute_force(spark, large):
    draw = random.Random(large)
    history = {("hot", 1): [draw.choice([5, 5, 5, draw.randint(-200, 4000), draw.randint(0, 9)]) for _ in range(600)]}
    history |= {(f"k{i}", i % 2): [draw.randint(0, 99) for _ in range(draw.randint(1, 40))] for i in range(12)}
    rows = [(a, b, pos, x) for (a, b), xs in history.items() for pos, x in enumerate(xs)]
    draw.shuffle(rows)
    asked = [(a, b, draw.randint(1, len(xs))) for (a, b), xs in history.items() for _ in range(25 if a == "hot" else 3)]
    asked += [("hot", 1, n) for n in (1, 2, 63, 64, 65, 128, 600)]
    found = prefix_spread(
        spark.createDataFrame(rows, "a string, b int, pos long, x long"),
        spark.createDataFrame(asked + asked[:5], "a string, b int, n long"),
        ["a", "b"], large=large, block=64, cells=8, task_rows=50,
    )
    got = {(r.a, r.b, r.n): (r.median, r.mad) for r in found.collect()}
    want = {}
    for a, b, n in asked:
        some = history[a, b][:n]
        middle = median(some)
        want[a, b, n] = (middle, median(abs(x - middle) for x in some))
    assert got == want


def test_spread_of_nothing(spark):
    rows = spark.createDataFrame([], "a string, pos long, x long")
    states = spark.createDataFrame([], "a string, n long")
    found = prefix_spread(rows, states, ["a"])
    assert found.columns == ["a", "n", "median", "mad"] and found.count() == 0
