"""Literal cases and properties of unit operators."""

import random

import pytest

from quillspark.functions.config import backoff, parse_pages, quota
from quillspark.operators import units


def packed(spark, lengths, budget, size):
    df = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "d int, i int, n int")
    got = units.first_fit(df, ["d"], "i", "n", budget, size).orderBy("batch_no").collect()
    return [[int(x) for x in r["items"].split(",")] for r in got]


@pytest.mark.parametrize(
    ("lengths", "size", "budget", "want"),
    [([20, 20, 5], 10, 30, [[0, 2], [1]]), ([40, 1], 10, 10, [[0], [1]]), ([100] * 3, 2, 0, [[0, 1], [2]]), ([1] * 3, 2, 3000, [[0, 1], [2]])],
)
def test_first_fit(spark, lengths, size, budget, want):
    assert packed(spark, lengths, budget, size) == want


def test_first_fit_covers_all(spark):
    rng = random.Random(4)
    lengths = [rng.randint(2500, 3500) if rng.random() < 0.08 else int(rng.lognormvariate(6.2, 0.75)) for _ in range(200)]
    got = packed(spark, lengths, 3000, 6)
    assert sorted(x for b in got for x in b) == list(range(200))
    assert all(len(b) <= 6 and b == sorted(b) and (len(b) == 1 or sum(lengths[i] for i in b) <= 3000) for b in got)


def test_pages_and_quota():
    assert parse_pages("1-2,5", 10) == [0, 1, 4]
    assert parse_pages("9-12", 10) == [8, 9]
    for bad in ("x", "0", "3-1", "2-"):
        with pytest.raises(ValueError):
            parse_pages(bad, 10)
    assert quota(10, 10_000) == (6.0, 2560)
    assert quota(60, 600) == (1.0, 400)
    assert [backoff(2, a, 10) for a in (1, 2, 3, 4)] == [2, 4, 8, 10]


def test_cache_tiers(spark):
    u = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], "i int, k1 string, k2 string")
    one = spark.createDataFrame([("a", "A")], "k string, dst string")
    two = spark.createDataFrame([("x", "X"), ("y", "Y")], "k string, dst string")
    got = {r["i"]: (r["dst"], r["tier"]) for r in units.cache_hits(u, [("k1", one), ("k2", two)]).collect()}
    assert got == {1: ("A", 0), 2: ("Y", 1), 3: (None, None)}


def test_over_budget_at_the_limit(spark):
    df = spark.createDataFrame([(10, 460, 400), (10, 461, 400), (460, 461, 400), (461, 462, 400)], "src long, dst long, budget int")
    got = df.where(units.over_budget(df.src, df.dst, df.budget)).collect()
    assert [(r.src, r.dst) for r in got] == [(10, 461), (460, 461)]
