from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from siftwell.operators.ordinals import first_few, first_n, positions, range_borders, running_total


@pytest.fixture(scope="module")
def skewed(spark):
    """One key with a third of the rows, null keys, and an order that is not dense."""
    rng = random.Random(3)
    rows = [(("hot" if i % 3 == 0 else rng.choice(["a", "b", None])), f"p{rng.randrange(10**6):06d}-{i}", i % 7) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "k string, p string, w int")


def _expected(rows, key, weight):
    totals, out = {}, {}
    for k, p, w in sorted(rows, key=lambda r: r[1]):
        group = k if key else 0
        out[p] = totals.get(group, 0)
        totals[group] = out[p] + (w if weight else 1)
    return out


@pytest.mark.parametrize("ranges", [2, 8, 100])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_positions_equal_a_loop(skewed, keys, ranges):
    rows, df = skewed
    got = {r.p: r.position for r in positions(df, keys, ["p"], ranges=ranges).collect()}
    assert got == _expected(rows, keys, False)


def test_running_totals_equal_a_loop(skewed):
    rows, df = skewed
    total = running_total(df, ["k"], ["p"], F.col("w"), "t")
    expected = _expected(rows, ["k"], True)
    assert {r.p: r.t for r in total.collect()} == expected
    cut = running_total(df, ["k"], ["p"], F.col("w"), "t", ranges=8, below=100)
    assert {r.p: r.t for r in cut.collect()} == {p: t for p, t in expected.items() if t < 100}


def test_a_hot_first_order_column_is_split(skewed):
    rows, df = skewed
    staged = positions(df, ["k"], ["w", "p"], ranges=16)
    expected, seen = {}, {}
    for k, p, w in sorted(rows, key=lambda r: (r[2], r[1])):
        expected[p] = seen.get(k, 0)
        seen[k] = expected[p] + 1
    assert {r.p: r.position for r in staged.collect()} == expected


def test_nulls_ties_and_empty_tables(spark):
    rows = [(None, None, 1), (None, "a", 2), ("x", None, 4), ("x", "b", 8), ("x", "b", 8)]
    df = spark.createDataFrame(rows, "k string, o string, w int")
    got = sorted((r.k or "", r.o or "", r.t) for r in running_total(df, ["k"], ["o"], F.col("w"), "t").collect())
    assert got == [("", "", 0), ("", "a", 1), ("x", "", 0), ("x", "b", 4), ("x", "b", 12)]
    assert positions(df.limit(0), ["k"], ["o"]).count() == 0 and positions(df.limit(0), [], ["o"]).count() == 0


@pytest.mark.parametrize("n", [3, 1200])
def test_first_n(skewed, n):
    rows, df = skewed
    expected = {p: t for p, t in _expected(rows, ["k"], False).items() if t < n}
    assert {r.p: r.position for r in first_n(df, ["k"], ["p"], n).collect()} == expected
    assert {r.p: r.position for r in first_few(df, ["k"], ["p"], n).collect()} == expected


@pytest.mark.parametrize("order", [["k", "p"], ["p"]])
def test_a_hot_key_is_spread_over_ranges(spark, order):
    """With one key for everything, no range holds much more than its share."""
    df = spark.range(20_000).select(F.lit("hot").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("p"))
    borders = range_borders(df, order, 16).first().borders
    assert len(borders) == 15
    places = sorted(tuple(r) for r in df.select(*order).collect())
    sizes = [sum(1 for p in places if (not lo or p >= lo) and (not hi or p < hi)) for lo, hi in zip([None, *map(tuple, borders)], [*map(tuple, borders), None], strict=True)]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 16 * 2.5


def test_nothing_runs_while_the_plan_is_made(spark, skewed):
    """No job is started before the result is asked for."""
    tracker = spark.sparkContext.statusTracker()
    _, df = skewed
    spark.sparkContext.setJobGroup("planning", "planning")
    running_total(df, ["k"], ["p"], F.col("w"), below=10)
    positions(df, [], ["p"])
    assert list(tracker.getJobIdsForGroup("planning")) == []
    spark.sparkContext._jsc.clearJobGroup()


def test_the_partial_limit_is_before_the_shuffle(skewed):
    _, df = skewed
    plan = first_few(df, ["k"], ["p"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
