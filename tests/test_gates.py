"""Greedy gates and running means against plain folds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kairoline.operators import gates as G
from kairoline.operators import introspect as I


def fold(rows, least):
    kept = []
    by_key = {}
    for k, t, v in rows:
        if t is not None and math.isfinite(t):
            by_key.setdefault(k, []).append((t, (v is None, v or 0), v))
    for k, own in by_key.items():
        last = -math.inf
        for t, _, v in sorted(own, key=lambda x: x[:2]):
            if t - last >= least:
                kept.append((k, t, v))
                last = t
    return kept


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0))


SCHEMA = "k long, at double, v double"


def made(seed):
    """Dense, sparse and uneven keys, ties, events exactly one distance apart, negative times."""
    rng = random.Random(seed)
    rows = []
    for k in range(6):
        t = rng.uniform(-2000, 2000)
        for _ in range(rng.choice([1, 30, 900])):
            t += rng.choice([0, 0.1, 0.25, 1.0, 2.5, 2.5, rng.random(), rng.choice([0.3, 40, 900, 20_000])])
            rows.append((k if k else None, t, rng.choice([None, 1.0, 2.0, 3.0])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "levels"), [(1, 0), (2, 1), (3, 2), (4, 1)])
def test_gate_equals_the_fold(spark, monkeypatch, seed, levels):
    monkeypatch.setattr(G, "SPAN", 16)
    rows = made(seed)
    got = G.greedy_gate(spark.createDataFrame(rows, SCHEMA), "k", "at", 2.5, "v", levels)
    assert got.columns == ["k", "at", "v"]
    assert ordered(got.collect()) == ordered(fold(rows, 2.5))


def test_odd_events(spark):
    rows = [(1, None, 1.0), (1, math.nan, 1.0), (1, math.inf, 1.0), (1, -math.inf, 1.0), (1, 5.0, None), (1, 5.0, 7.0), (1, 5.0, 7.0), (2, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert ordered(G.greedy_gate(df, "k", "at", 1.0, "v").collect()) == [(1, 5.0, 7.0)]
    assert ordered(G.greedy_gate(df, "k", "at", 0.0, "v").collect()) == [(1, 5.0, 7.0), (1, 5.0, 7.0), (1, 5.0, None)]
    assert G.greedy_gate(df.limit(0), "k", "at", 1.0, "v").count() == 0
    words = df.select(F.concat(F.lit("medium "), "k").alias("at"), F.col("at").alias("k"), F.struct("v", F.lit("x").alias("k")).alias("cell"), F.lit(1).alias("exit"))
    assert [tuple(r) for r in G.greedy_gate(words.where("cell.v = 7"), "at", "k", 1.0, "cell").collect()] == [("medium 1", 5.0, (7.0, "x"))]


def test_a_dense_medium_is_many_groups(spark):
    """A million events without a gap; every fourth one is kept, from the first on."""
    n = 1_000_000
    events = spark.range(0, n, 1, 8).select(F.lit(1).alias("k"), (F.col("id") * 3).cast("double").alias("at"), F.col("id").cast("double").alias("v"))
    got = G.greedy_gate(events, "k", "at", 10.0, "v")
    assert got.where("v % 4 <> 0").count() == 0 and got.count() == n // 4


def test_a_group_longer_than_a_batch(spark):
    """Thirty thousand events in one cell, which Arrow hands over in several batches."""
    rows = [(1, i / 1000, float(i)) for i in range(30_000)] + [(2, 0.0, 0.0)]
    got = G.greedy_gate(spark.createDataFrame(rows, SCHEMA), "k", "at", 1.0, "v")
    assert ordered(got.collect()) == ordered(fold(rows, 1.0))


def folded(values, alpha):
    m = values[0]
    for v in values[1:]:
        m = m + alpha * (v - m)
    return m


def test_running_mean_of_a_hot_key(spark):
    """One key of 200,000 values, in many runs and parts, among small ones; a small key's mean is the fold to the last bit."""
    n = 200_000
    hot = spark.range(0, n, 1, 8).select(F.lit("hot").alias("k"), (F.col("id") * 7919 % n).alias("o"), (F.col("id") * 7919 % n % 101 / 7).alias("v"))
    small = [("a", 2, 0.3), ("a", 1, 0.1), ("a", 2, 0.2), ("b", 5, 4.0), (None, 1, 2.0), (None, 2, 3.0), ("a", 3, None), ("c", 1, None)]
    df = hot.unionByName(spark.createDataFrame(small, "k string, o long, v double"))
    for alpha in (0.3, 0.0001):
        got = {r.k: r.mean for r in I.moving_cost(df, ["k"], "o", "v", alpha).collect()}
        assert got.pop("hot") == pytest.approx(folded([i % 101 / 7 for i in range(n)], alpha), rel=1e-12)
        assert got == {"a": folded([0.1, 0.2, 0.3], alpha), "b": 4.0, None: folded([2.0, 3.0], alpha)}
