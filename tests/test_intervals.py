import random

import pytest

from kairoline.operators.intervals import _stored, interval_join, stab_join


def spread(rng, n, keys):
    return [(rng.randrange(keys), rng.randrange(-(10**6), 10**7), int(10 ** rng.uniform(0, 7)) if rng.random() > 0.05 else 0) for _ in range(n)]


@pytest.mark.parametrize("width", [1, 64, 1000])
def test_lengths_of_any_spread(spark, width):
    rng = random.Random(width)
    a, b = spread(rng, 400, 3), spread(rng, 300, 3)
    left = spark.createDataFrame([(*r, i) for i, r in enumerate(a)], "k int, s long, n long, left_id int")
    right = spark.createDataFrame([(*r, i) for i, r in enumerate(b)], "k int, s2 long, n2 long, right_id int")
    want = sorted((i, j) for i, (k, s, n) in enumerate(a) for j, (k2, s2, n2) in enumerate(b) if k == k2 and n and n2 and s < s2 + n2 and s2 < s + n)
    span, span2 = ("s", "n"), ("s2", "n2")
    got = interval_join(left, right, ["k"], span, span2, width)
    assert sorted((r.left_id, r.right_id) for r in got.select("left_id", "right_id").collect()) == want and len(want) > 1000
    met = {i for i, _ in want}
    assert {r.left_id for r in interval_join(left, right, ["k"], span, span2, width, "left_semi").collect()} == met
    assert {r.left_id for r in interval_join(left, right, ["k"], span, span2, width, "left_anti").collect()} == set(range(len(a))) - met
    points = spark.createDataFrame([(k, s + n // 2, i) for i, (k, s, n) in enumerate(b)], "k int, at long, point int")
    held = sorted((p, i) for p, (k2, s2, n2) in enumerate(b) for i, (k, s, n) in enumerate(a) if k == k2 and s <= s2 + n2 // 2 < s + n)
    for widest in (None, 1 << 21):
        assert sorted((r.point, r.left_id) for r in stab_join(points, left, ["k"], "at", span, width, widest).collect()) == held


def test_an_interval_is_stored_twice_at_most(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(s, n, i) for i, (_, s, n) in enumerate(spread(rng, 2000, 1)) if n], "s long, n long, i int")
    for width in (1, 64):
        assert max(r["count"] for r in _stored(df, ("s", "n"), width).groupBy("i").count().collect()) <= 2
