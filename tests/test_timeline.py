import random

import pytest
from pyspark.sql import functions as F

from kairoline.functions import timeexpr as X
from kairoline.operators import timeline as T
from kairoline.operators.intervals import interval_join, stab_join

KIND = "clip_id long, track_id long, start_tick long, dur_tick long, link long"


def clips(spark, *rows):
    return spark.createDataFrame([(*r, None) if len(r) == 4 else r for r in rows], KIND)


def starts(df):
    return {r.clip_id: r.start_tick for r in df.collect()}


def test_shift_undo_redo(spark):
    h = T.History(clips(spark, (1, 1, 0, 50), (2, 1, 50, 30)))
    h.apply(T.shift, 1, 50, 40)
    assert starts(h.table) == {1: 0, 2: 90}
    assert h.undo() and starts(h.table) == {1: 0, 2: 50} and not h.undo()
    assert h.redo() and starts(h.table) == {1: 0, 2: 90} and not h.redo()
    h.undo()
    h.apply(T.shift, 1, 50, 10)
    assert not h.redo() and starts(h.table) == {1: 0, 2: 60}


def test_groups_are_one_edit_and_roll_back(spark):
    h = T.History(clips(spark, (1, 1, 0, 50), (2, 1, 50, 30)))
    h.begin()
    h.apply(T.shift, 1, 50, 40)
    h.apply(T.shift, 1, 90, 10)
    h.commit()
    assert starts(h.table) == {1: 0, 2: 100} and h.undo() and starts(h.table) == {1: 0, 2: 50}
    h.begin()
    h.apply(T.shift, 1, 50, 40)
    h.rollback()
    assert starts(h.table) == {1: 0, 2: 50}


def test_forbidden_shifts(spark):
    c = clips(spark, (1, 1, 0, 50), (2, 1, 50, 30))
    for args in ((1, 50, -1), (1, 0, -5), (1, 50, 0)):
        with pytest.raises(T.EditError):
            T.shift(c, *args)
    assert starts(T.shift(c, 1, 99, -50)) == {1: 0, 2: 50}


def test_ripples(spark):
    c = clips(spark, (1, 1, 0, 10), (2, 1, 10, 5), (3, 1, 20, 5), (4, 2, 0, 9))
    gone = spark.createDataFrame([(2,)], "clip_id long")
    assert starts(T.ripple_delete(c, gone)) == {1: 0, 3: 15, 4: 0}
    assert starts(T.ripple_insert(c, 1, 10, clips(spark, (9, 1, 10, 7)))) == {1: 0, 9: 10, 2: 17, 3: 27, 4: 0}
    with pytest.raises(T.EditError):
        T.ripple_insert(c, 1, 3, clips(spark, (9, 1, 3, 7)))


def test_split_keeps_the_whole(spark):
    rng = random.Random(1)
    c = clips(spark, *((i, 1, i * 20, 20) for i in range(30)))
    cuts = spark.createDataFrame([(i, i * 20 + rng.randint(0, 20)) for i in range(30)], "clip_id long, cut long")
    out = T.split(c, cuts, 1000)
    assert out.agg(F.sum("dur_tick")).first()[0] == 600 and T.overlapping(out).count() == 0
    assert out.where("dur_tick < 1").count() == 0 and out.select("clip_id").distinct().count() == out.count()


def test_links(spark):
    c = clips(spark, (1, 1, 0, 1, 5), (2, 2, 0, 1, 5), (3, 1, 2, 1, 6), (4, 1, 9, 1, None))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "clip_id long")
    assert {r.clip_id: r.link for r in T.link(c, ids(3, 4), 9).collect()} == {1: 5, 2: 5, 3: 9, 4: 9}
    assert {r.clip_id: r.link for r in T.unlink(c, ids(1, 4)).collect()} == {1: None, 2: None, 3: 6, 4: None}


def test_interval_joins_match_brute_force(spark):
    rng = random.Random(2)
    a = [(i, rng.randint(0, 2), rng.randint(-50, 300), rng.randint(0, 60)) for i in range(80)]
    b = [(i, rng.randint(0, 2), rng.randint(-50, 300), rng.randint(0, 200)) for i in range(60)]
    x, y = spark.createDataFrame(a, "i int, k int, s long, n long"), spark.createDataFrame(b, "j int, k int, t long, m long")
    want = {(i, j) for i, k, s, n in a for j, q, t, m in b if k == q and n > 0 and m > 0 and s < t + m and t < s + n}
    for width in (1, 17, 500):
        rows = interval_join(x, y, ["k"], ("s", "n"), ("t", "m"), width).collect()
        assert len(rows) == len(want) and {(r.i, r.j) for r in rows} == want
        stabs = stab_join(x, y, ["k"], "s", ("t", "m"), width).collect()
        assert sorted((r.i, r.j) for r in stabs) == sorted((i, j) for i, k, s, _ in a for j, q, t, m in b if k == q and t <= s < t + m)
    semi = interval_join(x, y, ["k"], ("s", "n"), ("t", "m"), 17, "left_anti")
    assert {r.i for r in semi.collect()} == {r[0] for r in a} - {i for i, _ in want}


def test_sample_clock(spark):
    got = spark.range(1).select(*(X.ticks_to_samples(F.lit(v).cast("long"), n, d).alias(str(i)) for i, (v, n, d) in enumerate([(24, 24, 1), (1, 24, 1), (30000, 30000, 1001)]))).first()
    assert tuple(got) == (48000, 2000, 1001 * 48000)


def test_timecode(spark):
    rows = {0: "00:00:00;00", 1799: "00:00:59;29", 1800: "00:01:00;02", 17982: "00:10:00;00", 107892: "01:00:00;00"}
    got = spark.createDataFrame([(f,) for f in rows], "f long").select("f", X.timecode(F.col("f"), 30000, 1001, True).alias("t")).collect()
    assert {r.f: r.t for r in got} == rows


def test_resample_rounds_half_away(spark):
    got = spark.createDataFrame([(1,), (-1,), (3,), (-3,), (2,)], "v long").select("v", X.resample(F.col("v"), F.lit(2), F.lit(1), F.lit(1), F.lit(1)).alias("r")).collect()
    assert {r.v: r.r for r in got} == {1: 1, -1: -1, 3: 2, -3: -2, 2: 1}
