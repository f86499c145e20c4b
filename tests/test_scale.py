"""Operators where a plan that is fine on few rows would not be on many, and cases beyond old bounds."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from kairoline.functions import colour as C
from kairoline.functions import timeexpr as X
from kairoline.operators import audio as A
from kairoline.operators import introspect as I
from kairoline.operators import params as P
from kairoline.operators import resolve as R
from kairoline.operators import timeline as T
from kairoline.streaming import signals
from kairoline.operators.shots import Config


def test_one_parameter_with_many_samples(spark):
    n = 100_000
    keys = spark.range(0, n, 10).select(F.lit(1).alias("param_id"), (F.col("id") * 2).alias("tick"), (F.col("id") * 3).cast("double").alias("value"), F.lit("linear").alias("easing"))
    at = spark.range(n).select(F.lit(1).alias("param_id"), (F.col("id") * 2 + 1).cast("double").alias("t"))
    start = time.time()
    # the values lie on one line, but for those after the last keyframe
    got = P.sample(keys, at).where(f"t <= {2 * (n - 10)} AND abs(value - 1.5 * t) > 1e-6").count()
    assert got == 0 and time.time() - start < 60


def test_one_medium_with_many_frames(spark):
    n = 100_000
    frames = spark.range(0, n).select(F.lit(1).alias("m"), (F.col("id") * 3).alias("pts"))
    wanted = spark.range(0, n).select(F.lit(1).alias("m"), (F.col("id") * 3 - 1).alias("t"))
    start = time.time()
    assert I.frame_at(wanted, frames, ["m"]).where("pts <> t + 1").count() == 0
    assert I.frame_before(wanted, frames, ["m"]).where("pts <> t - 2").count() == 0
    assert time.time() - start < 60


def test_one_medium_with_many_events(spark):
    events = spark.range(0, 60_000).select(F.lit(1).alias("k"), (F.col("id") * 4 + F.when(F.col("id") % 3 == 0, 2).otherwise(0)).cast("double").alias("at"), F.lit(1.0).alias("v"))
    kept, last = 0, -math.inf
    for i in range(60_000):
        if (at := i * 4 + (2 if i % 3 == 0 else 0)) - last >= 5:
            kept, last = kept + 1, at
    assert A.greedy_gate(events, "k", "at", 5.0, "v").count() == kept


def test_positions_equal_one_window(spark):
    df = spark.range(5000).select("id", (F.xxhash64("id") % 97).alias("tick"))
    got = [r.id for r in I.positions(df, F.col("tick"), ["tick", "id"]).orderBy("position").collect()]
    assert got == [r.id for r in df.orderBy("tick", "id").collect()]


def test_pages(spark):
    df = spark.range(30)
    assert [r.id for r in I.page(df, ["id"], 3).orderBy("id").collect()] == [24, 25, 26, 27, 28, 29]
    for bad in (0, 4):
        with pytest.raises(ValueError):
            I.page(df, ["id"], bad)
    assert I.page(df.limit(0), ["id"], 1).count() == 0


def test_first_free_lane_against_all_lanes(spark):
    clips = [(t, s, 4) for t in (1, 2, 3) for s in range(t * 3, 60, 7 + t)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(clips)], "clip_id long, track_id long, start_tick long, dur_tick long")
    tracks = spark.createDataFrame([(1, 5), (2, 0), (3, 2)], "track_id long, order_idx int")
    ticks = spark.range(70).select(F.col("id").alias("probe"), F.col("id").alias("t"))
    want = {}
    for t in range(70):
        free = [k for k in (2, 3, 1) if not any(c[0] == k and c[1] <= t < c[1] + c[2] for c in clips)]
        if free:
            want[t] = free[0]
    assert {r.probe: r.lane for r in T.first_free_lane(ticks, df, tracks, 8).collect()} == want and len(want) < 70


def test_equal_pixels_stay_rows_of_their_own(spark):
    table = spark.range(8).select(F.col("id").cast("int").alias("i"), (F.col("id") % 2).cast("double").alias("r"), (F.floor(F.col("id") / 2) % 2).cast("double").alias("g"), F.floor(F.col("id") / 4).cast("double").alias("b"))
    pixels = spark.createDataFrame([(1, 0.5, 0.25, 1.0)] * 2 + [(2, 0.0, 1.0, 0.75)], "m int, r double, g double, b double")
    out = C.lut_sample(pixels, table, 2)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, pixels.collect()))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
    with pytest.raises(ValueError):
        C.lut_sample(pixels, table, 66)


def test_gcd_of_large_numbers(spark):
    pairs = [(61305790721611591, 37889062373143906), (2**62, 2**40 * 3), (0, 7), (-12, 18), (7540113804746346429, 4660046610375530309)]
    got = spark.createDataFrame(pairs, "a long, b long").select(X.gcd(F.col("a"), F.col("b")).alias("g"), "a", "b").collect()
    assert all(r.g == math.gcd(r.a, r.b) for r in got)


def test_frames_that_come_too_early_are_refused_within_a_batch_too(spark, tmp_path):
    rows = [(1, 0.0, 0), (1, 2.0, 1), (1, 1.0, 2)]
    df = spark.createDataFrame([(m, t, t, 0.9, "visual", 0.0, n) for m, t, n in rows], "media_id int, t double, previous_t double, score float, kind string, start double, n int")
    df.write.parquet(f"{tmp_path}/in")
    for arrival, fails in (("n", True), ("t", False)):
        stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = signals.shot_boundaries(stream, Config(threshold=0.3, minimum_seconds=0.5), arrival).writeStream.format("memory").queryName(f"order_{arrival}").option("checkpointLocation", f"{tmp_path}/{arrival}").trigger(availableNow=True).start()
        if fails:
            with pytest.raises(Exception, match="after 2.0"):
                q.awaitTermination()
        else:
            q.awaitTermination()
            assert spark.table("order_t").count() == 2


def test_fractions_beyond_longs(spark):
    """products of keys beyond 5 million don't fit in longs, but their lowest terms do."""
    a, b = 2_971_215_073, 4_807_526_976  # neighbours in Fibonacci's sequence: the most steps
    pairs = [(36_000_000 * 720_720_000_017, 36_000_000**2 * 360_360), (a * 10**19, b * 10**19), (-(2**80), 2**81), (2**70, 0), (6, -4), (0, 0), (0, 7), (2**63 - 1, 1)]
    df = spark.createDataFrame([(str(n), str(d)) for n, d in pairs], "n string, d string").select(*(F.col(c).cast("decimal(38,0)").alias(c) for c in "nd"))
    got = df.select(X.reduced_products(F.col("n"), F.col("d")).alias("r"), "n", "d").collect()
    assert len(got) == len(pairs)
    for r in got:
        g = math.gcd(int(r.n), int(r.d)) or 1
        assert (r.r.num, r.r.den) == (int(r.n) // g, int(r.d) // g)
    assert dict(df.select(X.reduced_products(F.col("n"), F.col("d")).alias("r")).select("r.*").dtypes) == {"num": "bigint", "den": "bigint"}


def test_resampling_meets_blocks_not_samples(spark):
    """what meets the sound is spans; odd speeds, lacking frames and empty spans give what a loop gives."""
    sound = {1: [f * f % 97 / 7.0 for f in range(50)], 2: [None if f == 11 else -f / 3.0 for f in range(23)]}
    rows = [(m, f, 0, v) for m, vs in sound.items() for f, v in enumerate(vs) if (m, f) not in {(1, 15), (1, 16), (1, 31)}]
    spans = [(1, 1, 0, 30, 3, 2), (2, 1, 40, 20, -5, 3), (3, 2, 2, 40, 1, 4), (4, 1, 9, 5, 0, 1), (5, 2, 0, 0, 1, 1), (6, 1, 1, 6, 17, 2), (7, 2, 3, 25, 1, 1)]
    asked = spark.createDataFrame(spans, "span_id long, media_id int, first long, length long, num int, den int")
    pcm = spark.createDataFrame(rows, "media_id int, frame long, ch int, sample double")
    held = {(m, f): v for m, f, _, v in rows}
    want = {}
    for i, m, first, length, num, den in spans:
        for rel in range(length):
            low = math.floor(rel * num / den)
            if (m, first + low) in held:
                a = held[m, first + low]
                b = held.get((m, first + low + 1), a)
                want[i, rel] = None if a is None else a + ((a if b is None else b) - a) * (rel * num / den - low)
    for bucket in (8, 64):
        got = {(r.span_id, r.rel): r.value for r in A.resample(asked, pcm, bucket).collect()}
        assert got.keys() == want.keys() and all(got[k] == want[k] or abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = A.resample(asked, pcm, 8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("rel#") < plan.index("Join") and "rel#" not in plan[plan.index("Join") :]


def test_layers_are_counted_before_they_are_rows(spark):
    """F4, F7, F8: layers of overlapping clips and transitions against all pairs; a row is shuffled for each clip and block of ticks, not for each tick."""
    pick = random.Random(4)
    clips = [(i, pick.randrange(1, 6), pick.randrange(-70, 150), pick.choice((0, 1, 5, 40, 90))) for i in range(60)]
    clips += [(100 + i, 7, 10 * i, 10) for i in range(12)]
    cuts = [(100 + i, 101 + i, pick.randrange(1, 16)) for i in range(0, 11, 2)] + [(103, 104, 8)]
    lanes = [(1, 3, "video", True), (2, 1, "audio", True), (3, 1, "text", True), (4, 0, "video", False), (5, 1, "sticker", True), (7, 2, "video", True)]
    c = spark.createDataFrame(clips, "clip_id long, track_id long, start_tick long, dur_tick long")
    tracks = spark.createDataFrame(lanes, "track_id long, order_idx int, kind string, enabled boolean")
    transitions = spark.createDataFrame([(*x, "fade") for x in [(a, b, d) for a, b, d in cuts]], "left_id long, right_id long, duration long, name string")
    ends = {i: s + n for i, _, s, n in clips}
    asked = sorted({pick.randrange(-80, 260) for _ in range(120)})
    for given in (None, transitions):
        want = []
        for t in asked:
            found = []
            for k, place, kind, on in lanes:
                if not on or kind == "audio":
                    continue
                plain = sorted((s, i) for i, lane, s, n in clips if lane == k and s <= t < s + n)
                windows = sorted((ends[a], a, b, d) for a, b, d in cuts if k == 7 and 0 <= t - (ends[a] - d // 2) < d) if given is not None else []
                if windows:
                    cut, a, b, d = windows[0]
                    found.append((place, k, a, b, (t - (cut - d // 2)) / d))
                elif plain:
                    found.append((place, k, plain[0][1], None, None))
            want += [(t, n, *f[1:]) for n, f in enumerate(sorted(found, key=lambda f: f[:2]))]
        for kind in ("long", "double"):
            ticks = spark.createDataFrame([(t,) for t in asked] * 2, "t long").select(F.col("t").cast(kind))
            assert sorted(map(str, map(tuple, R.layers(ticks.withColumn("t", F.col("t")), c, tracks, given).select(F.col("t").cast("long"), "layer", "track_id", "clip_id", "other_id", "progress").collect()))) == sorted(map(str, want))
        one = spark.createDataFrame([(t, 3) for t in asked], "t long, track_id long")
        assert sorted((r.t, r.layer, r.clip_id) for r in R.layers(one, c, tracks, given).collect()) == sorted((w[0], 0, w[3]) for w in want if w[2] == 3)
    ticks = spark.range(9000).select(F.col("id").alias("t"))
    plan = R.layers(ticks, c, tracks)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(t#" not in plan and plan.index("posexplode") < plan.index("Window")
    beside = R.ticks_of_clip(ticks, c, 101).collect()
    assert sorted(r.t for r in beside) == list(range(10, 20))
