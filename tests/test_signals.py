import math
import random

import pytest
from pyspark.sql import functions as F

from kairoline.operators import audio as A
from kairoline.operators import shots as S
from kairoline.streaming import signals


def pcm(spark, samples):
    return spark.createDataFrame([(1, i, 0, float(s)) for i, s in enumerate(samples)], "media_id int, frame long, ch int, sample float")


def spans(df):
    return [(r.start_seconds, r.end_seconds) for r in df.orderBy("start_seconds").collect()]


def test_gaps_merge_before_short_spans_go(spark):
    p = pcm(spark, [0.5] * 200 + [0] * 200 + [0.5] * 20 + [0] * 200 + [0.5] * 200)
    config = lambda gap: A.Silence(A.Loudness(0.01, 0.01, -100), -40, 0.3, gap, 2)
    assert spans(A.detect_silence(p, config(0.0), 1000)) == []
    assert spans(A.detect_silence(p, config(0.05), 1000)) == [(0.2, 0.62)]


def test_hysteresis(spark):
    p = pcm(spark, [10 ** (db / 20) for db in (-20, -60, -48, -40) for _ in range(100)])
    assert spans(A.detect_silence(p, A.Silence(A.Loudness(0.1, 0.1, -120), -50, 0, 0, 5), 1000)) == [(0.1, 0.3)]


def test_pulse_train(spark):
    at = [0.25 + 0.5 * k for k in range(6)]
    p = pcm(spark, [1.0 if any(a <= i / 1000 < a + 0.02 for a in at) else 0.0 for i in range(3000)])
    got = [r.time_seconds for r in A.detect_beats(p, A.Beats(A.Loudness(0.02, 0.01)), 1000).orderBy("time_seconds").collect()]
    assert len(got) == 6 and all(abs(a - b) <= 0.03 for a, b in zip(got, at, strict=True))


def test_refractory(spark):
    p = pcm(spark, [1.0 if any(a <= i / 1000 < a + 0.01 for a in (0.20, 0.25, 0.50)) else 0.0 for i in range(800)])
    got = [r.time_seconds for r in A.detect_beats(p, A.Beats(A.Loudness(0.01, 0.005), refractory_seconds=0.10), 1000).orderBy("time_seconds").collect()]
    assert len(got) == 2 and abs(got[0] - 0.2) <= 0.02 and abs(got[1] - 0.5) <= 0.02


def test_constant_sound_has_no_beats(spark):
    assert A.detect_beats(pcm(spark, [0.4] * 2000), A.Beats(), 4800).count() == 0


def test_window_grid(spark):
    got = A.energy_windows(pcm(spark, [1.0] * 11), A.Loudness(0.3, 0.2), 10).orderBy("win").collect()
    assert [(r.start_frame, r.end_frame, r.full) for r in got] == [(0, 3, True), (2, 5, True), (4, 7, True), (6, 9, True), (8, 11, True), (10, 11, False)]


def frames(spark, pictures):
    rows = [(1, float(t), x, y, v, v, v, 255) for t, picture in pictures for y, line in enumerate(picture) for x, v in enumerate(line)]
    return spark.createDataFrame(rows, "media_id int, t double, x int, y int, r int, g int, b int, a int")


def board(turn, size=8):
    return [[255 if (x + y + turn) % 2 else 0 for x in range(size)] for y in range(size)]


def test_shots(spark):
    got = S.detect_shots(frames(spark, [(0, board(0)), (0.5, board(0)), (1.0, board(1)), (1.5, board(1))]), S.Config()).collect()
    assert [(r.t, r.previous_t) for r in got] == [(1.0, 0.5)]
    ramp = frames(spark, [(k / 4, [[31 * k] * 8] * 8) for k in range(9)])
    assert S.detect_shots(ramp, S.Config(minimum_seconds=0.0)).count() == 0
    flips = frames(spark, [(0.0, board(0)), (0.1, board(1)), (0.6, board(0))])
    assert [(r.t, r.previous_t) for r in S.detect_shots(flips, S.Config(threshold=0.30)).collect()] == [(0.6, 0.1)]
    sizes = frames(spark, [(0.0, board(0)), (1.0, board(0, 4))])
    assert [(r.t, r.score, r.kind) for r in S.detect_shots(sizes, S.Config()).collect()] == [(1.0, 1.0, "dimension")]


def test_sample_grid(spark):
    got = spark.range(4).select(S.sample_coordinate(F.col("id"), F.lit(8), F.lit(4)).alias("c")).collect()
    assert [r.c for r in got] == [1, 3, 5, 7]


def test_every_part_has_its_middle(spark):
    sizes = spark.range(1, 41).select(F.col("id").alias("w")).crossJoin(spark.range(1, 41).select(F.col("id").alias("n"))).where("n <= w")
    hits = sizes.select("w", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("x")).where(S.is_middle(F.col("x"), F.col("w"), F.col("n")))
    got = {(r.w, r.n): r.xs for r in hits.groupBy("w", "n").agg(F.array_sort(F.collect_list("x")).alias("xs")).collect()}
    assert got == {(w, n): [(2 * i + 1) * w // (2 * n) for i in range(n)] for w in range(1, 41) for n in range(1, w + 1)}


def test_stream_equals_batch(spark, tmp_path):
    pictures = [(k * 0.4, board(k // 2 % 2)) for k in range(12)]
    config = S.Config(threshold=0.3, minimum_seconds=0.9)
    scored = S.scores(S.features(frames(spark, pictures), config), config).withColumn("start", F.lit(0.0))
    for low, high in ((0.0, 1.7), (1.7, 3.3), (3.3, 99.0)):
        scored.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(scored.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    q = signals.shot_boundaries(stream, config).writeStream.format("memory").queryName("cuts").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    want = [r.t for r in S.detect_shots(frames(spark, pictures), config).orderBy("t").collect()]
    assert [r.t for r in spark.table("cuts").orderBy("t").collect()] == want and len(want) > 1


def films(seed, size=9):
    """Two media of random frames: stills, drifts of brightness, cuts, changes of size, and a flash."""
    rng, rows = random.Random(seed), []
    for m in (1, 2):
        t, w, h = 0.0, size, size - 2
        still = [rng.randrange(256) for _ in range(w * h * 4)]
        for _ in range(14):
            what = rng.choice(["same", "drift", "cut", "cut", "size"])
            if what == "size":
                w, h = rng.randrange(1, 2 * size), rng.randrange(1, 2 * size)
            if what in ("cut", "size"):
                still = [rng.randrange(256) for _ in range(w * h * 4)]
            if what == "drift":
                still = [min(255, x + 9) for x in still]
            t += rng.choice([0.1, 0.25, 0.6])
            rows.append((m, t, w, h, bytearray(still)))
    return rows


FRAME = "media_id int, t double, width int, height int, rgba binary"


def test_frames_in_a_stream_equal_the_table(spark, tmp_path):
    """Pictures themselves come in, in micro-batches of any cut; the query is stopped and started from its checkpoint."""
    config = S.Config(columns=6, rows=5, bins=16, threshold=0.2, minimum_seconds=0.5)
    rows = films(5)
    pixels = [(m, t, x, y, *d[(y * w + x) * 4 : (y * w + x) * 4 + 4]) for m, t, w, h, d in rows for y in range(h) for x in range(w)]
    table = spark.createDataFrame(pixels, "media_id int, t double, x int, y int, r int, g int, b int, a int")
    frames_ = spark.createDataFrame(rows, FRAME)
    key = lambda r: (r.media_id, r.t)
    plain = {key(r): (r.n, r.luma_sum, list(r.hist), b"".join(bytes(p[2:]) for p in r.sampled)) for r in S.features(table, config).collect()}
    assert {key(r): (r.n, r.luma_sum, r.hist, bytes(r.sampled)) for r in signals.frame_features(frames_, config).collect()} == plain
    want = sorted(map(tuple, S.detect_shots(table, config).collect()))
    assert len(want) > 3 and len(want) < 20
    for name, edges in (("one", [0, 99]), ("many", [0, 0.3, 0.31, 1.2, 1.9, 2.0, 3.3, 99])):
        base = tmp_path / name
        for low, high in zip(edges, edges[1:], strict=False):
            # every part is a query of its own, from the checkpoint of the one before
            frames_.where((F.col("t") >= low) & (F.col("t") < high)).coalesce(1).write.mode("append").parquet(f"{base}/in")
            cuts = signals.shots_of_frames(spark.readStream.schema(FRAME).parquet(f"{base}/in"), config)
            cuts.writeStream.format("parquet").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
        assert sorted(map(tuple, spark.read.parquet(f"{base}/out").collect())) == want


def test_frames_that_are_wrong(spark, tmp_path):
    black = bytearray(16)
    odd = [(1, None, 2, 2, black), (1, 1.0, None, 2, black), (1, 1.0, 0, 2, black), (1, 1.0, 2, 2, None), (None, 2.0, 2, 2, black)]
    got = signals.frame_features(spark.createDataFrame(odd, FRAME), S.Config()).collect()
    assert [(r.media_id, r.t, r.n, r.luma_sum) for r in got] == [(None, 2.0, 4, 0)]
    with pytest.raises(Exception, match="16 bytes for a frame of 3 by 2"):
        signals.frame_features(spark.createDataFrame([(1, 1.0, 3, 2, black)], FRAME), S.Config()).collect()


def test_stream_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, df in (("w", signals.windowed(stream(), "1 day")), ("s", signals.sessions(stream(), "2 hours"))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "s" else "complete").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert spark.table("w").agg(F.sum("n")).first()[0] == events.count()
    assert 0 < spark.table("s").agg(F.sum("n")).first()[0] <= events.count()


def test_pan(spark):
    left, right = A.pan_gains(F.col("p"))
    got = spark.createDataFrame([(-1.0,), (0.0,), (1.0,)], "p double").select(left.alias("l"), right.alias("r")).collect()
    for r, want in zip(got, [(math.sqrt(2), 0.0), (1.0, 1.0), (0.0, math.sqrt(2))], strict=True):
        assert r.l == pytest.approx(want[0], abs=1e-9) and r.r == pytest.approx(want[1], abs=1e-9)


def test_requests_are_coalesced_but_edits_stay(spark, tmp_path):
    schema = "who string, n int, edit boolean"
    spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 4, True), ("b", 5, True), ("c", 6, None)], schema).coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    sink = lambda df, number: got.extend((number, r.who, r.n) for r in df.collect())
    signals.coalesced(stream, ["who"], "n", sink, str(tmp_path / "state"), F.col("edit")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == [(0, "a", 2), (0, "a", 3), (0, "b", 4), (0, "b", 5), (0, "c", 6)]
