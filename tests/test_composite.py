import math
import os
import random
import struct
import time
import zlib
from dataclasses import fields

import numpy as np
import pytest
from pyspark.sql import functions as F

from kairoline.functions import colour as C
from kairoline.jobs import Jobs
from kairoline.operators import audio
from kairoline.operators import composite as X
from kairoline.sources import frames as S
from kairoline.sources.media import encode_png

NAMES = [f.name for f in fields(C.Grade)]


def grade_of(rng, share=0.7):
    return {n: round(rng.uniform(-1, 1), 3) if rng.random() < share else 0.0 for n in NAMES}


def test_graded_is_grade_pixels(spark):
    rng = random.Random(3)
    rows = [(rng.random(), rng.random(), rng.random()) for _ in range(40)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    for _ in range(4):
        grade = grade_of(rng)
        want = C.grade_pixels(df, C.Grade(**grade)).collect()
        g = F.struct(*(F.lit(grade[n]).alias(n) for n in NAMES))
        got = df.select(X.graded(F.struct("r", "g", "b"), g).alias("c")).select("c.*").collect()
        assert all(math.isclose(x, y, abs_tol=1e-9) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True))


BLEND = {"normal": lambda b, s: s, "multiply": lambda b, s: b * s, "difference": lambda b, s: abs(b - s), "add": lambda b, s: min(1, b + s)}


def brute(items, start):
    r, g, b, a = start[0] * start[3], start[1] * start[3], start[2] * start[3], start[3]
    for _, mode, *top in sorted(items, key=lambda i: (i[0], i[1] == "pass")):
        back = [c / a if a > 0 else 0 for c in (r, g, b)]
        if mode == "pass":
            e, br, ct, st = top
            one = [(c * 2 ** (2 * e) + 0.25 * br - 0.5) * (1 + ct) + 0.5 for c in back]
            grey = 0.2126 * one[0] + 0.7152 * one[1] + 0.0722 * one[2]
            r, g, b = (max(0, min(1, grey + (c - grey) * (1 + st))) * a for c in one)
        else:
            s, sa = top[:3], top[3]
            r, g, b = (((1 - a) * s[k] + a * BLEND.get(mode, BLEND["normal"])(back[k], s[k])) * sa + back[k] * a * (1 - sa) for k in range(3))
            a = sa + a * (1 - sa)
    return [c / a if a > 0 else 0 for c in (r, g, b)] + [a]


def test_layers_and_passes_fold_in_order(spark):
    rng = random.Random(1)
    layers, passes, items = [], [], {}
    for frame in range(4):
        for layer in range(rng.randint(0, 9)):
            if rng.random() < 0.3:
                v = [round(rng.uniform(-0.5, 0.5), 3) for _ in range(4)]
                passes.append((frame, layer, dict(zip(NAMES, [0.0] * 9, strict=True)) | dict(zip(("exposure", "brightness", "contrast", "saturation"), v, strict=True))))
                for p in range(6):
                    items.setdefault((frame, p % 3, p // 3), []).append((layer, "pass", *v))
            for p in rng.sample(range(6), 4):
                mode = rng.choice(["normal", "multiply", "difference", "add", "unknown", None])
                c = [rng.random() for _ in range(4)]
                layers.append((frame, layer, p % 3, p // 3, *c, mode))
                items.setdefault((frame, p % 3, p // 3), []).append((layer, mode, *c))
    layers += [(0, 0, 5, 0, 1.0, 1.0, 1.0, 1.0, "normal"), (77, 0, 1, 1, 1.0, 1.0, 1.0, 1.0, "normal")][:1]
    kind = "struct<" + ",".join(f"{n}:double" for n in NAMES) + ">"
    df = spark.createDataFrame(layers, "frame long, layer int, x int, y int, r double, g double, b double, a double, mode string").repartition(3)
    ps = spark.createDataFrame(passes, f"frame long, layer int, grade {kind}")
    for start in ((0.0, 0.0, 0.0, 1.0), (0.4, 0.2, 0.1, 0.0), (0.4, 0.2, 0.1, 0.5)):
        got = X.composited(spark.range(4).withColumnRenamed("id", "frame"), df, (3, 2), ps, start, ("multiply", "difference", "add")).collect()
        assert len(got) == 24
        for row in got:
            want = brute(items.get((row.frame, row.x, row.y), []), start)
            assert all(math.isclose(p, q, abs_tol=1e-9) for p, q in zip((row.r, row.g, row.b, row.a), want, strict=True)), (row, want)


def scene_rows(spark, rows):
    point = lambda a, b, n: F.struct(F.col(a).alias(n[0]), F.col(b).alias(n[1]))
    df = spark.createDataFrame(rows, "frame long, layer int, media_id int, t double, width int, height int, cx double, cy double, ax double, ay double, w double, h double, rot double, opacity double")
    scene = F.struct(point("cx", "cy", "xy").alias("center"), point("ax", "ay", "xy").alias("anchor"), point("w", "h", "wh").alias("size"), F.col("rot").alias("rotation"), F.col("opacity").alias("opacity"))
    return df.select("frame", "layer", "media_id", "t", F.col("t").alias("source_t"), "width", "height", scene.alias("scene"))


def test_drawing_turned_and_scaled_layers(spark):
    rng = random.Random(9)
    source = {(x, y): [rng.randrange(256) for _ in range(4)] for x in range(5) for y in range(4)}
    pixels = spark.createDataFrame([(1, 0.0, x, y, *c) for (x, y), c in source.items()], "media_id int, t double, x int, y int, r int, g int, b int, a int")
    rows = [(k, 0, 1, 0.0, 5, 4, rng.uniform(-2, 12), rng.uniform(-2, 10), rng.random(), rng.random(), rng.choice([0.0, rng.uniform(0.5, 15)]), rng.uniform(0.5, 15), rng.uniform(-4, 4), rng.random()) for k in range(30)]
    got = {(r.frame, r.x, r.y): (r.r, r.g, r.b, r.a) for r in X.drawn(scene_rows(spark, rows), pixels, (11, 8)).collect()}
    want = {}
    for k, _, _, _, w0, h0, cx, cy, ax, ay, w, h, rot, opacity in rows:
        for x in range(11):
            for y in range(8):
                dx, dy = x + 0.5 - cx, y + 0.5 - cy
                u, v = ((math.cos(rot) * dx + math.sin(rot) * dy) / w + ax, (math.cos(rot) * dy - math.sin(rot) * dx) / h + ay) if w > 0 else (-1, -1)
                if 0 <= u < 1 and 0 <= v < 1:
                    c = source[int(u * w0), int(v * h0)]
                    want[k, x, y] = (c[0] / 255, c[1] / 255, c[2] / 255, c[3] / 255 * opacity)
    assert got.keys() == want.keys() and len(want) > 100
    assert all(math.isclose(p, q, abs_tol=1e-12) for k in want for p, q in zip(got[k], want[k], strict=True))


def test_motion_blur_thins_what_moves(spark):
    pixels = spark.createDataFrame([(1, 0.0, 0, 0, 255, 0, 0, 255)], "media_id int, t double, x int, y int, r int, g int, b int, a int")
    shown = scene_rows(spark, [(0, 0, 1, 0.0, 1, 1, 1.0, 0.5, 0.5, 0.5, 2.0, 1.0, 0.0, 1.0)])
    moved = lambda s: s.withColumn("scene", F.col("scene").withField("center.x", 1.0 + 4 * (F.col("moment") + 0.5)))
    out = {r.x: r.a for r in X.averaged(X.drawn(X.motion_scenes(shown, moved, 360.0, 5), pixels, (8, 1)), 5).collect()}
    assert out == pytest.approx({0: 0.2, 1: 0.4, 2: 0.4, 3: 0.4, 4: 0.4, 5: 0.2})


@pytest.mark.parametrize("rate", [(30, 1), (30000, 1001), (24000, 1001), (7, 3)])
def test_blocks_of_sound_leave_no_gap(spark, rate):
    clips = spark.createDataFrame([(0, 900)], "start_tick long, dur_tick long")
    plan = X.export_plan(clips, (30, 1), rate).orderBy("frame").collect()
    assert [p.frame for p in plan] == list(range(math.floor(900 * rate[0] / (30 * rate[1]) + 0.5)))
    assert plan[0].from_sample == 0 and all(a.to_sample == b.from_sample for a, b in zip(plan, plan[1:], strict=False))
    asked = spark.range(0, 200_000, 7).select("id", X.frame_of_sample(F.col("id"), rate).alias("f")).collect()
    assert all(plan[r.f].from_sample <= r.id < plan[r.f].to_sample for r in asked if r.f < len(plan))
    assert X.export_plan(clips.limit(0), (30, 1)).count() == 0


@pytest.fixture(scope="module")
def exported(spark):
    S.register(spark)
    clips = spark.createDataFrame([(0, 4)], "start_tick long, dur_tick long")
    plan = X.export_plan(clips, (30000, 1001))
    layers = spark.range(4).select(F.col("id").alias("frame"), F.lit(0).alias("layer"), (F.col("id") % 3).alias("x"), F.lit(1).alias("y"), F.lit(1.0).alias("r"), F.lit(0.5).alias("g"), F.lit(0.25).alias("b"), F.lit(1.0).alias("a"))
    spans = spark.createDataFrame([(1, 1700, 0, 40, 1.0, 0.0, 0, 0)], "media_id int, at long, first long, length long, volume double, pan double, fade_in long, fade_out long")
    pcm = spark.range(40).select(F.lit(1).alias("media_id"), F.col("id").alias("frame"), F.lit(0).alias("ch"), F.lit(0.5).alias("sample"))
    done = X.composited(plan.select("frame"), layers, (3, 2))
    return X.export_frames(plan, done, (3, 2), audio.mix(spans, pcm), (30000, 1001))


def left_over(path):
    return [n for n in os.listdir(os.path.dirname(path)) if "staging" in n]


def test_export_and_back(spark, exported, tmp_path):
    path = f"{tmp_path}/out"
    exported.repartition(3).write.format("frame_folder").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == sorted(f"frame_{k:05d}.{kind}" for k in range(4) for kind in ("png", "f32")) and not left_over(path)
    back = spark.read.format("frame_folder").load(path).orderBy("frame").collect()
    for k, row in enumerate(back):
        picture = np.frombuffer(row.rgba, np.uint8).reshape(2, 3, 4)
        want = np.zeros((2, 3, 4), np.uint8)
        want[..., 3] = 255
        want[1, k % 3, :3] = (255, 128, 64)
        assert (row.frame, row.width, row.height) == (k, 3, 2) and (picture == want).all()
    sound = np.concatenate([np.frombuffer(r.sound, np.float32).reshape(-1, 2) for r in back])
    assert len(sound) == 4 * 48000 * 1001 // 30000
    heard = np.flatnonzero(sound[:, 0])
    assert heard.tolist() == list(range(1700, 1740)) and np.allclose(sound[heard], 0.5)
    with pytest.raises(Exception, match="isn't empty"):
        exported.write.format("frame_folder").mode("append").save(path)
    assert len(os.listdir(path)) == 8 and not left_over(path)
    exported.where("frame < 2").drop("sound").write.format("frame_folder").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == ["frame_00000.png", "frame_00001.png"] and not left_over(path)


def test_nothing_shows_of_a_failed_export(spark, exported, tmp_path):
    path = f"{tmp_path}/out"
    bad = exported.repartition(4).withColumn("rgba", F.when(F.col("frame") == 3, F.lit(b"short")).otherwise(F.col("rgba")))
    for df, why in ((bad, "reshape"), (exported.union(exported).repartition(5), "twice"), (exported.drop("width"), "lack")):
        with pytest.raises(Exception, match=why):
            df.write.format("frame_folder").mode("append").save(path)
        assert not os.path.exists(path) and not left_over(path)


def test_a_cancelled_export(spark, exported, tmp_path):
    path = f"{tmp_path}/out"

    @F.udf("long")
    def slow(frame):
        time.sleep(0.2)
        return frame

    one = spark.createDataFrame(exported.limit(1).collect(), exported.schema).drop("frame")
    many = spark.range(0, 400, 1, 200).crossJoin(F.broadcast(one)).withColumn("frame", slow("id")).drop("id")
    jobs = Jobs(spark)
    job = jobs.start("export", lambda j: many.write.format("frame_folder").mode("append").save(path))
    for _ in range(300):
        if S.written(path) > 2 or job.state not in ("queued", "running"):
            break
        time.sleep(0.1)
    assert S.written(path) > 2 and jobs.cancel(job.number), (job.state, job.error)
    assert jobs.wait(job.number, 60).state == "cancelled"
    for _ in range(100):
        if not left_over(path):
            break
        time.sleep(0.1)
    assert not os.path.exists(path) and not left_over(path)


def filtered_png(pixels, colour, kinds):
    """A PNG file whose rows use the filters given in turn."""
    height, width, n = pixels.shape
    above, rows = np.zeros(width * n, np.int64), b""
    for y in range(height):
        line = pixels[y].astype(np.int64).reshape(-1)
        left = np.concatenate([np.zeros(n, np.int64), line[:-n]])
        corner = np.concatenate([np.zeros(n, np.int64), above[:-n]])
        d = [np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)]
        paeth = np.where((d[0] <= d[1]) & (d[0] <= d[2]), left, np.where(d[1] <= d[2], above, corner))
        guess = [0, left, above, (left + above) // 2, paeth][kinds[y % len(kinds)]]
        rows += bytes([kinds[y % len(kinds)]]) + ((line - guess) & 255).astype(np.uint8).tobytes()
        above = line
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    packed = zlib.compress(rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + chunk(b"IDAT", packed[:7]) + chunk(b"IDAT", packed[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_pictures_with_any_filter(colour, n):
    pixels = np.random.default_rng(n).integers(0, 256, (11, 7, n)).astype(np.uint8)
    got = S.decode_png(filtered_png(pixels, colour, [0, 1, 2, 3, 4]))
    alpha = pixels[..., -1:] if n in (2, 4) else np.full((11, 7, 1), 255, np.uint8)
    assert (got == np.concatenate([pixels[..., :1].repeat(3, 2) if n < 3 else pixels[..., :3], alpha], 2)).all()


def test_pictures_that_are_not_read():
    good = encode_png(np.zeros((3, 4, 4), np.uint8))
    assert S.decode_png(good).shape == (3, 4, 4)
    for bad in (b"", b"GIF89a", good[:40], good[:50] + b"x" + good[51:], good.replace(struct.pack(">II", 4, 3), struct.pack(">II", 4, 9))):
        with pytest.raises((ValueError, struct.error)):
            S.decode_png(bad)


def test_blocks_fold_as_rows_come(spark, monkeypatch):
    """many frames and layers in blocks of few pixels: no list of a pixel's layers, and what folding each pixel by itself gives, in all modes and with all sliders."""
    from kairoline.functions import colour as C

    rng = random.Random(4)
    modes = [m for m in C.BLENDS]
    kind = "struct<" + ",".join(f"{n}:double" for n in NAMES) + ">"
    layers, passes = [], []
    for frame in range(-3, 9):
        for layer in range(12):
            if layer % 5 == 3:
                passes.append((frame, layer, {n: round(rng.uniform(-0.6, 0.6), 3) for n in NAMES}))
            layers += [(frame, layer, p % 3, p // 3, *(rng.random() for _ in range(4)), modes[(frame + layer + p) % len(modes)]) for p in rng.sample(range(6), 4)]
    df = spark.createDataFrame(layers, "frame long, layer int, x int, y int, r double, g double, b double, a double, mode string").repartition(3)
    ps = spark.createDataFrame(passes, f"frame long, layer int, grade {kind}")
    frames = spark.range(-3, 9).withColumnRenamed("id", "frame")

    def shown(**sizes):
        for n, v in sizes.items():
            monkeypatch.setattr(X, n, v)
        out = X.composited(frames, df, (3, 2), ps, (0.4, 0.2, 0.1, 0.5))
        assert "ObjectHash" not in out._jdf.queryExecution().executedPlan().toString()
        return {(r.frame, r.x, r.y): (r.r, r.g, r.b, r.a) for r in out.collect()}

    got = shown(_TOGETHER=128, _PART=4096)
    assert len(got) == 72
    for other in (shown(_TOGETHER=1, _PART=4), shown(_TOGETHER=13, _PART=6)):
        assert other.keys() == got.keys() and all(math.isclose(u, v, abs_tol=1e-12) for k in got for u, v in zip(got[k], other[k], strict=True))
    # one step at a time, by the columns' formulas
    low = {(f, p % 3, p // 3): (0.4 * 0.5, 0.2 * 0.5, 0.1 * 0.5, 0.5) for f in range(-3, 9) for p in range(6)}
    rows = "r double, g double, b double, a double"
    for layer in range(12):
        own = {(f, x, y): (*c, m) for f, n, x, y, *c, m in layers if n == layer}
        regrade = {f: g for f, n, g in passes if n == layer}
        keys = sorted(low)
        flat = [(i, *[v / low[k][3] for v in low[k][:3]], low[k][3], *own.get(k, (0.0, 0.0, 0.0, 0.0, "normal"))) for i, k in enumerate(keys)]
        one = spark.createDataFrame(flat, f"i long, {rows}, sr double, sg double, sb double, sa double, mode string")

        def mixed(c, column=F.col):
            value = C.composite("normal", column(c), column("a"), column(f"s{c}"), column("sa"))[0]
            for m in modes:
                value = F.when(column("mode") == m, C.composite(m, column(c), column("a"), column(f"s{c}"), column("sa"))[0]).otherwise(value)
            return value

        done = one.select("i", *(mixed(c).alias(c) for c in "rgb"), (F.col("sa") + F.col("a") * (1 - F.col("sa"))).alias("a")).collect()
        low = {keys[r.i]: (r.r, r.g, r.b, r.a) for r in done}
        if regrade:
            flat = [(i, *[v / low[k][3] for v in low[k][:3]], low[k][3], regrade[k[0]]) for i, k in enumerate(keys)]
            g = spark.createDataFrame(flat, f"i long, {rows}, grade {kind}").select("i", "a", X.graded(F.struct("r", "g", "b"), F.col("grade")).alias("c")).collect()
            low = {keys[r.i]: (r.c.r * r.a, r.c.g * r.a, r.c.b * r.a, r.a) for r in g}
    for k, v in got.items():
        assert all(math.isclose(u, w, abs_tol=1e-9) for u, w in zip(v, (*[c / low[k][3] for c in low[k][:3]], low[k][3]), strict=True)), k


def test_sound_is_added_up_in_pages(spark, monkeypatch):
    """samples are added up over arrays in a few pages at a time, with gaps, nulls, frames before 0 and spans over several blocks."""
    rng = random.Random(6)
    sound = {(m, f): (None if rng.random() < 0.1 else round(rng.uniform(-0.3, 0.3), 3)) for m in (1, 2) for f in range(90) if rng.random() < 0.8}
    pcm = spark.createDataFrame([(m, f, 0, v) for (m, f), v in sound.items()], "media_id int, frame long, ch int, sample double")
    spans = [(rng.choice([1, 2, 3, None]), rng.choice([None, *range(-150, 150, 7)]), rng.randrange(60), rng.randrange(0, 70), rng.choice([None, 0.5, 1.0, 2.0]), rng.choice([-1.0, 0.0, 0.3, None]), rng.choice([0, 3, None]), rng.choice([0, 9])) for _ in range(60)]
    df = spark.createDataFrame(spans, "media_id int, at long, first long, length long, volume double, pan double, fade_in int, fade_out int").repartition(2)
    want = {}
    for m, at, first, length, volume, pan, up, down in spans:
        for p in range(length):
            if (m, first + p) in sound:
                v = sound[m, first + p]
                own = want.setdefault(None if at is None else at + p, [])
                if v is not None and volume is not None and pan is not None:
                    gain = volume * (p / up if up and p < up else 1.0) * ((length - p) / down if down and length - p < down else 1.0)
                    own.append([v * gain * side(pan + 1, math.pi / 4) * 2**0.5 for side in (lambda x, k: math.cos(x * k), lambda x, k: math.sin(x * k))])
    monkeypatch.setattr(audio, "_PAGES", 2)
    monkeypatch.setattr(audio, "_PAGE", 16)
    out = audio.mix(df, pcm, bucket=32)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow add" in plan and "explode(sequence(greatest" not in plan
    got = {r.frame: (r.left, r.right) for r in out.collect()}
    assert got.keys() == want.keys() and len(got) > 200
    for k, own in want.items():
        # as SQL's least and greatest have it, a sum of nothing is passed over
        for side in (0, 1):
            assert math.isclose(got[k][side], max(-1.0, min(1.0, sum(v[side] for v in own))) if own else 1.0, abs_tol=1e-9), k


def test_layers_are_counted_over_batches(spark):
    """layers are numbered over arrays, whatever the batches, and carry the clips' and tracks' columns."""
    from kairoline.operators import resolve as R

    rng = random.Random(8)
    tracks = [(n, n, rng.choice(["video", "text", "audio", "effect"]), rng.random() < 0.9) for n in range(12)]
    clips, k = [], 0
    for n in range(12):
        at = rng.randrange(9)
        while at < 150:
            d = rng.randrange(1, 30)
            clips.append((k, n, at, d))
            at, k = at + d + rng.randrange(3), k + 1
    c = spark.createDataFrame(clips, "clip_id long, track_id long, start_tick long, dur_tick long")
    t = spark.createDataFrame(tracks, "track_id long, order_idx long, kind string, enabled boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = R.layers(spark.range(150).select(F.col("id").alias("t")), c, t, keep=("start_tick", "kind"))
        rows = {(r.t, r.layer): (r.track_id, r.clip_id, r.start_tick, r.kind) for r in got.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for tick in range(150):
        own = sorted((n, k, s) for k, n, s, d in clips if s <= tick < s + d and tracks[n][3] and tracks[n][2] != "audio")
        want |= {(tick, i): (n, k, s, tracks[n][2]) for i, (n, k, s) in enumerate(own)}
    assert rows == want and len(want) > 500
