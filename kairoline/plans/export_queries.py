"""Queries of compositing and export: layers folded with canvas passes, motion blur, and frames with their blocks of sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import audio as A
from ..operators import composite as X
from ..operators import resolve as R
from ..sources.scratch import written
from .fixtures import PACKED, PCM, PIXELS, TRACKS, packed, pcm, pixels, tracks

_MODES = ("normal", "multiply", "screen", "add", "difference")


def _grade(**sliders):
    return C.effective_grades(F.lit(None).cast("string"), F.lit(0.0), sliders)


def r4_composite(spark, sf):
    """Layers over each other, the lowest first."""
    p = pixels(spark, sf).withColumn("frame", F.col("media_id").cast("long"))
    layers = p.select("frame", F.col("t").cast("long").alias("layer"), "x", "y", *((F.col(c) / 255.0).alias(c) for c in "rgb"), (0.25 + (F.col("x") % 4) / 8.0).alias("a"), F.lit("screen").alias("mode"))
    done = X.composited(p.select("frame").distinct(), layers, (8, 8), background=(0.0, 0.0, 0.0, 0.0), modes=("screen",))
    return done.groupBy(F.col("frame").cast("int").alias("media_id")).agg(F.round(F.sum(F.col("r") * F.col("a")), 6).alias("colour"), F.round(F.sum("a"), 6).alias("alpha"))


def r4_canvas_passes(spark, sf):
    """A medium's pictures as layers in five modes; every seventh is followed by a pass that regrades all below."""
    p = pixels(spark, sf).withColumn("frame", F.col("media_id").cast("long")).withColumn("layer", F.col("t").cast("long"))
    mode = F.element_at(F.array(*map(F.lit, _MODES)), (F.col("layer") % 5 + 1).cast("int"))
    layers = p.select("frame", "layer", "x", "y", *((F.col(c) / 255.0).alias(c) for c in "rgb"), (0.25 + (F.col("x") % 4) / 8.0).alias("a"), mode.alias("mode"))
    n = F.col("layer")
    grade = _grade(exposure=(n % 3 - 1) * 0.1, brightness=F.lit(0.05), contrast=(n % 5 - 2) * 0.1, saturation=(n % 4 - 2) * 0.15)
    passes = p.where("layer % 7 = 3").select("frame", "layer").distinct().select("frame", "layer", grade.alias("grade"))
    done = X.composited(p.select("frame").distinct(), layers, (8, 8), passes, modes=_MODES)
    return done.groupBy("frame").agg(*(F.round(F.sum(c), 4).alias(n) for c, n in zip("rgba", ("red", "green", "blue", "alpha"), strict=True)))


def _scene(x, y, w, h, rotation, opacity):
    point = lambda a, b, names: F.struct(a.alias(names[0]), b.alias(names[1]))
    return F.struct(point(x, y, "xy").alias("center"), point(F.lit(0.5), F.lit(0.5), "xy").alias("anchor"), point(w, h, "wh").alias("size"), rotation.alias("rotation"), opacity.alias("opacity"))


def r4_motion_blur(spark, sf):
    """Each picture moves to the right and grows while its frame is exposed, over half a frame in five moments."""
    p = pixels(spark, sf)
    shown = p.select("media_id", F.col("t").alias("source_t")).distinct().select("media_id", "source_t", (F.col("media_id") * 100_000 + F.col("source_t")).cast("long").alias("frame"), F.lit(0).alias("layer"), F.col("source_t").alias("t"), F.lit(8).alias("width"), F.lit(8).alias("height"))

    def moved(s):
        d = F.col("moment") - F.col("t")
        return s.withColumn("scene", _scene(4.0 + d * 6, F.lit(3.7), 5.0 + d * 2, F.lit(4.3), F.lit(0.0), F.lit(0.8)))

    scenes = X.motion_scenes(shown, moved, 180.0, 5)
    blurred = X.averaged(X.drawn(scenes, p, (8, 8)), 5)
    done = X.composited(shown.select("frame"), blurred, (8, 8), background=(0.5, 0.25, 0.125, 1.0), modes=())
    return done.groupBy("frame").agg(F.round(F.sum(F.col("r") * (F.col("x") + 1)), 5).alias("red"), F.round(F.sum(F.col("g") * (F.col("y") + 1)), 5).alias("green"))


_CANVAS = (4, 2)


def r5_export(spark, sf):
    """A preview at one frame a second of the whole timeline: every frame's picture, passes included, and block of sound.

    Colours are given times pi, as means of a few short decimals would lie on the edge of rounding."""
    # plan, pictures and sound use the clips
    c = written(packed(spark, sf))
    t = tracks(spark, sf)
    plan = X.export_plan(c, (24, 1), (1, 1))
    k = F.col("clip_id")
    shown = R.layers(plan.select("t"), c, t, keep=("start_tick", "kind")).join(plan.select("frame", "t"), "t")
    over = F.col("kind").isin("effect", "filter", "adjustment")
    grade = _grade(exposure=(k % 3 - 1) * 0.1, brightness=F.lit(0.05), contrast=(k % 5 - 2) * 0.1, saturation=(k % 4 - 2) * 0.15)
    passes = shown.where(over).select("frame", "layer", grade.alias("grade"))
    scene = _scene(4.0 * (0.5 + k % 5 / 10.0 - 0.2), F.lit(1.0), F.lit(2.0), F.lit(2.0), F.lit(0.0), 0.25 + k % 4 / 8.0)
    mode = F.element_at(F.array(*map(F.lit, _MODES)), (k % 5 + 1).cast("int"))
    scenes = shown.where(~over).select("frame", "layer", (k % 10).cast("int").alias("media_id"), ((F.col("t") - F.col("start_tick")) % 3).cast("double").alias("source_t"), F.lit(8).alias("width"), F.lit(8).alias("height"), scene.alias("scene"), mode.alias("mode"))
    layers = X.drawn(scenes, pixels(spark, sf), _CANVAS, keep=("mode",))
    spans = c.select((k % 10).cast("int").alias("media_id"), (F.col("start_tick") * 2000).alias("at"), F.col("line").alias("first"), F.col("dur_tick").alias("length"), "volume", (F.col("line") / 4.0 - 1).alias("pan"), F.lit(5).alias("fade_in"), F.lit(7).alias("fade_out"))
    picture = X.composited(plan.select("frame"), layers, _CANVAS, passes, modes=_MODES).groupBy("frame").agg(*(F.round(F.avg(c) * F.pi(), 4).alias(n) for c, n in zip("rgb", ("red", "green", "blue"), strict=True)))
    sound = A.mix(spans, pcm(spark, sf)).groupBy(X.frame_of_sample(F.col("frame"), (1, 1)).alias("frame")).agg(F.count("*").alias("n"), F.round(F.sum("left"), 4).alias("left"), F.round(F.sum("right"), 4).alias("right"))
    out = plan.join(picture, "frame").join(sound, "frame", "left")
    return out.select("frame", "from_sample", "to_sample", "red", "green", "blue", F.coalesce("n", F.lit(0)).cast("long").alias("n_samples"), F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("right", F.lit(0.0)).alias("right"))


QUERIES = {f.__name__: f for f in (r4_composite, r4_canvas_passes, r4_motion_blur, r5_export)}


def _fold_sql(start: str) -> str:
    """f: every pixel of grid (frame, x, y) after its first n of items (frame, x, y, n, mode, r, g, b, a and a pass's sliders)."""
    back = {c: f"(CASE WHEN f.a > 0 THEN f.{c} / f.a ELSE 0 END)" for c in "rgb"}

    def mixed(c: str) -> str:
        b, s = back[c], f"i.{c}"
        m = f"CASE i.mode WHEN 'multiply' THEN {b} * {s} WHEN 'screen' THEN {b} + {s} - {b} * {s} WHEN 'add' THEN least(1, {b} + {s}) WHEN 'difference' THEN abs({b} - {s}) ELSE {s} END"
        return f"((1 - f.a) * {s} + f.a * ({m})) * i.a + {b} * f.a * (1 - i.a)"

    first = {c: f"(({back[c]} * pow(2.0::DOUBLE, 2 * i.exposure) + 0.25 * i.brightness - 0.5) * (1 + i.contrast) + 0.5)" for c in "rgb"}
    grey = f"({' + '.join(f'{w} * {first[c]}' for c, w in zip('rgb', ('0.2126', '0.7152', '0.0722'), strict=True))})"
    graded = {c: f"greatest(0, least(1, {grey} + ({first[c]} - {grey}) * (1 + i.saturation))) * f.a" for c in "rgb"}
    channels = ", ".join(f"CASE WHEN i.mode = 'pass' THEN {graded[c]} ELSE {mixed(c)} END" for c in "rgb")
    return f"""f(frame, x, y, n, r, g, b, a) AS (SELECT frame, x, y, 0::BIGINT, {start} FROM grid UNION ALL
      SELECT f.frame, f.x, f.y, i.n, {channels}, CASE WHEN i.mode = 'pass' THEN f.a ELSE i.a + f.a * (1 - i.a) END FROM f JOIN items i ON i.frame = f.frame AND i.x = f.x AND i.y = f.y AND i.n = f.n + 1),
      top AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY frame, x, y ORDER BY n DESC) = 1)"""


_MODE_SQL = lambda k: f"{list(_MODES)}[{k} % 5 + 1]"
_SLIDERS = lambda k: f"({k} % 3 - 1) * 0.1::DOUBLE AS exposure, 0.05::DOUBLE AS brightness, ({k} % 5 - 2) * 0.1::DOUBLE AS contrast, ({k} % 4 - 2) * 0.15::DOUBLE AS saturation"
_NONE = "0.0::DOUBLE AS exposure, 0.0::DOUBLE AS brightness, 0.0::DOUBLE AS contrast, 0.0::DOUBLE AS saturation"
_CHANNELS = "r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b"

ORACLE_SQL = {
    "r4_composite": f"""WITH RECURSIVE {PIXELS}, p AS MATERIALIZED (SELECT media_id, x, y, row_number() OVER (PARTITION BY media_id, x, y ORDER BY t) AS n, r / 255.0::DOUBLE AS s, 0.25 + (x % 4) / 8.0::DOUBLE AS sa FROM pixels),
      f(media_id, x, y, n, c, a) AS (SELECT media_id, x, y, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM p WHERE n = 1 UNION ALL
        SELECT f.media_id, f.x, f.y, p.n, ((1 - a) * s + a * (CASE WHEN a > 0 THEN c / a ELSE 0 END + s - CASE WHEN a > 0 THEN c / a ELSE 0 END * s)) * sa + CASE WHEN a > 0 THEN c / a ELSE 0 END * a * (1 - sa), sa + a * (1 - sa)
        FROM f JOIN p ON p.media_id = f.media_id AND p.x = f.x AND p.y = f.y AND p.n = f.n + 1)
      SELECT media_id, round(sum(c), 6) AS colour, round(sum(a), 6) AS alpha FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY media_id, x, y ORDER BY n DESC) = 1) GROUP BY ALL""",
    "r4_canvas_passes": f"""WITH RECURSIVE {PIXELS}, l AS (SELECT media_id::BIGINT AS frame, t::BIGINT AS layer, x, y, {_CHANNELS}, 0.25 + (x % 4) / 8.0::DOUBLE AS a FROM pixels),
      grid AS (SELECT DISTINCT frame, x, y FROM l),
      items AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame, x, y ORDER BY layer, mode = 'pass') AS n FROM (
        SELECT frame, layer, x, y, {_MODE_SQL("layer")} AS mode, r, g, b, a, {_NONE} FROM l UNION ALL SELECT frame, layer, x, y, 'pass', 0, 0, 0, 0, {_SLIDERS("layer")} FROM l WHERE layer % 7 = 3)),
      {_fold_sql("0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE")}
      SELECT frame, round(sum(r / a), 4) AS red, round(sum(g / a), 4) AS green, round(sum(b / a), 4) AS blue, round(sum(a), 4) AS alpha FROM top GROUP BY frame""",
    "r4_motion_blur": f"""WITH {PIXELS}, m AS (SELECT media_id, t, t + (i / 4.0::DOUBLE - 0.5) * 0.5 AS moment FROM (SELECT DISTINCT media_id, t FROM pixels), range(0, 5) k(i)),
      grid AS (SELECT a.range AS x, b.range AS y FROM range(0, 8) a, range(0, 8) b),
      cells AS (SELECT media_id, t, x, y, (x + 0.5 - (4.0 + (moment - t) * 6)) / (5.0 + (moment - t) * 2) + 0.5 AS u, (y + 0.5 - 3.7::DOUBLE) / 4.3::DOUBLE + 0.5 AS v FROM m, grid),
      s AS (SELECT at_.media_id, at_.t, at_.x, at_.y, p.r / 255.0::DOUBLE AS r, p.g / 255.0::DOUBLE AS g FROM cells at_ JOIN pixels p ON p.media_id = at_.media_id AND p.t = at_.t AND p.x = floor(u * 8) AND p.y = floor(v * 8) WHERE u >= 0 AND u < 1 AND v >= 0 AND v < 1),
      avg_ AS (SELECT media_id, t, x, y, avg(r) AS r, avg(g) AS g, count(*) * 0.8::DOUBLE / 5 AS a FROM s GROUP BY ALL),
      c AS (SELECT f.media_id, f.t, grid.x, grid.y, coalesce(r * a + 0.5 * (1 - a), 0.5) AS r, coalesce(g * a + 0.25 * (1 - a), 0.25) AS g FROM (SELECT DISTINCT media_id, t FROM pixels) f CROSS JOIN grid LEFT JOIN avg_ ON avg_.media_id = f.media_id AND avg_.t = f.t AND avg_.x = grid.x AND avg_.y = grid.y)
      SELECT (media_id * 100000 + t)::BIGINT AS frame, round(sum(r * (x + 1)), 5) AS red, round(sum(g * (y + 1)), 5) AS green FROM c GROUP BY media_id, t""",
    "r5_export": f"""WITH RECURSIVE {PACKED}, {TRACKS}, {PIXELS}, {PCM},
      plan AS (SELECT unnest(range(0, ((max(start_tick + dur_tick) + 12) // 24)::BIGINT)) AS frame FROM packed),
      shown AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY order_idx) AS layer, kind, clip_id, (frame * 24 - start_tick) % 3 AS st FROM plan JOIN packed ON frame * 24 >= start_tick AND frame * 24 < start_tick + dur_tick JOIN tracks USING (track_id) WHERE enabled AND kind <> 'audio'),
      grid AS (SELECT frame, a.range AS x, b.range AS y FROM plan, range(0, 4) a, range(0, 2) b),
      cells AS (SELECT frame, layer, clip_id, st, x, y, (x + 0.5 - 4.0::DOUBLE * (0.5 + clip_id % 5 / 10.0::DOUBLE - 0.2::DOUBLE)) / 2 + 0.5 AS u, (y + 0.5 - 1) / 2.0::DOUBLE + 0.5 AS v FROM shown JOIN grid USING (frame) WHERE kind NOT IN ('effect', 'filter', 'adjustment')),
      l AS (SELECT frame, layer, at_.x, at_.y, {_MODE_SQL("clip_id")} AS mode, {_CHANNELS}, 0.25 + clip_id % 4 / 8.0::DOUBLE AS a FROM cells at_ JOIN pixels p ON p.media_id = clip_id % 10 AND p.t = st AND p.x = floor(u * 8) AND p.y = floor(v * 8) WHERE u >= 0 AND u < 1),
      items AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY frame, x, y ORDER BY layer) AS n FROM (
        SELECT frame, layer, x, y, mode, r, g, b, a, {_NONE} FROM l UNION ALL SELECT frame, layer, x, y, 'pass', 0, 0, 0, 0, {_SLIDERS("clip_id")} FROM shown JOIN grid USING (frame) WHERE kind IN ('effect', 'filter', 'adjustment'))),
      {_fold_sql("0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE")},
      picture AS (SELECT frame, round(avg(r / a) * pi(), 4) AS red, round(avg(g / a) * pi(), 4) AS green, round(avg(b / a) * pi(), 4) AS blue FROM top GROUP BY frame),
      s AS (SELECT clip_id % 10 AS media_id, start_tick * 2000 AS out0, line AS first, dur_tick AS len, volume, line / 4.0::DOUBLE - 1 AS pan FROM packed),
      j AS (SELECT out0 + frame - first AS sample_at, sample::DOUBLE * volume * CASE WHEN frame - first < 5 THEN (frame - first) / 5.0::DOUBLE ELSE 1 END * CASE WHEN len - (frame - first) < 7 THEN (len - (frame - first)) / 7.0::DOUBLE ELSE 1 END AS v, pan
            FROM s JOIN pcm ON pcm.media_id = s.media_id AND frame >= first AND frame < first + len),
      mixed AS (SELECT sample_at, greatest(-1, least(1, sum(v * cos((pan + 1) * pi() / 4) * sqrt(2)))) AS l, greatest(-1, least(1, sum(v * sin((pan + 1) * pi() / 4) * sqrt(2)))) AS r FROM j GROUP BY sample_at),
      sound AS (SELECT sample_at // 48000 AS frame, count(*) AS n, round(sum(l), 4) AS l, round(sum(r), 4) AS r FROM mixed GROUP BY ALL)
      SELECT plan.frame, plan.frame * 48000 AS from_sample, (plan.frame + 1) * 48000 AS to_sample, red, green, blue, coalesce(n, 0) AS n_samples, coalesce(sound.l, 0.0) AS "left", coalesce(sound.r, 0.0) AS "right" FROM plan JOIN picture USING (frame) LEFT JOIN sound USING (frame)""",
}
