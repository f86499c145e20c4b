"""Queries of paths, masks of letters, scenes, looks and calls of tools, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths, raster
from ..operators import look_rules, resolve
from ..streaming import signals
from ..tools import judge
from . import look_queries as looks
from .fixtures import MEDIA, PACKED, PIXELS, media, packed, pixels, table


def points(spark, sf):
    """Each order's clips as points of a path, some of them with handles; every other path is closed."""
    x, y = (F.col("start_tick") % 211).cast("double"), (F.col("clip_id") * 7 % 199).cast("double")
    out, into = F.col("line") % 3 == 0, F.col("line") % 4 == 0
    return packed(spark, sf).select(F.col("link").alias("path_id"), F.col("line").alias("seq"), (F.col("link") % 2 == 0).alias("closed"), x.alias("ax"), y.alias("ay"), F.when(into, x - 25).otherwise(x).alias("inx"), F.when(into, y + 15).otherwise(y).alias("iny"), F.when(out, x + 30).otherwise(x).alias("outx"), F.when(out, y - 20).otherwise(y).alias("outy"))


_CHORDS = f"""{PACKED}, pt AS (SELECT link AS path_id, line AS seq, link % 2 = 0 AS closed, (start_tick % 211)::DOUBLE AS ax, (clip_id * 7 % 199)::DOUBLE AS ay, line % 3 = 0 AS o, line % 4 = 0 AS i FROM packed),
  hd AS (SELECT *, CASE WHEN i THEN ax - 25 ELSE ax END AS inx, CASE WHEN i THEN ay + 15 ELSE ay END AS iny, CASE WHEN o THEN ax + 30 ELSE ax END AS outx, CASE WHEN o THEN ay - 20 ELSE ay END AS outy FROM pt),
  nx AS (SELECT *, coalesce(lead({{'x': ax, 'y': ay, 'ix': inx, 'iy': iny, 'i': i}}) OVER w, CASE WHEN closed THEN first({{'x': ax, 'y': ay, 'ix': inx, 'iy': iny, 'i': i}}) OVER w END) AS n, count(*) OVER (PARTITION BY path_id) AS c FROM hd WINDOW w AS (PARTITION BY path_id ORDER BY seq)),
  ks AS (SELECT *, o OR n.i AS curved, unnest(range(1, CASE WHEN o OR n.i THEN 17 ELSE 2 END)) AS k FROM nx WHERE c >= 2 AND n IS NOT NULL),
  us AS (SELECT *, CASE WHEN curved THEN (k - 1) / 16.0::DOUBLE ELSE 0.0::DOUBLE END AS t0, CASE WHEN curved THEN k / 16.0::DOUBLE ELSE 1.0::DOUBLE END AS t1 FROM ks),
  ch AS (SELECT path_id, closed, {", ".join(f"(1 - t{j}) * (1 - t{j}) * (1 - t{j}) * a{a} + 3 * (1 - t{j}) * (1 - t{j}) * t{j} * out{a} + 3 * (1 - t{j}) * t{j} * t{j} * n.i{a} + t{j} * t{j} * t{j} * n.{a} AS {a}{j}" for j in (0, 1) for a in "xy")} FROM us)"""
_PROBES = "pr AS (SELECT path_id, p AS probe, (p * 50 + path_id % 50)::DOUBLE + 0.25::DOUBLE AS px, (p * 37 + path_id % 41)::DOUBLE + 0.125::DOUBLE AS py FROM (SELECT DISTINCT path_id FROM pt), range(0, 4) t(p))"
_MEASURED = f"""{_CHORDS}, {_PROBES}, pj AS (SELECT *, x1 - x0 AS ex, y1 - y0 AS ey, px - x0 AS wx, py - y0 AS wy FROM ch JOIN pr USING (path_id)),
  pq AS (SELECT *, CASE WHEN ex = 0 AND ey = 0 THEN 0 ELSE greatest(0, least(1, (wx * ex + wy * ey) / (ex * ex + ey * ey))) END AS t FROM pj),
  ms AS (SELECT path_id, probe, closed, sqrt(min((wx - ex * t) * (wx - ex * t) + (wy - ey * t) * (wy - ey * t))) AS d, sum(CASE WHEN y0 <= py AND y1 > py AND ex * wy - ey * wx > 0 THEN 1 WHEN y0 > py AND y1 <= py AND ex * wy - ey * wx < 0 THEN -1 ELSE 0 END) AS w FROM pq GROUP BY ALL)"""


def _probes(spark, sf):
    return points(spark, sf).select("path_id").distinct().withColumn("probe", F.explode(F.array(*(F.lit(k).cast("long") for k in range(4))))).select("path_id", "probe", (F.col("probe") * 50 + F.col("path_id") % 50 + 0.25).cast("double").alias("px"), (F.col("probe") * 37 + F.col("path_id") % 41 + 0.125).cast("double").alias("py"))


def c12_path_bounds(spark, sf):
    b = paths.bounds(points(spark, sf))
    return b.select("path_id", *(F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")))


def c12_path_hits(spark, sf):
    return paths.hits(points(spark, sf), _probes(spark, sf), stroke=6.0)


def c12_path_cover(spark, sf):
    c = paths.cover(points(spark, sf), _probes(spark, sf), stroke=8.0)
    return c.select("path_id", "probe", F.round("fill", 6).alias("fill"), F.round("stroke", 6).alias("stroke"))


def masks(spark, sf):
    return pixels(spark, sf).select((F.col("media_id") * 1_000_000 + F.col("t").cast("long")).alias("image_id"), F.col("x").cast("int").alias("x"), "y", F.col("r").cast("int").alias("a"))


_MASKS = f"{PIXELS}, mk AS (SELECT media_id * 1000000 + t::BIGINT AS image_id, x, y, r AS a FROM pixels)"


def c15_dilate(spark, sf):
    return raster.dilate(masks(spark, sf), 2.5)


def c15_box_blur(spark, sf):
    return raster.box_blur(masks(spark, sf), 2.0)


def c15_card(spark, sf):
    g = looks._grid(spark, sf).select((F.col("x") + 31.5).alias("x"), (F.col("y") + 31.5).alias("y"))
    return g.agg(*(F.round(F.sum(raster.card(F.col("x"), F.col("y"), 6.5, 10.0, 50.25, 40.0, r)), 6).alias(n) for n, r in (("sharp", 0.0), ("half", 0.5), ("full", 1.0))))


def r3_scene(spark, sf):
    c = packed(spark, sf)
    shown = c.select(F.col("start_tick").alias("t"), F.col("line").alias("layer"), "clip_id")
    k = F.col("clip_id")
    sampled = c.where(k % 3 != 0).select("clip_id", F.col("start_tick").alias("t"), (k % 9 / 10.0 - 0.4).alias("position_x"), F.lit(None).cast("double").alias("position_y"), F.lit(0.25).alias("anchor_x"), F.lit(None).cast("double").alias("anchor_y"), (k % 4 / 2.0 + 0.5).alias("scale_x"), (k % 5 / 4.0 + 0.25).alias("scale_y"), (k % 360).cast("double").alias("rotation"), (k % 11 / 10.0).alias("opacity"))
    s = resolve.scene(shown, c, media(spark, sf), sampled, (1920, 1080))
    names = {"x": "center.x", "y": "center.y", "pivot_x": "anchor.x", "pivot_y": "anchor.y", "w": "size.w", "h": "size.h", "rotation": "rotation", "opacity": "opacity", "px": "px"}
    return s.select("t", "layer", "clip_id", *(F.round(F.col(f"scene.{path}"), 6).alias(n) for n, path in names.items()))


def e16_look_rules(spark, sf):
    """What is wrong with clips' looks."""
    k = F.col("clip_id")
    value = lambda n, m, low, step: ((k % n - m) / step + low).cast("double").cast("string")
    look = F.create_map(
        F.lit("adjustments"), F.concat(F.lit('{"brightness": '), value(31, 15, 0.0, 10.0), F.lit("}")),
        F.lit("mask"), F.concat(F.lit('{"kind": "'), F.when(k % 7 == 0, "blob").otherwise("star"), F.lit('", "size": [1, '), (k % 3).cast("string"), F.lit("]}")),
        F.lit("crop"), F.concat(F.lit('{"x": 0.5, "w": '), value(8, 0, 0.0, 10.0), F.lit("}")),
        F.when(k % 5 == 0, "zzz").otherwise("blend"), F.when(k % 2 == 0, '"screen"').otherwise('"none"'),
    )
    return look_rules.violations(packed(spark, sf).select("clip_id", look.alias("look")))


def x11_judged_calls(spark, sf):
    k = F.col("event_id")
    args = F.when(k % 4 == 0, '{"clip": 1}').when(k % 4 == 1, '{"clip": 1, "seconds": 2}').when(k % 4 == 2, "{}").otherwise("[1]")
    calls = table(spark, sf, "events").select("event_id", F.col("event_type").alias("tool"), args.alias("args"))
    return judge(calls, {"view": ["clip"], "click": ["clip", "seconds"]}).select("event_id", "tool", "reason")


def stream_latest(spark, sf):
    """The requests that are left once each user's have been coalesced to the latest."""
    return signals.latest(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


QUERIES = {f.__name__: f for f in (c12_path_bounds, c12_path_hits, c12_path_cover, c15_dilate, c15_box_blur, c15_card, r3_scene, e16_look_rules, x11_judged_calls, stream_latest)}

_RAMP = lambda d: f"greatest(0, least(1, 0.5 - ({d})))"


def _blur(source: str, along: str, across: str) -> str:
    return f"SELECT p.image_id, p.x, p.y, ((sum(q.a) + 2) // 5)::INT AS a FROM {source} p, range(-2, 3) d(i), {source} q WHERE q.image_id = p.image_id AND q.{across} = p.{across} AND q.{along} = greatest(0, least(7, p.{along} + i)) GROUP BY ALL"


def _card(roundness: float) -> str:
    w, h = (50.25 - 6.5) / 2, 15.0
    r = roundness * min(w, h)
    qx, qy = f"abs(x + 32 - {6.5 + w!r}::DOUBLE) - {w - r!r}::DOUBLE", f"abs(y + 32 - 25) - {h - r!r}::DOUBLE"
    return f"round(sum({_RAMP(f'sqrt(greatest({qx}, 0) ** 2 + greatest({qy}, 0) ** 2) + least(greatest({qx}, {qy}), 0) - {r!r}::DOUBLE')}), 6)"


ORACLE_SQL = {
    "c12_path_bounds": f"WITH {_CHORDS} SELECT path_id, round(min(least(x0, x1)), 6) AS left, round(min(least(y0, y1)), 6) AS top, round(max(greatest(x0, x1)), 6) AS right, round(max(greatest(y0, y1)), 6) AS bottom FROM ch GROUP BY ALL",
    "c12_path_hits": f"WITH {_MEASURED} SELECT path_id, probe, d <= 3 OR closed AND w <> 0 AS hit FROM ms",
    "c12_path_cover": f"WITH {_MEASURED} SELECT path_id, probe, round(CASE WHEN closed THEN {_RAMP('CASE WHEN w <> 0 THEN -d ELSE d END')} ELSE 0 END::DOUBLE, 6) AS fill, round({_RAMP('d - 4')}::DOUBLE, 6) AS stroke FROM ms",
    "c15_dilate": f"WITH {_MASKS} SELECT p.image_id, p.x, p.y, max(q.a) AS a FROM mk p JOIN mk q ON p.image_id = q.image_id AND (p.x - q.x) ** 2 + (p.y - q.y) ** 2 <= 6.25 GROUP BY ALL",
    "c15_box_blur": f"WITH {_MASKS}, b1 AS ({_blur('mk', 'x', 'y')}), b2 AS ({_blur('b1', 'y', 'x')}), b3 AS ({_blur('b2', 'x', 'y')}) {_blur('b3', 'y', 'x')}",
    "c15_card": f"WITH {looks._GRID} SELECT {_card(0.0)} AS sharp, {_card(0.5)} AS half, {_card(1.0)} AS \"full\" FROM g",
    "r3_scene": f"""WITH {PACKED}, {MEDIA}, j AS (SELECT p.*, clip_id % 3 <> 0 AS s, m.width::DOUBLE AS mw, m.height::DOUBLE AS mh FROM packed p JOIN media m USING (media_id)),
      f AS (SELECT *, least(1920 / mw, 1080 / mh) AS fit, CASE WHEN s THEN clip_id % 4 / 2.0::DOUBLE + 0.5 ELSE 1 END AS sx, CASE WHEN s THEN clip_id % 5 / 4.0::DOUBLE + 0.25 ELSE 1 END AS sy FROM j)
      SELECT start_tick AS t, line AS layer, clip_id, round(1920 * (0.5 + CASE WHEN s THEN clip_id % 9 / 10.0::DOUBLE - 0.4::DOUBLE ELSE 0 END), 6) AS x, 540.0::DOUBLE AS y, CASE WHEN s THEN 0.25 ELSE 0.5 END::DOUBLE AS pivot_x, 0.5::DOUBLE AS pivot_y,
        round(mw * fit * sx, 6) AS w, round(mh * fit * sy, 6) AS h, round(CASE WHEN s THEN radians(clip_id % 360) ELSE 0 END::DOUBLE, 6) AS rotation, round(CASE WHEN s THEN clip_id % 11 / 10.0::DOUBLE ELSE 1 END, 6) AS opacity, round(sqrt(sx * sy), 6) AS px FROM f""",
    "e16_look_rules": f"""WITH {PACKED}, k AS (SELECT clip_id AS k FROM packed),
      r AS (SELECT k, 'adjustments' AS name, CASE WHEN abs(k % 31 - 15) > 10 THEN 'adjustments.brightness: out of bounds' END AS reason FROM k
        UNION ALL SELECT k, 'mask', CASE WHEN k % 3 = 0 THEN 'mask.size[1]: not positive' WHEN k % 7 = 0 THEN 'mask.kind: unknown' END FROM k
        UNION ALL SELECT k, 'crop', CASE WHEN k % 8 = 0 THEN 'crop.w: out of bounds' WHEN k % 8 > 5 THEN 'crop.x: beyond the picture' END FROM k
        UNION ALL SELECT k, CASE WHEN k % 5 = 0 THEN 'zzz' ELSE 'blend' END, CASE WHEN k % 5 = 0 THEN 'unknown name' WHEN k % 2 = 1 THEN 'blend: unknown' END FROM k)
      SELECT k AS clip_id, name, reason FROM r WHERE reason IS NOT NULL""",
    "x11_judged_calls": """SELECT event_id, event_type AS tool, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown tool' WHEN event_id % 4 = 3 THEN 'arguments must be an object' WHEN event_id % 4 = 2 THEN 'missing argument: clip'
      WHEN event_type = 'click' AND event_id % 4 = 0 THEN 'missing argument: seconds' END AS reason FROM events""",
    "stream_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
}
