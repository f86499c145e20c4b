"""Queries of edits, catalogs and animations, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import looks as L
from ..operators import catalogs, edits
from ..operators import params as P
from .fixtures import MEDIA, PACKED, TRACKS, media, packed, table, tracks


def e1_place_media(spark, sf):
    r = packed(spark, sf).select("clip_id", "track_id", "media_id", (F.col("line") * 20 - 40).alias("src_start"), (F.col("dur_tick") * 25 - 100).alias("src_dur"), "start_tick")
    return edits.place_media(r, media(spark, sf), (24, 1)).select("clip_id", F.when(F.col("reason").isNull(), F.col("dur_tick")).alias("dur_tick"), "reason")


def e8_retime(spark, sf):
    c = packed(spark, sf).withColumn("src_dur", F.col("dur_tick"))
    speeds = c.select("clip_id", (F.col("line") - 1).alias("num"), F.lit(2).cast("long").alias("den"))
    return edits.retime(c, speeds).select("clip_id", "dur_tick", "reason")


def e12_move_track(spark, sf):
    return edits.move_track(tracks(spark, sf), 5, 2).select("track_id", "order_idx")


def e14_move_effect(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("clip_id"), F.col("l_linenumber").alias("effect")).agg(F.count("*").alias("n")).select("clip_id", F.row_number().over(Window.partitionBy("clip_id").orderBy("effect")).cast("long").alias("p"), "effect").select("clip_id", (F.col("p") - 1).alias("position"), "effect")
    moves = e.select("clip_id").distinct().select("clip_id", (F.col("clip_id") % 4).alias("a"), (F.col("clip_id") % 3).alias("b"))
    return edits.move_effect(e, moves).select("clip_id", "position", F.col("effect").cast("long").alias("effect"))


def e16_set_values(spark, sf):
    t = tracks(spark, sf).select("track_id", "name", "muted")
    changes = t.where("track_id % 3 = 0").select("track_id", F.lit("renamed").alias("name"), F.when(F.col("track_id") % 2 == 0, True).alias("muted"))
    return edits.set_values(t, "track_id", changes)


def e17_slot_windows(spark, sf):
    m = media(spark, sf)
    s = packed(spark, sf).join(m, "media_id").select("clip_id", "dur_tick", F.col("line").alias("num"), F.lit(2).cast("long").alias("den"), "reversed", "rate_num", "rate_den", F.col("duration_ticks").alias("most"), "is_image", (F.col("line") * 400).alias("src_start"))
    return edits.slot_windows(s, (30000, 1001)).select("clip_id", "src_dur", "reason")


def j11_nearest_junction(spark, sf):
    points = table(spark, sf, "orders").select(F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") % 90 + 1).alias("track_id"), (F.col("o_orderkey") * 7 % 9000).alias("t"))
    return edits.nearest_junction(points, packed(spark, sf), 12)


_KINDS = ("effect", "transition", "filter", "blend", "mask")


def j13_catalogs(spark, sf):
    """What clips ask of the catalogs by kind and position, and how much of it there is."""
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("clip_id") % len(_KINDS) + 1).cast("int"))
    asked = packed(spark, sf).select(kind.alias("kind"), (F.floor(F.col("clip_id") / len(_KINDS)) % 15).cast("int").alias("position"))
    found = asked.join(F.broadcast(catalogs.catalog(spark)), ["kind", "position"], "left")  # a fixed table of some hundred rows
    return found.groupBy("kind").agg(F.count("*").alias("asked"), F.count("id").alias("found"), F.count_distinct("id").alias("ids"))


def f14_speed_presets(spark, sf):
    """The average speed of each preset, and the ticks that clips last which take it."""
    average = P.curve_integral(catalogs.speed_curves(spark), 1.0).select("param_id", F.round("area", 9).alias("average"))
    names = sorted(catalogs.SPEED_PRESETS)
    clips = packed(spark, sf).select(F.element_at(F.array(*map(F.lit, names)), (F.col("clip_id") % len(names) + 1).cast("int")).alias("param_id"), "dur_tick")
    return clips.join(F.broadcast(average), "param_id").groupBy("param_id", "average").agg(F.count("*").alias("clips"), F.sum(F.floor(F.col("dur_tick") / F.col("average"))).alias("ticks"))


def f24_animations(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 41 / 40.0).alias("t")).distinct()
    out = []
    for f, slot in ((L.entrance, "in"), (L.exit_, "out"), (L.combo, "combo")):
        for name in catalogs.ANIMATIONS[slot]:
            d = L.with_intensity(f(name, F.col("t")), 1.5)
            out.append(F.struct(F.lit(name).alias("name"), d.x.alias("x"), d.y.alias("y"), d.scale.alias("scale"), d.turn.alias("turn"), d.opacity.alias("opacity")))
    rows = t.select("t", F.explode(F.array(*out)).alias("d"))
    return rows.select("t", "d.name", *((F.round(F.col(f"d.{c}"), 9) + 0.0).alias(c) for c in ("x", "y", "scale", "turn", "opacity")))


def f25_characters(spark, sf):
    c = table(spark, sf, "conversations").where("length(text) > 0").select("conv_id", "turn", F.length("text").alias("n"), F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("i"))
    local = L.stagger(F.lit(0.4), F.col("i"), F.col("n").cast("double"), 0.55)
    d = L.character_entrance("char_bounce_in", local)
    return c.groupBy("conv_id", "turn").agg(F.round(F.sum(local), 6).alias("progress"), F.round(F.sum(d.y), 6).alias("y"), F.round(F.sum(d.scale), 6).alias("scale"))


def f25_character_combos(spark, sf):
    i = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 20).alias("i"), (F.col("l_partkey") % 10 / 10.0).alias("phase")).distinct()
    share = F.col("i") / 20.0
    out = []
    for name in catalogs.ANIMATIONS["text_combo"]:
        d = L.character_combo(name, F.col("phase"), share, F.col("i"))
        out.append(F.struct(F.lit(name).alias("name"), d.x.alias("x"), d.y.alias("y"), d.scale.alias("scale"), d.opacity.alias("opacity")))
    rows = i.select("i", "phase", F.explode(F.array(*out)).alias("d"))
    return rows.groupBy("d.name").agg(*((F.round(F.sum(f"d.{c}"), 4) + 0.0).alias(c) for c in ("x", "y", "scale", "opacity")))


def f23_animation_window(spark, sf):
    return packed(spark, sf).select("clip_id", L.window_ticks(F.col("dur_tick"), 30, 1).alias("window"), L.window_ticks(F.col("dur_tick"), 30, 1, 2.0).alias("fast"))


QUERIES = {f.__name__: f for f in (e1_place_media, e8_retime, e12_move_track, e14_move_effect, e16_set_values, e17_slot_windows, j11_nearest_junction, j13_catalogs, f14_speed_presets, f23_animation_window, f24_animations, f25_characters, f25_character_combos)}

_LOCAL = "greatest(0, least(1, (0.4::DOUBLE - i / n::DOUBLE * 0.45) / 0.55))"
_BOUNCE = """CASE WHEN p < 1 / 2.75::DOUBLE THEN 7.5625 * p * p WHEN p < 2 / 2.75::DOUBLE THEN 7.5625 * (p - 1.5 / 2.75::DOUBLE) ** 2 + 0.75
      WHEN p < 2.5 / 2.75::DOUBLE THEN 7.5625 * (p - 2.25 / 2.75::DOUBLE) ** 2 + 0.9375 ELSE 7.5625 * (p - 2.625 / 2.75::DOUBLE) ** 2 + 0.984375 END"""
#: y, scale, turn and opacity of each animation at t; w and h are a whole and half a wave of it.
_LOOKS = {
    "fade_in": ("0", "1", "0", "t"),
    "slide_up": ("(1 - t) * 0.18", "1", "0", "t"),
    "zoom_in": ("0", "0.25 + 0.75 * t", "0", "t"),
    "spin_in": ("0", "0.5 + 0.5 * t", "(1 - t) * -360", "t"),
    "bounce": ("(1 - t) * 0.18 * 0.35", "(" + re.sub(r"\bp\b", "t", _BOUNCE) + ")", "0", "t"),
    "fade_out": ("0", "1", "0", "1 - t"),
    "slide_down": ("t * 0.18", "1", "0", "1 - t"),
    "zoom_out": ("0", "1 - 0.75 * t", "0", "1 - t"),
    "spin_out": ("0", "1 - 0.5 * t", "t * 360", "1 - t"),
    "drop": ("t * 0.18 * 1.4", "1 - 0.35 * t", "0", "1 - t"),
    "pulse": ("0", "1 + 0.08 * w", "0", "1"),
    "rock": ("0", "1", "6 * w", "1"),
    "swing": ("0", "1", "12 * h", "1"),
    "flicker": ("0", "1", "0", "CASE WHEN t * 8 % 1 < 0.5 THEN 1 ELSE 0.35 END"),
    "breathe": ("0", "1 + 0.05 * w", "0", "0.85 + 0.15 * (h + 1) * 0.5"),
}
#: x, y, scale and opacity of each character animation at a phase p, for a character at f of the text.
_COMBOS = {
    "typewriter": ("0", "0", "1", "CASE WHEN (least(p / 0.85, 1) - f * 0.6) / 0.4 > 0 THEN 1 ELSE 0 END"),
    "text_fade": ("0", "0", "1", "0.55 + 0.45 * (sin(p * pi() + f * 2) * 0.5 + 0.5)"),
    "text_bounce": ("0", "abs(w) * 6", "1 + 0.08 * abs(w)", "1"),
    "text_slide": ("w * 5", "0", "1", "1"),
    "pop": ("0", "0", "1 + 0.18 * greatest(sin((p + f) * pi()), 0)", "1"),
    "wave": ("0", "w * 8", "1", "1"),
    "char_jitter": ("((n - trunc(n)) * 2 - 1) * 2.5", "((n * 1.37 - trunc(n * 1.37)) * 2 - 1) * 2.5", "1", "1"),
    "char_pulse": ("0", "0", "1 + 0.12 * sin(p * 2 * pi() + f * 3)", "1"),
}
ORACLE_SQL = {
    "e1_place_media": f"""WITH {PACKED}, {MEDIA}, r AS (SELECT clip_id, media_id, line * 20 - 40 AS s, dur_tick * 25 - 100 AS d, start_tick FROM packed),
      j AS (SELECT *, CASE WHEN duration_ticks IS NULL THEN 'unknown media' WHEN d <= 0 THEN 'empty range' WHEN s < 0 OR (NOT is_image AND s + d > duration_ticks) THEN 'source out of bounds' END AS reason,
        greatest(1, (d * rate_den * 24 + rate_num // 2) // rate_num) AS dur FROM r LEFT JOIN media USING (media_id))
      SELECT clip_id, CASE WHEN reason IS NULL THEN dur END AS dur_tick, reason FROM j""",
    "e8_retime": f"""WITH {PACKED}, c AS (SELECT *, line - 1 AS num, lead(start_tick) OVER (PARTITION BY track_id ORDER BY start_tick, clip_id) AS nx FROM packed),
      d AS (SELECT *, CASE WHEN num > 0 THEN greatest(1, dur_tick * 2 // num) END AS nd FROM c), r AS (SELECT *, CASE WHEN num IS NULL THEN NULL WHEN num <= 0 THEN 'speed must be positive' WHEN start_tick + nd > nx THEN 'overlap' END AS reason FROM d)
      SELECT clip_id, CASE WHEN num IS NOT NULL AND reason IS NULL THEN nd ELSE dur_tick END AS dur_tick, reason FROM r""",
    "e12_move_track": f"""WITH {TRACKS}, o AS (SELECT track_id, kind, row_number() OVER (ORDER BY CASE WHEN track_id = 5 THEN 1.5 ELSE order_idx END, track_id) - 1 AS o FROM tracks),
      m AS (SELECT *, kind = 'video' AND o = min(o) FILTER (WHERE kind = 'video') OVER () AS main FROM o)
      SELECT track_id, row_number() OVER (ORDER BY CASE WHEN main THEN 1 WHEN kind = 'audio' THEN 0 WHEN kind = 'text' THEN 3 ELSE 2 END, o) - 1 AS order_idx FROM m""",
    "e14_move_effect": """WITH e AS (SELECT DISTINCT l_suppkey AS clip_id, l_linenumber::BIGINT AS effect FROM lineitem), p AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY effect) - 1 AS p, clip_id % 4 AS a, clip_id % 3 AS b FROM e)
      SELECT clip_id, CASE WHEN p = a THEN b WHEN a < b AND p > a AND p <= b THEN p - 1 WHEN b < a AND p >= b AND p < a THEN p + 1 ELSE p END AS position, effect FROM p""",
    "e16_set_values": f"WITH {TRACKS} SELECT track_id, CASE WHEN track_id % 3 = 0 THEN 'renamed' ELSE name END AS name, CASE WHEN track_id % 6 = 0 THEN true ELSE muted END AS muted FROM tracks",
    "e17_slot_windows": f"""WITH {PACKED}, {MEDIA}, s AS (SELECT *, line * 400 AS ss, greatest(1, (dur_tick * 1001 * line * rate_num + 30000 * 2 * rate_den - 1) // (30000 * 2 * rate_den))::BIGINT AS src_dur FROM packed JOIN media USING (media_id))
      SELECT clip_id, src_dur, CASE WHEN reversed THEN 'retimed slot' WHEN NOT is_image AND ss + src_dur > duration_ticks THEN 'media too short' END AS reason FROM s""",
    "j11_nearest_junction": f"""WITH {PACKED}, n AS (SELECT *, lead(clip_id) OVER w AS r, lead(start_tick) OVER w AS rs FROM packed WINDOW w AS (PARTITION BY track_id ORDER BY start_tick, clip_id)),
      c AS (SELECT track_id, clip_id AS left_id, r AS right_id, rs AS cut FROM n WHERE rs = start_tick + dur_tick), p AS (SELECT o_orderkey AS probe, o_orderkey % 90 + 1 AS track_id, o_orderkey * 7 % 9000 AS t FROM orders),
      b AS (SELECT probe, left_id, right_id, cut, row_number() OVER (PARTITION BY probe ORDER BY abs(cut - t), cut, left_id, right_id) AS k FROM p JOIN c USING (track_id) WHERE abs(cut - t) <= 12)
      SELECT p.probe, left_id, right_id, cut FROM p LEFT JOIN b ON p.probe = b.probe AND k = 1""",
    "j13_catalogs": f"""WITH {PACKED}, n(kind, n) AS (VALUES ('effect', 12), ('transition', 8), ('filter', 10), ('blend', 13), ('mask', 6)),
      a AS (SELECT {list(_KINDS)}[clip_id % 5 + 1] AS kind, clip_id // 5 % 15 AS p FROM packed)
      SELECT kind, count(*) AS asked, count(*) FILTER (WHERE p < n) AS found, count(DISTINCT p) FILTER (WHERE p < n) AS ids FROM a JOIN n USING (kind) GROUP BY kind""",
    # the area of each piece: its width times the first value and the easing's share of the step
    "f14_speed_presets": f"""WITH {PACKED}, k(p, q, v, e) AS (VALUES {', '.join(f"('{n}', {q!r}::DOUBLE, {v!r}::DOUBLE, '{e}')" for n, own in catalogs.SPEED_PRESETS.items() for q, v, e in own)}), s AS (SELECT *, lead(q) OVER w AS nq, lead(v) OVER w AS nv FROM k WINDOW w AS (PARTITION BY p ORDER BY q)),
      a AS (SELECT p AS param_id, round(sum((nq - q) * (v + (nv - v) * CASE e WHEN 'ease_in' THEN 1 / 3.0::DOUBLE WHEN 'ease_out' THEN 2 / 3.0::DOUBLE ELSE 0.5 END)), 9) AS average FROM s GROUP BY p)
      SELECT param_id, average, count(*) AS clips, sum(floor(dur_tick / average))::BIGINT AS ticks FROM packed JOIN a ON param_id = {sorted(catalogs.SPEED_PRESETS)}[clip_id % {len(catalogs.SPEED_PRESETS)} + 1] GROUP BY ALL""",
    "f24_animations": f"""WITH p AS (SELECT k / 40.0::DOUBLE AS t, k FROM (SELECT DISTINCT l_orderkey % 41 AS k FROM lineitem)), w AS (SELECT *, sin(t % 1 * 2 * pi()) AS w, sin(t % 1 * pi()) AS h FROM p),
      d(t, name, x, y, s, r, o) AS ({' UNION ALL '.join(f"SELECT t, '{n}', 0.0::DOUBLE, {y}, {s}, {r}, {o} FROM w" for n, (y, s, r, o) in _LOOKS.items())})
      SELECT t, name, round(x * 1.5, 9) + 0.0 AS x, round(y * 1.5, 9) + 0.0 AS y, round(1 + (s - 1) * 1.5, 9) AS scale, round(r * 1.5, 9) + 0.0 AS turn, round(1 + (o - 1) * 1.5, 9) AS opacity FROM d""",
    "f25_character_combos": f"""WITH c AS (SELECT i, p / 10.0::DOUBLE AS p, i / 20.0::DOUBLE AS f FROM (SELECT DISTINCT l_orderkey % 20 AS i, l_partkey % 10 AS p FROM lineitem)), w AS (SELECT *, sin((p + f) * 2 * pi()) AS w, sin(i * 12.9898::DOUBLE + floor(p * 12) * 78.233::DOUBLE) * 43758.547::DOUBLE AS n FROM c),
      d(name, x, y, s, o) AS ({' UNION ALL '.join(f"SELECT '{n}', {x}, {y}, {s}, {o} FROM w" for n, (x, y, s, o) in _COMBOS.items())})
      SELECT name, round(sum(x), 4) + 0.0 AS x, round(sum(y), 4) + 0.0 AS y, round(sum(s), 4) AS scale, round(sum(o), 4) AS opacity FROM d GROUP BY name""",
    "f23_animation_window": f"WITH {PACKED}, w AS (SELECT clip_id, greatest(1, least(15, dur_tick // 2)) AS w FROM packed) SELECT clip_id, w AS \"window\", greatest(1, round(w / 2.0::DOUBLE))::BIGINT AS fast FROM w",
    "f25_characters": f"""WITH c AS (SELECT conv_id, turn, length(text) AS n, unnest(range(0, length(text))) AS i FROM conversations WHERE length(text) > 0), p AS (SELECT *, {_LOCAL} AS p FROM c)
      SELECT conv_id, turn, round(sum(p), 6) AS progress, round(sum((1 - p) * 18), 6) AS y, round(sum(0.4 + 0.6 * ({_BOUNCE})), 6) AS scale FROM p GROUP BY ALL""",
}
