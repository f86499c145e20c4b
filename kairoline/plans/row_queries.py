"""Queries of single operators that others build on, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import easing as E
from ..functions import shapes as G
from ..functions import styles
from ..functions import timeexpr as X
from ..operators import audio as A
from ..operators import catalogs, edits
from ..operators import introspect as I
from ..operators import moments as M
from ..operators import params as P
from ..operators import shots as S
from ..operators import timeline as T
from . import look_queries as looks
from . import signal_queries as sound
from .fixtures import EASINGS, KEYFRAMES, MEDIA, MOMENTS, PACKED, PCM, PIXELS, RATE, TRACKS, keyframes, media, moments, packed, pcm, pixels, table, tracks


def _curve(spark, sf):
    """Each parameter's keyframes spread over a speed curve's thousand ticks."""
    w = Window.partitionBy("param_id").orderBy("tick")
    k = keyframes(spark, sf).withColumn("n", F.row_number().over(w) - 1).withColumn("all", F.count("*").over(Window.partitionBy("param_id")))
    return k.select("param_id", F.floor((2 * F.col("n") + 1) * 500 / F.col("all")).cast("long").alias("tick"), (F.col("value") % 7 + 1).cast("double").alias("value"), "easing")


_CURVE = f"""{KEYFRAMES}, k AS (SELECT param_id, (2 * n + 1) * 500 // c AS tick, (value % 7 + 1)::DOUBLE AS v, easing FROM (SELECT *, row_number() OVER (PARTITION BY param_id ORDER BY tick) - 1 AS n, count(*) OVER (PARTITION BY param_id) AS c FROM keyframes))"""


def _orders(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"))


# sound and pictures


def g7_peak_rate(spark, sf):
    rate = A.realized_rate((F.col("media_id") % 50 + 1).cast("double"), 5000, F.col("duration_ticks") * 10)
    return media(spark, sf).select("media_id", F.round(rate, 9).alias("per_second"))


def g9_word_times(spark, sf):
    """Words of one conversation turn, with the mean of their tokens' probabilities, put together."""
    return looks.words(spark, sf).groupBy("conv_id").agg(F.count("*").alias("words"), F.round(F.sum("probability"), 6).alias("probability"), F.min("start_cs").alias("first"), F.max("end_cs").alias("last"))


def g16_clear_report(spark, sf):
    """What a clearing of the oldest files removes and retains."""
    files = packed(spark, sf).select("track_id", F.col("clip_id").alias("path"), F.col("dur_tick").alias("bytes"), F.col("start_tick").alias("mtime"), (F.col("line") == 4).alias("protected"))
    gone = I.evict_oldest(files, 5000, ["track_id"]).select("track_id", "path", F.lit(True).alias("gone"))
    j = files.join(gone, ["track_id", "path"], "left")
    removed = F.col("gone").isNotNull()
    return j.groupBy("track_id").agg(F.count_if(removed).alias("removed"), F.coalesce(F.sum(F.when(removed, F.col("bytes"))), F.lit(0)).alias("freed"), F.coalesce(F.sum(F.when(~removed, F.col("bytes"))), F.lit(0)).alias("retained"))


def g17_warp_bounds(spark, sf):
    spans = packed(spark, sf).select(F.col("clip_id").alias("span_id"), F.col("dur_tick").alias("length"), F.col("line").alias("num"), F.lit(4).alias("den"))
    return A.warp_bounds(spans, 16)


def g19_histogram_distance(spark, sf):
    w = Window.partitionBy("media_id").orderBy("t")
    f = S.features(pixels(spark, sf), sound.SHOTS).withColumn("before", F.lag("hist").over(w)).where("before IS NOT NULL")
    return f.select("media_id", "t", F.round(S.histogram_distance(F.col("before"), F.col("hist"), F.col("n"), sound.SHOTS.bins), 9).alias("distance"))


def a1_window_frames(spark, sf):
    m = media(spark, sf)
    return m.select("media_id", A.duration_to_frames(0.25, 25, F.col("duration_ticks") % 13).alias("few"), A.duration_to_frames(0.02, 20, F.col("duration_ticks")).alias("least"), A.duration_to_frames(3600.0, 25, F.col("duration_ticks")).alias("every"))


def a2_window_grid(spark, sf):
    w = A.energy_windows(pcm(spark, sf), A.Loudness(0.05, 0.02), RATE)
    return w.groupBy("media_id").agg(F.count("*").alias("windows"), F.count_if(~F.col("full")).alias("partial"), F.max("end_frame").cast("long").alias("last"))


def a5_merge_islands(spark, sf):
    spans = packed(spark, sf).select("track_id", F.col("start_tick").alias("a"), (F.col("start_tick") + F.col("dur_tick")).alias("b"))
    return A.merge_islands(spans, "track_id", 0, 60)


def a6_onset_flux(spark, sf):
    f = A.onset_flux(pcm(spark, sf), sound.BEATS.loudness, RATE)
    return f.select("media_id", F.col("win").cast("long").alias("win"), F.round("flux", 2).alias("flux"))


def a10_pixel_difference(spark, sf):
    w = Window.partitionBy("media_id").orderBy("t")
    f = S.features(pixels(spark, sf), sound.SHOTS).withColumn("p", F.lag(F.struct("luma_sum", "sampled")).over(w)).where("p IS NOT NULL")
    shift = (F.col("luma_sum") - F.col("p.luma_sum")) / F.col("n").cast("double")
    return f.select("media_id", "t", F.round(S.pixel_difference(F.col("p.sampled"), F.col("sampled"), shift, F.col("n")), 9).alias("difference"))


def f17_pan(spark, sf):
    left, right = A.pan_gains(F.col("k") % 201 / 100.0 - 1.0)
    return _orders(spark, sf).select("k", F.round(left, 9).alias("left"), F.round(right, 9).alias("right"))


def f19_warped_frame(spark, sf):
    at = A.warped_frame(F.col("k"), F.col("k") % 7 + 1, F.col("k") % 3 + 1)
    return _orders(spark, sf).select("k", F.round(at, 6).alias("frame"))


# time and parameters


def f1_lerp(spark, sf):
    t = F.col("k") % 101 / 100.0
    a, b = F.array(F.col("k") % 256, F.col("k") % 100), F.array(F.col("k") * 7 % 256, 255 - F.col("k") % 100)
    colour = E.lerp_colour(a, b, t)
    return _orders(spark, sf).select("k", F.round(E.lerp(F.col("k").cast("double"), F.col("k") * 0.5 - 3.0, t), 6).alias("value"), colour[0].cast("long").alias("r"), colour[1].cast("long").alias("g"))


def f3_easing_area(spark, sf):
    t = F.col("k") % 1000 / 999.0
    return _orders(spark, sf).select("k", *(F.round(E.integral(F.lit(n), t), 9).alias(n) for n in EASINGS))


def f6_arc_length(spark, sf):
    point = lambda a, b: F.array((F.col(a) % 97).cast("double"), (F.col(b) % 89).cast("double"))
    t = E.arc_table(point("media_id", "width"), point("width", "height"), point("height", "duration_ticks"), point("duration_ticks", "media_id"))
    return media(spark, sf).select("media_id", t.alias("t")).select("media_id", F.round(F.col("t")[8], 6).alias("half"), F.round(F.col("t")[16], 6).alias("whole"))


def f8_shift_ticks(spark, sf):
    k = keyframes(spark, sf)
    moves = k.select("param_id").distinct().select("param_id", F.when(F.col("param_id") % 2 == 0, F.lit(2**63 - 1 - 2000)).otherwise(F.col("param_id") % 100).alias("delta"))
    return P.map_ticks(P.shift_ticks(k, moves).where("NOT shifted OR param_id % 2 = 1"), 30000, 1001).select("param_id", "tick", "shifted")


def f10_source_fraction(spark, sf):
    return P.source_fraction(_curve(spark, sf), 0.3).select("param_id", F.round("fraction", 8).alias("fraction"))


def f11_source_tick(spark, sf):
    c = packed(spark, sf).select("*", F.posexplode(F.array(F.lit(-1).cast("long"), F.lit(0).cast("long"), F.floor(F.col("dur_tick") / 2), F.col("dur_tick") - 1, F.col("dur_tick"))).alias("i", "rel"))
    tick = X.source_tick(F.col("start_tick") + F.col("rel"), F.col("start_tick"), F.col("dur_tick"), F.col("line") * 10, F.col("dur_tick") * 3, F.lit(7).cast("long"), F.lit(2).cast("long"), F.col("reversed"), F.col("line") == 5)
    return c.select("clip_id", F.col("i").cast("long").alias("i"), tick.alias("tick"))


def f13_retimed_duration(spark, sf):
    plain = X.retimed_duration(F.col("dur_tick"), F.col("line"), F.lit(3).cast("long"))
    curved = X.retimed_duration(F.col("dur_tick"), F.col("line"), F.lit(3).cast("long"), F.lit(1.3))
    return packed(spark, sf).select("clip_id", plain.alias("plain"), curved.alias("curved"))


def f15_split_curve(spark, sf):
    curve = _curve(spark, sf).withColumn("easing", F.lit("linear"))
    splits = curve.select("param_id").distinct().withColumn("place", F.lit(0.5))
    parts = P.split_curves(curve, splits)
    return parts.select("param_id", F.col("part").cast("long").alias("part"), "tick", (F.floor(F.col("value") * 1000 + 0.4567) / 1000).alias("value"))


def f22_pitch(spark, sf):
    factor = X.pitch_factor(F.col("line"), F.lit(2), 1.0 + F.col("line") / 8.0, F.col("reversed"))
    return packed(spark, sf).select("clip_id", F.round(factor, 9).alias("factor"))


def f27_canvas_fit(spark, sf):
    out = {f"s{w}_{h}": I.fit_scale(F.col("width").cast("double"), F.col("height").cast("double"), *(F.lit(float(x)) for x in I.canvas(w, h))) for w, h in ((16, 9), (9, 16), (1, 1), (4, 5), (21, 9))}
    return media(spark, sf).select("media_id", *(F.round(c, 9).alias(n) for n, c in out.items()))


def f34_reduced(spark, sf):
    k = F.col("k").cast("decimal(38,0)")  # the products outgrow longs from a key of 5 million on
    r = X.reduced_products(k * 720_720_000_017, k * k * 360_360)
    return _orders(spark, sf).select("k", r["num"].alias("num"), r["den"].alias("den"))


def f35_slot_window(spark, sf):
    """Slots at a rate of 24, filled from media at their own rates."""
    s = packed(spark, sf).join(media(spark, sf), "media_id").select("clip_id", "dur_tick", F.lit(3).cast("long").alias("num"), F.col("line").alias("den"), F.lit(False).alias("reversed"), "rate_num", "rate_den", F.col("duration_ticks").alias("most"), "is_image", (F.col("line") * 100).alias("src_start"))
    return edits.slot_windows(s, (24, 1)).select("clip_id", "src_dur", "reason")


def j8_bracket(spark, sf):
    at = table(spark, sf, "orders").select(F.col("o_custkey").alias("param_id"), F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") * 17 % 2600).cast("double").alias("t"))
    return P.bracket(keyframes(spark, sf), at).select("probe", F.col("before.tick").cast("long").alias("before"), F.col("after.tick").cast("long").alias("after"))


def p4_seconds_to_ticks(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("s"))
    huge = X.seconds_to_ticks(F.col("s") * 1e9, F.lit(30000), F.lit(1001))
    return o.select("k", X.seconds_to_ticks(F.col("s"), F.lit(30000), F.lit(1001)).alias("tick"), huge.alias("huge"))


# colours and shapes


def c2_effective_grade(spark, sf):
    names = sorted(C.FILTERS)
    name = F.element_at(F.array(*map(F.lit, names)), (F.col("media_id") % len(names) + 1).cast("int"))
    grade = C.effective_grades(name, F.col("width") % 11 / 10.0, {"contrast": F.col("height") % 7 / 3.0 - 1.0, "hue": F.lit(0.25)})
    m = media(spark, sf).select("media_id", name.alias("name"), grade.alias("g"))
    return m.select("media_id", "name", *(F.round(F.col(f"g.{c}"), 9).alias(c) for c in ("brightness", "contrast", "saturation", "temperature", "tint", "hue")), C.is_identity(F.col("g")).alias("identity"))


def c9_transitions(spark, sf):
    a, b = tuple(F.col(c) / 255.0 for c in "rgb"), tuple(F.col(c) / 255.0 for c in "gbr")
    progress = F.col("t") % 10 / 10.0
    fade, wipe = C.crossfade(a, b, progress), C.wipe(a, b, (F.col("x") + 0.5) / 8.0, progress)
    return pixels(spark, sf).groupBy("media_id", "t").agg(F.round(F.sum(fade[0]), 6).alias("fade"), F.round(F.sum(wipe[2]), 6).alias("wipe"))


def c10_sharpen(spark, sf):
    """Each pixel away from the mean of the four around it; the edge repeats."""
    p = pixels(spark, sf).withColumn("v", F.col("g") / 255.0)
    row, column = Window.partitionBy("media_id", "t", "y").orderBy("x"), Window.partitionBy("media_id", "t", "x").orderBy("y")
    near = [F.coalesce(f("v").over(w), F.col("v")) for w in (row, column) for f in (F.lag, F.lead)]
    sharp = p.withColumn("mean", (near[0] + near[1] + near[2] + near[3]) / 4.0).withColumn("s", C.sharpen(F.col("v"), F.col("mean"), 0.8))
    return sharp.groupBy("media_id", "t").agg(F.round(F.sum("s"), 6).alias("s"))


def c11_arrow(spark, sf):
    x, y = F.col("x"), F.col("y")
    wide, high = (G.polygon(x, y, G.arrow_points(half)) for half in ((28.0, 12.0), (10.0, 24.0)))
    return looks._grid(spark, sf).agg(F.round(F.sum(G.coverage(wide)), 6).alias("wide"), F.round(F.sum(G.coverage(high)), 6).alias("high"), F.count_if(wide <= 0).alias("hits"))


def c13_layer_styles(spark, sf):
    shadow = F.when(F.col("media_id") % 3 == 0, F.struct(F.lit(6.0).alias("offset_x"), (F.col("width") % 9).cast("double").alias("offset_y"), F.lit(12.0).alias("blur")))
    glow = F.when(F.col("media_id") % 4 == 0, F.struct((F.col("height") % 30).cast("double").alias("radius"), F.lit(0.8).alias("intensity")))
    s = styles.scaled(F.col("s"), {"shadow": ("offset_x", "offset_y", "blur"), "glow": ("radius", "intensity")}, F.col("height"))
    m = media(spark, sf).withColumn("s", F.struct(shadow.alias("shadow"), glow.alias("glow"))).select("media_id", s.alias("s"))
    return m.select("media_id", F.col("s").isNull().alias("plain"), F.round("s.shadow.offset_x", 6).alias("offset_x"), F.round("s.shadow.offset_y", 6).alias("offset_y"), F.round("s.shadow.blur", 6).alias("blur"), F.round("s.glow.radius", 6).alias("radius"), F.col("s.glow.intensity").alias("intensity"))


def c14_pack_parameters(spark, sf):
    v = C.packed_parameters(["scalar", "vec2", "colour"], [F.col("k") % 64, F.array(F.col("k") % 10 / 10.0, F.lit(0.5)), F.array(*(F.col("k") * m % 256 for m in (1, 3, 7, 11)))])
    return _orders(spark, sf).select("k", v.alias("v")).select("k", F.size("v").cast("long").alias("n"), *(F.round(F.col("v")[i], 9).alias(f"v{i}") for i in range(7)))


# edits


def e2_duplicate(spark, sf):
    c = packed(spark, sf).select("clip_id", "track_id", "start_tick", "dur_tick", "link")
    copies = c.select("clip_id", (F.col("clip_id") + 1_000_000_000).alias("new_id"), (F.col("track_id") + 1_000_000).alias("to_track"), (F.col("start_tick") + 5).alias("to_start"))
    return edits.duplicate_all(c, copies)


def e5_move(spark, sf):
    c = packed(spark, sf).select("clip_id", "track_id", "start_tick", "dur_tick", "line")
    moves = c.where("line = 7").select("clip_id", (F.col("track_id") + 7).alias("to_track"), (F.col("start_tick") - 40 + F.col("dur_tick") * 3).alias("to_start"))
    content = F.when(F.col("line") == 7, F.when(F.col("dur_tick") % 2 == 0, "media_video").otherwise("text"))
    return edits.move_all(c, tracks(spark, sf), moves, content).select("clip_id", "track_id", "start_tick", "reason")


def e15_transitions(spark, sf):
    c = packed(spark, sf)
    nxt = F.lead("clip_id").over(Window.partitionBy("track_id").orderBy("start_tick", "clip_id"))
    pairs = c.select(F.col("clip_id").alias("left_id"), nxt.alias("right_id")).where("right_id IS NOT NULL")
    old = edits.prune_transitions(pairs.where("left_id % 2 = 0").withColumn("name", F.lit("crossfade")).withColumn("duration", F.lit(9).cast("long")), c)
    new = pairs.where("left_id % 3 = 0").withColumn("name", F.lit("wipe_left")).withColumn("duration", F.col("left_id") % 5)
    return edits.upsert_transitions(old, c, new)


def e20_insertion(spark, sf):
    drops = table(spark, sf, "orders").select(F.col("o_orderkey").alias("drop_id"), (F.col("o_orderkey") % 90 + 1).alias("track_id"), (F.col("o_orderkey") * 7 % 20000).alias("at"))
    return edits.insertion_slots(drops, packed(spark, sf))


def e20_trim(spark, sf):
    c = packed(spark, sf).select("clip_id", "track_id", "start_tick", "dur_tick", "link", (F.col("line") * 3).alias("head_room"), (F.col("dur_tick") % 9).alias("tail_room"))
    drags = c.where("clip_id % 8 = 1").select("clip_id", (F.col("dur_tick") % 2 == 0).alias("head"), (F.col("start_tick") % 41 - 20).alias("delta"))
    return edits.resolve_trims(c, drags)


# the rest


def m3_query_builder(spark, sf):
    q = M.MomentQuery().with_kind("purchase").with_minimum_confidence(0.5).with_time_range(0.0, 1.7055e9)
    return moments(spark, sf).where(q.predicate()).select("event_id")


def p7_track_kinds(spark, sf):
    return tracks(spark, sf).groupBy("kind").agg(F.max(F.col("kind").isin(*T.VISUAL)).alias("visual"), F.count("*").alias("tracks"))


def s10_frame_before(spark, sf):
    frames = packed(spark, sf).where("line <> 3").select("track_id", F.col("start_tick").alias("pts"))
    wanted = table(spark, sf, "orders").select((F.col("o_orderkey") % 50 + 1).alias("track_id"), F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") * 13 % 20000).alias("t"))
    return I.frame_before(wanted, frames, ["track_id"]).select("probe", "pts")


def x9_arrays(spark, sf):
    """Retained, unlike, sorted, in pairs, zipped and looked for."""
    a = F.array(*(F.col("k") * m % 11 for m in (1, 3, 5, 7, 9)))
    kept = F.filter(a, lambda x: x > 2)
    pairs = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.element_at(a, i + 1) - F.element_at(a, i))
    zipped = F.zip_with(a, F.reverse(a), lambda x, y: x * y)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _orders(spark, sf).select("k", text(F.array_sort(F.array_distinct(kept))).alias("kept"), text(pairs).alias("steps"), F.aggregate(zipped, F.lit(0).cast("long"), lambda s, x: s + x).alias("product"), F.array_position(a, F.lit(4).cast("long")).alias("at"))


QUERIES = {f.__name__: f for f in (g7_peak_rate, g9_word_times, g16_clear_report, g17_warp_bounds, g19_histogram_distance, a1_window_frames, a2_window_grid, a5_merge_islands, a6_onset_flux, a10_pixel_difference, f17_pan, f19_warped_frame, f1_lerp, f3_easing_area, f6_arc_length, f8_shift_ticks, f10_source_fraction, f11_source_tick, f13_retimed_duration, f15_split_curve, f22_pitch, f27_canvas_fit, f34_reduced, f35_slot_window, j8_bracket, p4_seconds_to_ticks, c2_effective_grade, c9_transitions, c10_sharpen, c11_arrow, c13_layer_styles, c14_pack_parameters, e2_duplicate, e5_move, e15_transitions, e20_insertion, e20_trim, m3_query_builder, p7_track_kinds, s10_frame_before, x9_arrays)}

_ARC = lambda a, i: f"((1 - {i}) ** 3 * {a[0]} + 3 * (1 - {i}) ** 2 * {i} * {a[1]} + 3 * (1 - {i}) * {i} ** 2 * {a[2]} + {i} ** 3 * {a[3]})"
_X, _Y = ("x0", "x1", "x2", "x3"), ("y0", "y1", "y2", "y3")
_RECIPES = ", ".join(f"('{n}', {', '.join(repr(float(own.get(c, 0.0))) + '::DOUBLE' for c in ('brightness', 'contrast', 'saturation', 'temperature', 'tint'))})" for n, own in C.FILTERS.items())
_PART = lambda c, extra: f"round(greatest(-1, least(1, {c} * i + {extra})), 9) AS {c}"

ORACLE_SQL = {
    "g7_peak_rate": f"WITH {MEDIA}, c AS (SELECT media_id, greatest(1, floor(48000 / (media_id % 50 + 1)::DOUBLE + 0.5)) AS c, duration_ticks * 10 AS n FROM media) SELECT media_id, round(48000 / c * CASE WHEN n <= 5000 THEN 1 ELSE 5000.0::DOUBLE / n END, 9) AS per_second FROM c",
    "g9_word_times": f"WITH {looks._WORDS} SELECT conv_id, count(*) AS words, round(sum(probability), 6) AS probability, min(start_cs) AS first, max(end_cs) AS last FROM words GROUP BY ALL",
    "g16_clear_report": f"""WITH {PACKED}, f AS (SELECT *, line <> 4 AND sum(dur_tick) FILTER (WHERE line <> 4) OVER (PARTITION BY track_id) - coalesce(sum(dur_tick) FILTER (WHERE line <> 4) OVER (PARTITION BY track_id ORDER BY start_tick, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 5000 AS gone FROM packed)
      SELECT track_id, count(*) FILTER (WHERE gone) AS removed, coalesce(sum(dur_tick) FILTER (WHERE gone), 0)::BIGINT AS freed, coalesce(sum(dur_tick) FILTER (WHERE NOT gone), 0)::BIGINT AS retained FROM f GROUP BY ALL""",
    "g17_warp_bounds": f"""WITH {PACKED}, r AS (SELECT clip_id AS span_id, unnest(range(0, dur_tick)) AS rel, line FROM packed)
      SELECT span_id, rel // 16 AS block, min(floor(rel * line / 4.0::DOUBLE))::BIGINT AS low, max(ceil(rel * line / 4.0::DOUBLE))::BIGINT + 1 AS high FROM r GROUP BY ALL""",
    "g19_histogram_distance": f"WITH {PIXELS}, {sound._SCORE} SELECT media_id, t, round(moved / (64.0::DOUBLE * 15), 9) AS distance FROM em",
    "a1_window_frames": f"""WITH {MEDIA}, n AS (SELECT media_id, duration_ticks AS d, duration_ticks % 13 AS e FROM media)
      SELECT media_id, CASE WHEN e = 0 THEN 0 WHEN 6.25 >= e THEN e ELSE 6 END AS few, CASE WHEN d = 0 THEN 0 WHEN 0.4 >= d THEN d ELSE 1 END AS least, CASE WHEN 90000 >= d THEN d ELSE 90000 END AS every FROM n""",
    "a2_window_grid": f"""WITH {PCM}, n AS (SELECT media_id, max(frame) + 1 AS n FROM pcm GROUP BY ALL), g AS (SELECT media_id, n, least(n, 50) AS w, least(n, 20) AS h FROM n), k AS (SELECT *, unnest(range(0, n, h)) AS a FROM g)
      SELECT media_id, count(*) AS windows, count(*) FILTER (WHERE a + w > n) AS partial, max(least(a + w, n)) AS last FROM k GROUP BY ALL""",
    "a5_merge_islands": f"""WITH {PACKED}, s AS (SELECT track_id, start_tick AS a, start_tick + dur_tick AS b, coalesce(start_tick > lag(start_tick + dur_tick) OVER (PARTITION BY track_id ORDER BY start_tick), true) AS new FROM packed),
      i AS (SELECT *, sum(new::INT) OVER (PARTITION BY track_id ORDER BY a) AS i FROM s) SELECT track_id, min(a) AS a, max(b) AS b FROM i GROUP BY track_id, i HAVING max(b) - min(a) >= 60""",
    "a6_onset_flux": f"""{sound._PCM}{sound._windows(0.016, 0.008, RATE)}, lv AS (SELECT *, {sound._DB} AS db FROM en WHERE complete)
      SELECT media_id, win, round(coalesce(greatest(db - lag(db) OVER (PARTITION BY media_id ORDER BY win), 0), 0)::DOUBLE, 2) AS flux FROM lv""",
    "a10_pixel_difference": f"WITH {PIXELS}, {sound._SCORE} SELECT media_id, t, round(greatest(0, least(1, diff / (64 * 4.0::DOUBLE * 255))), 9) AS difference FROM pd",
    "f17_pan": 'SELECT o_orderkey AS k, round(cos(o_orderkey % 201 / 100.0::DOUBLE * pi() / 4) * sqrt(2), 9) AS "left", round(sin(o_orderkey % 201 / 100.0::DOUBLE * pi() / 4) * sqrt(2), 9) AS "right" FROM orders',
    "f19_warped_frame": "SELECT o_orderkey AS k, round(o_orderkey::DOUBLE * (o_orderkey % 7 + 1) / (o_orderkey % 3 + 1), 6) AS frame FROM orders",
    "f1_lerp": """WITH o AS (SELECT o_orderkey AS k, o_orderkey % 101 / 100.0::DOUBLE AS t FROM orders)
      SELECT k, round(k + (k * 0.5 - 3 - k) * t, 6)::DOUBLE AS value, round(k % 256 + (k * 7 % 256 - k % 256) * t)::BIGINT AS r, round(k % 100 + (255 - 2 * (k % 100)) * t)::BIGINT AS g FROM o""",
    "f3_easing_area": f"WITH o AS (SELECT o_orderkey AS k, o_orderkey % 1000 / 999.0::DOUBLE AS t FROM orders), e(e) AS (VALUES {', '.join(f'({n!r})' for n in EASINGS)}), a AS (SELECT k, e, round({looks._area('e', 't')}, 9)::DOUBLE AS a FROM o, e) SELECT k, {', '.join(f'max(a) FILTER (WHERE e = {n!r}) AS {n}' for n in EASINGS)} FROM a GROUP BY k",
    "f6_arc_length": f"""WITH {MEDIA}, p AS (SELECT media_id, (media_id % 97)::DOUBLE AS x0, (width % 89)::DOUBLE AS y0, (width % 97)::DOUBLE AS x1, (height % 89)::DOUBLE AS y1, (height % 97)::DOUBLE AS x2, (duration_ticks % 89)::DOUBLE AS y2, (duration_ticks % 97)::DOUBLE AS x3, (media_id % 89)::DOUBLE AS y3 FROM media),
      q AS (SELECT media_id, i, {_ARC(_X, '(i / 16.0::DOUBLE)')} AS x, {_ARC(_Y, '(i / 16.0::DOUBLE)')} AS y FROM p, range(0, 17) t(i)),
      d AS (SELECT media_id, i, sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2) AS d FROM q WINDOW w AS (PARTITION BY media_id ORDER BY i))
      SELECT media_id, round(sum(d) FILTER (WHERE i <= 8), 6) AS half, round(sum(d), 6) AS whole FROM d GROUP BY ALL""",
    "f8_shift_ticks": f"""WITH {KEYFRAMES}, s AS (SELECT *, param_id % 2 = 1 OR max(tick) OVER (PARTITION BY param_id) <= 2000 AS shifted FROM keyframes)
      SELECT param_id, ((CASE WHEN shifted THEN tick + param_id % 100 ELSE tick END) * 30000 // 1001)::BIGINT AS tick, shifted FROM s WHERE NOT shifted OR param_id % 2 = 1""",
    "f10_source_fraction": f"""WITH {_CURVE}, s AS (SELECT param_id, tick / 1000.0::DOUBLE AS q, lead(tick) OVER w / 1000.0::DOUBLE AS r, v, lead(v) OVER w AS nv, easing, lag(tick) OVER w IS NULL AS f FROM k WINDOW w AS (PARTITION BY param_id ORDER BY tick)), p AS (SELECT unnest([1.0::DOUBLE, 0.3::DOUBLE]) AS p),
      t AS (SELECT *, greatest(0, least(1, (p - q) / (r - q)))::DOUBLE AS t FROM s, p),
      i AS (SELECT param_id, p, sum(CASE WHEN f THEN v * least(p, q) ELSE 0 END + CASE WHEN r IS NULL THEN CASE WHEN p > q THEN v * (p - q) ELSE 0 END WHEN p > q THEN (r - q) * (v * t + (nv - v) * ({looks._area('easing', 't')})) ELSE 0 END) AS area FROM t GROUP BY ALL)
      SELECT param_id, round(min(area) FILTER (WHERE p < 1) / min(area) FILTER (WHERE p = 1), 8) AS fraction FROM i GROUP BY ALL""",
    "f11_source_tick": f"""WITH {PACKED}, c AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS i, unnest([-1, 0, dur_tick // 2, dur_tick - 1, dur_tick]) AS rel FROM packed)
      SELECT clip_id, i::BIGINT AS i, CASE WHEN rel < 0 OR rel >= dur_tick THEN NULL WHEN line = 5 THEN line * 10 ELSE greatest(line * 10, least(line * 10 + dur_tick * 3 - 1, CASE WHEN reversed THEN line * 10 + dur_tick * 3 - 1 - rel * 7 // 2 ELSE line * 10 + rel * 7 // 2 END)) END AS tick FROM c""",
    "f13_retimed_duration": f"WITH {PACKED} SELECT clip_id, greatest(1, dur_tick * 3 // line) AS plain, greatest(1, round(dur_tick * 3 / (line * 1.3::DOUBLE))::BIGINT) AS curved FROM packed",
    "f15_split_curve": f"""WITH {_CURVE}, b AS (SELECT param_id, tick, v FROM k UNION ALL SELECT param_id, -1000000, arg_min(v, tick) FROM k GROUP BY ALL UNION ALL SELECT param_id, 1000000, arg_max(v, tick) FROM k GROUP BY ALL),
      g AS (SELECT *, lead(tick) OVER w AS nt, lead(v) OVER w AS nv FROM b WINDOW w AS (PARTITION BY param_id ORDER BY tick)),
      e AS (SELECT param_id, c, v + CASE WHEN c = tick THEN 0 ELSE (nv - v) * (c - tick) / (nt - tick)::DOUBLE END AS v FROM g, (SELECT unnest([0, 500, 1000]) AS c) WHERE c >= tick AND c < nt),
      a AS (SELECT param_id, tick, v FROM k WHERE tick NOT IN (0, 500, 1000) UNION ALL SELECT * FROM e)
      SELECT param_id, 0::BIGINT AS part, (tick * 2)::BIGINT AS tick, floor(v * 1000 + 0.4567) / 1000 AS value FROM a WHERE tick <= 500 UNION ALL SELECT param_id, 1, (tick - 500) * 2, floor(v * 1000 + 0.4567) / 1000 FROM a WHERE tick >= 500""",
    "f22_pitch": f"WITH {PACKED} SELECT clip_id, round(CASE WHEN reversed THEN 1 ELSE line / 2.0::DOUBLE * (1 + line / 8.0::DOUBLE) END, 9) AS factor FROM packed",
    "f27_canvas_fit": f"WITH {MEDIA} SELECT media_id, " + ", ".join(f"round(least({w}.0::DOUBLE / width, {h}.0::DOUBLE / height), 9) AS {n}" for n, w, h in (("s16_9", 1920, 1080), ("s9_16", 1080, 1920), ("s1_1", 1080, 1080), ("s4_5", 1080, 1350), ("s21_9", 2520, 1080))) + " FROM media",
    "f34_reduced": "WITH o AS (SELECT o_orderkey AS k, o_orderkey * 720720000017 AS a, o_orderkey * o_orderkey * 360360 AS b FROM orders) SELECT k, a // greatest(gcd(a, b), 1) AS num, b // greatest(gcd(a, b), 1) AS den FROM o",
    "f35_slot_window": f"""WITH {PACKED}, {MEDIA}, s AS (SELECT *, greatest(1, (dur_tick * 3 * rate_num + 24 * line * rate_den - 1) // (24 * line * rate_den))::BIGINT AS src_dur FROM packed JOIN media USING (media_id))
      SELECT clip_id, src_dur, CASE WHEN NOT is_image AND line * 100 + src_dur > duration_ticks THEN 'media too short' END AS reason FROM s""",
    "j8_bracket": f"""WITH {KEYFRAMES}, a AS (SELECT o_orderkey AS probe, o_custkey AS param_id, (o_orderkey * 17 % 2600)::BIGINT AS t FROM orders)
      SELECT probe, max(tick) FILTER (WHERE tick <= t) AS before, min(tick) FILTER (WHERE tick > t) AS after FROM a LEFT JOIN keyframes USING (param_id) GROUP BY probe""",
    "p4_seconds_to_ticks": "WITH o AS (SELECT o_orderkey AS k, round(o_totalprice * 30000 / 1001) AS a, round(o_totalprice * 1e9::DOUBLE * 30000 / 1001) AS b FROM orders) SELECT k, a::BIGINT AS tick, CASE WHEN b <= 9007199254740992 THEN b::BIGINT END AS huge FROM o",
    "c2_effective_grade": f"""WITH {MEDIA}, r(name, brightness, contrast, saturation, temperature, tint) AS (VALUES {_RECIPES}), n AS (SELECT *, row_number() OVER (ORDER BY name) - 1 AS n FROM r),
      j AS (SELECT media_id, n.*, width % 11 / 10.0::DOUBLE AS i, height % 7 / 3.0::DOUBLE - 1 AS c FROM media JOIN n ON n = media_id % {len(C.FILTERS)})
      SELECT media_id, name, {_PART('brightness', '0')}, {_PART('contrast', 'c')}, {_PART('saturation', '0')}, {_PART('temperature', '0')}, {_PART('tint', '0')}, 0.25::DOUBLE AS hue, false AS identity FROM j""",
    "c9_transitions": f"""WITH {PIXELS} SELECT media_id, t, round(sum(r / 255.0::DOUBLE + (g - r) / 255.0::DOUBLE * (t % 10 / 10.0::DOUBLE)), 6) AS fade, round(sum(CASE WHEN (x + 0.5) / 8.0::DOUBLE <= t % 10 / 10.0::DOUBLE THEN r ELSE b END / 255.0::DOUBLE), 6) AS wipe FROM pixels GROUP BY ALL""",
    "c10_sharpen": f"""WITH {PIXELS}, n AS (SELECT p.media_id, p.t, p.g / 255.0::DOUBLE AS v, avg(q.g / 255.0::DOUBLE) AS m FROM pixels p JOIN (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) d(dx, dy) ON true JOIN pixels q ON q.media_id = p.media_id AND q.t = p.t AND q.x = greatest(0, least(7, p.x + dx)) AND q.y = greatest(0, least(7, p.y + dy)) GROUP BY p.media_id, p.t, p.x, p.y, p.g)
      SELECT media_id, t, round(sum(greatest(0, least(1, v + 0.8 * 1.5 * (v - m)))), 6) AS s FROM n GROUP BY ALL""",
    "c11_arrow": f"""WITH {looks._GRID}, e1 AS ({looks._edges('wide', [(28.0, 0.0), (16.0, -12.0), (16.0, -4.8), (-28.0, -4.8), (-28.0, 4.8), (16.0, 4.8), (16.0, 12.0)])}), e2 AS ({looks._edges('high', [(10.0, 0.0), (0.0, -24.0), (0.0, -9.6), (-10.0, -9.6), (-10.0, 9.6), (0.0, 9.6), (0.0, 24.0)])}),
      a AS ({looks._inside('wide').replace('FROM g, e ', 'FROM g, e1 ')}), b AS ({looks._inside('high').replace('FROM g, e ', 'FROM g, e2 ')})
      SELECT round(sum({looks._cov('wide', 1)}), 6) AS wide, round(sum({looks._cov('high', 1)}), 6) AS high, count(*) FILTER (WHERE wide <= 0) AS hits FROM a JOIN b USING (x, y)""",
    "c13_layer_styles": f"""WITH {MEDIA}, m AS (SELECT media_id, height / 1080.0::DOUBLE AS px, width, height, media_id % 3 = 0 AS s, media_id % 4 = 0 AS g FROM media)
      SELECT media_id, NOT s AND NOT g AS plain, CASE WHEN s THEN round(6 * px, 6) END AS offset_x, CASE WHEN s THEN round(width % 9 * px, 6) END AS offset_y, CASE WHEN s THEN round(12 * px, 6) END AS blur, CASE WHEN g THEN round(height % 30 * px, 6) END AS radius, CASE WHEN g THEN 0.8::DOUBLE END AS intensity FROM m""",
    "c14_pack_parameters": "SELECT o_orderkey AS k, 7::BIGINT AS n, (o_orderkey % 64)::DOUBLE AS v0, o_orderkey % 10 / 10.0::DOUBLE AS v1, 0.5::DOUBLE AS v2, " + ", ".join(f"round(o_orderkey * {m} % 256 / 255.0::DOUBLE, 9) AS v{i + 3}" for i, m in enumerate((1, 3, 7, 11))) + " FROM orders",
    "e2_duplicate": f"WITH {PACKED} SELECT clip_id, track_id, start_tick, dur_tick, link FROM packed UNION ALL SELECT clip_id + 1000000000, track_id + 1000000, start_tick + 5, dur_tick, NULL FROM packed",
    "e5_move": f"""WITH {PACKED}, {TRACKS}, m AS (SELECT p.clip_id, p.track_id + 7 AS tt, start_tick - 40 + dur_tick * 3 AS ts, dur_tick, kind, dur_tick % 2 = 0 AS video FROM packed p LEFT JOIN tracks t ON t.track_id = p.track_id + 7 WHERE line = 7),
      r AS (SELECT *, CASE WHEN kind IS NULL THEN 'unknown track' WHEN ts < 0 THEN 'before the start' WHEN NOT CASE WHEN video THEN kind IN ('video', 'audio') ELSE kind = 'text' END THEN 'wrong kind of track'
        WHEN EXISTS (SELECT 1 FROM packed o WHERE o.track_id = tt AND o.clip_id <> m.clip_id AND o.start_tick < ts + m.dur_tick AND ts < o.start_tick + o.dur_tick) THEN 'overlap' END AS reason FROM m)
      SELECT p.clip_id, CASE WHEN tt IS NOT NULL AND reason IS NULL THEN tt ELSE p.track_id END AS track_id, CASE WHEN tt IS NOT NULL AND reason IS NULL THEN ts ELSE p.start_tick END AS start_tick, reason FROM packed p LEFT JOIN r ON r.clip_id = p.clip_id""",
    "e15_transitions": f"""WITH {PACKED}, n AS (SELECT clip_id AS l, lead(clip_id) OVER w AS r, lead(start_tick) OVER w = start_tick + dur_tick AS touch FROM packed WINDOW w AS (PARTITION BY track_id ORDER BY start_tick, clip_id)), t AS (SELECT * FROM n WHERE touch)
      SELECT l AS left_id, r AS right_id, 'wipe_left' AS name, l % 5 AS duration FROM t WHERE l % 3 = 0 AND l % 5 >= 1 UNION ALL SELECT l, r, 'crossfade', 9 FROM t WHERE l % 2 = 0 AND NOT (l % 3 = 0 AND l % 5 >= 1)""",
    "e20_insertion": f"""WITH {PACKED}, d AS (SELECT o_orderkey AS drop_id, o_orderkey % 90 + 1 AS track_id, o_orderkey * 7 % 20000 AS pos FROM orders)
      SELECT drop_id, coalesce(min(start_tick) FILTER (WHERE pos < start_tick + dur_tick // 2), max(start_tick + dur_tick), 0) AS slot FROM d LEFT JOIN packed USING (track_id) GROUP BY drop_id""",
    "e20_trim": f"""WITH {PACKED}, l AS (SELECT clip_id, link, start_tick AS s, dur_tick AS d, greatest(coalesce(lag(start_tick + dur_tick) OVER w, 0), start_tick - line * 3, 0) - start_tick AS hl, dur_tick - 1 AS hh, 1 - dur_tick AS tl,
        least(coalesce(lead(start_tick) OVER w, 9000000000), start_tick + dur_tick + dur_tick % 9) - start_tick - dur_tick AS th FROM packed WINDOW w AS (PARTITION BY track_id ORDER BY start_tick, clip_id)),
      g AS (SELECT a.clip_id AS dragged, a.d % 2 = 0 AS head, a.s % 41 - 20 AS delta, b.* FROM l a JOIN l b ON b.link = a.link WHERE a.clip_id % 8 = 1),
      m AS (SELECT *, least(greatest(delta, max(CASE WHEN head THEN hl ELSE tl END) OVER q), min(CASE WHEN head THEN hh ELSE th END) OVER q) AS y FROM g WINDOW q AS (PARTITION BY dragged))
      SELECT dragged, clip_id, CASE WHEN head THEN s + y ELSE s END AS start_tick, CASE WHEN head THEN d - y ELSE d + y END AS dur_tick FROM m""",
    "m3_query_builder": f"WITH {MOMENTS} SELECT event_id FROM moments WHERE kind = 'purchase' AND confidence >= 0.5 AND start_seconds < 1.7055e9 AND CASE WHEN start_seconds = end_seconds THEN start_seconds >= 0 ELSE end_seconds > 0 END",
    "p7_track_kinds": f"WITH {TRACKS} SELECT kind, kind <> 'audio' AS visual, count(*) AS tracks FROM tracks GROUP BY ALL",
    "s10_frame_before": f"""WITH {PACKED} SELECT probe, start_tick AS pts FROM (SELECT o_orderkey AS probe, o_orderkey % 50 + 1 AS track_id, o_orderkey * 13 % 20000 AS t FROM orders) o
      ASOF LEFT JOIN (SELECT track_id, start_tick FROM packed WHERE line <> 3) c ON c.track_id = o.track_id AND o.t >= c.start_tick""",
    "x9_arrays": """WITH o AS (SELECT o_orderkey AS k, [o_orderkey * 1 % 11, o_orderkey * 3 % 11, o_orderkey * 5 % 11, o_orderkey * 7 % 11, o_orderkey * 9 % 11] AS a FROM orders)
      SELECT k, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: x > 2))), ',') AS kept, array_to_string([a[2] - a[1], a[3] - a[2], a[4] - a[3], a[5] - a[4]], ',') AS steps,
             (2 * a[1] * a[5] + 2 * a[2] * a[4] + a[3] * a[3])::BIGINT AS product, coalesce(list_position(a, 4), 0)::BIGINT AS at FROM o""",
}
