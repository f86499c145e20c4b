"""Queries of resampling, rulers, compositing and texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import audio as A
from ..operators import introspect as I
from ..operators import params as P
from ..operators import resolve as R
from .fixtures import EASINGS, KEYFRAMES, MEDIA, PACKED, PCM, TRACKS, keyframes, media, packed, pcm, some_ticks, table, tracks


def f20_resample(spark, sf):
    spans = packed(spark, sf).select(F.col("clip_id").alias("span_id"), (F.col("clip_id") % 10).cast("int").alias("media_id"), (F.col("start_tick") % 1000).alias("first"), F.col("dur_tick").alias("length"), F.lit(3).alias("num"), F.lit(2).alias("den"))
    return A.resample(spans, pcm(spark, sf), 256).groupBy("span_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 5).alias("total"))


def f30_ruler(spark, sf):
    m = media(spark, sf).select("media_id", ((F.col("media_id") % 400 + 1) / 50.0).alias("zoom"))
    label = I.label_step(F.col("zoom"), 30, 64.0)
    return m.select("media_id", label.alias("label"), I.dot_step(label, F.col("zoom"), 8.0).alias("dot"))


def f37_graph(spark, sf):
    k = keyframes(spark, sf)
    span = k.groupBy("param_id").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    values = P.sample_strip(k, span, 64).groupBy("param_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    r = I.padded_range(F.col("low"), F.col("high"), 0.1)
    return values.select("param_id", (F.floor(r["low"] * 10 + 0.5) / 10).alias("low"), (F.floor(r["high"] * 10 + 0.5) / 10).alias("high"))


def p8_capabilities(spark, sf):
    c = packed(spark, sf).join(tracks(spark, sf).select("track_id", "kind"), "track_id").join(media(spark, sf).select("media_id", "has_audio", "is_image"), "media_id")
    caps = I.capabilities(F.col("kind"), F.col("media_id") % 3 != 0, F.col("line") == 7, F.col("has_audio") & ~F.col("is_image"), F.col("link") % 2 == 0)
    return c.select("clip_id", caps.alias("c")).select("clip_id", "c.*")


def p9_non_default(spark, sf):
    c = packed(spark, sf)
    return c.select("clip_id", ((F.col("volume") != 1.0) | (F.col("line") > 5)).alias("custom_audio"), (F.col("volume") <= 0).alias("silent"), F.col("reversed").alias("retimed"))


def r6_overrides(spark, sf):
    c = packed(spark, sf).select("clip_id", "volume", "line")
    o = c.where("clip_id % 50 = 1").select("clip_id", F.lit(0.5).alias("volume"), F.lit(None).cast("long").alias("line"))
    return R.with_overrides(c, o, ["volume", "line"]).select("clip_id", "volume", "line")


def r2_partition_layers(spark, sf):
    ticks, c, lanes = some_ticks(spark, sf), packed(spark, sf), tracks(spark, sf)
    layers = R.layers(ticks, c, lanes)
    pick = layers.groupBy().agg(F.min(F.struct("t", "layer", "clip_id"))["clip_id"].alias("c")).first()["c"]
    # only the ticks in the clip count, so only theirs are worked out again
    return R.partition_layers(R.layers(R.ticks_of_clip(ticks, c, pick), c, lanes), pick).groupBy("t", "side").agg(F.count("*").alias("n"))


def o6_markers(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 31 % 1000).alias("tick"))
    return I.positions(o, F.col("tick"), ["tick", "id"]).select("id", "position")


def o7_slots(spark, sf):
    s = packed(spark, sf)
    order = F.col("clip_id") % 10
    first = F.min(F.struct(order.alias("o"), "clip_id"))["clip_id"]
    return s.groupBy("track_id").agg(F.count("*").alias("slots"), first.alias("music"))


def o12_lru(spark, sf):
    c = packed(spark, sf)
    w = Window.partitionBy("track_id").orderBy(F.desc("start_tick"), "clip_id")
    return c.select("clip_id", F.row_number().over(w).alias("r")).where("r > 100").select("clip_id")


def x7_commands(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("/"), "event_type", F.lit("  the rest "))).otherwise(F.col("event_type")).alias("prompt"))
    name, rest = F.regexp_extract("prompt", r"^/(\S+)\s*", 1), F.trim(F.regexp_extract("prompt", r"^/\S+\s+(.*)$", 1))
    return e.select("event_id", F.when(name.isin("view", "click"), F.replace(F.lit("do $ARGUMENTS now"), F.lit("$ARGUMENTS"), rest)).alias("expanded"))


def x8_adjust_summary(spark, sf):
    """Sliders that aren't at rest, with two digits."""
    c = packed(spark, sf).select("clip_id", ((F.col("line") - 4) / 4.0).alias("brightness"), (F.col("volume") - 0.5).alias("contrast"))
    part = lambda n: F.when(F.abs(F.col(n)) > 1e-9, F.concat(F.lit(f"{n}="), F.format_number(n, 2)))
    return c.select("clip_id", F.concat_ws(", ", part("brightness"), part("contrast")).alias("summary"))


def x10_id_map(spark, sf):
    """Number and total length of each track's clips by id, one entry for an id; ids are grouped, not gathered in a map."""
    entries = packed(spark, sf).groupBy("track_id", "clip_id").agg(F.max("dur_tick").alias("dur_tick"))
    return entries.groupBy("track_id").agg(F.count("*").alias("n"), F.sum("dur_tick").alias("total"))


def s8_bounded_read(spark, sf):
    """Media of at most 3200 frames, whole; longer ones aren't read at all."""
    p = pcm(spark, sf)
    short = p.groupBy("media_id").agg(F.count("*").alias("n")).where("n <= 3200")
    return p.join(short, "media_id", "left_semi").groupBy("media_id").agg(F.count("*").alias("frames"))


def s9_range_read(spark, sf):
    return pcm(spark, sf).where("frame BETWEEN 1000 AND 1063").groupBy("media_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("sample").cast("double")), 6).alias("total"))


def s18_content_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("content_key"))


QUERIES = {f.__name__: f for f in (f20_resample, f30_ruler, f37_graph, p8_capabilities, p9_non_default, r2_partition_layers, r6_overrides, o6_markers, o7_slots, o12_lru, x7_commands, x8_adjust_summary, x10_id_map, s8_bounded_read, s9_range_read, s18_content_key)}

_STEPS = [f for f in I.FRAME_STEPS if f < 30 and 30 % f == 0] + [s * 30 for s in I.SECOND_STEPS]


def _ease(t: str) -> str:
    return f"CASE easing WHEN 'ease_in' THEN {t} * {t} WHEN 'ease_out' THEN {t} * (2.0 - {t}) WHEN 'ease_in_out' THEN {t} * {t} * (3.0 - 2.0 * {t}) WHEN 'hold' THEN 0.0 ELSE {t} END"


assert EASINGS[-1] == "hold"
ORACLE_SQL = {
    "f20_resample": f"""WITH {PACKED}, {PCM}, s AS (SELECT clip_id AS span_id, clip_id % 10 AS media_id, start_tick % 1000 AS f, unnest(range(0, dur_tick)) AS rel FROM packed),
      q AS (SELECT *, f + rel * 3 // 2 AS fr, (rel * 3 % 2) / 2.0::DOUBLE AS part FROM s)
      SELECT span_id, count(*) AS n, round(sum(a.sample::DOUBLE + (coalesce(b.sample, a.sample)::DOUBLE - a.sample::DOUBLE) * part), 5) AS total
      FROM q JOIN pcm a ON a.media_id = q.media_id AND a.frame = fr LEFT JOIN pcm b ON b.media_id = q.media_id AND b.frame = fr + 1 GROUP BY ALL""",
    "f30_ruler": f"""WITH {MEDIA}, z AS (SELECT media_id, (media_id % 400 + 1) / 50.0::DOUBLE AS zoom FROM media), l AS (SELECT *, coalesce(list_filter({_STEPS}, lambda s: s * zoom >= 64)[1], {_STEPS[-1]})::BIGINT AS label FROM z)
      SELECT media_id, label, (label // list_filter({list(I.PARTS)}, lambda p: label % p = 0 AND label // p * zoom >= 8)[1])::BIGINT AS dot FROM l""",
    "f37_graph": f"""WITH {KEYFRAMES}, k AS (SELECT * FROM keyframes), seg AS (SELECT *, lead(tick) OVER w AS nt, lead(value) OVER w AS nv FROM k WINDOW w AS (PARTITION BY param_id ORDER BY tick)),
      sp AS (SELECT param_id, min(tick)::DOUBLE AS a, max(tick)::DOUBLE AS b FROM k GROUP BY ALL), ats AS (SELECT param_id, CASE i WHEN 0 THEN a WHEN 63 THEN b ELSE a + (b - a) * i / 63 END AS t FROM sp, range(0, 64) r(i)),
      v AS (SELECT ats.param_id, CASE WHEN nt IS NULL THEN value::DOUBLE ELSE value::DOUBLE + (nv::DOUBLE - value::DOUBLE) * ({_ease('((t - tick) / (nt - tick))')}) END AS v FROM ats JOIN seg ON seg.param_id = ats.param_id AND t >= tick AND (nt IS NULL OR t < nt)),
      m AS (SELECT param_id, min(v) AS a, max(v) AS b FROM v GROUP BY ALL), p AS (SELECT *, CASE WHEN b - a < 1e-6 THEN greatest(abs(a), 1) * 0.1::DOUBLE ELSE (b - a) * 0.1::DOUBLE END AS pad FROM m)
      SELECT param_id, floor((a - pad) * 10 + 0.5) / 10 AS low, floor((b + pad) * 10 + 0.5) / 10 AS high FROM p""",
    "p8_capabilities": f"""WITH {PACKED}, {TRACKS}, {MEDIA}, c AS (SELECT clip_id, kind, media_id % 3 <> 0 AS md, line = 7 AS fz, has_audio AND NOT is_image AS sd, link % 2 = 0 AS dt FROM packed JOIN tracks USING (track_id) JOIN media USING (media_id))
      SELECT clip_id, kind <> 'audio' AS transform, kind <> 'audio' AS crop, kind = 'audio' AND NOT fz AS audio, md AND NOT fz AS speed, kind <> 'audio' AS effects, md AND NOT fz AS reverse, kind = 'video' AND NOT fz AND sd AND NOT dt AS extract_audio FROM c""",
    "p9_non_default": f"WITH {PACKED} SELECT clip_id, volume <> 1.0 OR line > 5 AS custom_audio, volume <= 0 AS silent, reversed AS retimed FROM packed",
    "r2_partition_layers": f"""WITH {PACKED}, {TRACKS}, l AS (SELECT t, clip_id, row_number() OVER (PARTITION BY t ORDER BY order_idx) - 1 AS layer FROM (SELECT DISTINCT o_orderkey * 13 % 9000 AS t FROM orders) k, packed JOIN tracks USING (track_id) WHERE enabled AND kind <> 'audio' AND t >= start_tick AND t < start_tick + dur_tick),
      c AS (SELECT clip_id FROM l ORDER BY t, layer LIMIT 1), a AS (SELECT *, max(layer) FILTER (WHERE clip_id = (SELECT clip_id FROM c)) OVER (PARTITION BY t) AS m FROM l)
      SELECT t, CASE WHEN layer < m THEN 'below' WHEN layer > m THEN 'above' ELSE 'sprite' END AS side, count(*) AS n FROM a WHERE m IS NOT NULL GROUP BY ALL""",
    "r6_overrides": f"WITH {PACKED} SELECT clip_id, CASE WHEN clip_id % 50 = 1 THEN 0.5 ELSE volume END AS volume, line FROM packed",
    "o6_markers": "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey * 31 % 1000, o_orderkey) AS position FROM orders",
    "o7_slots": f"WITH {PACKED}, s AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY clip_id % 10, clip_id) AS r FROM packed) SELECT track_id, count(*) AS slots, max(clip_id) FILTER (WHERE r = 1) AS music FROM s GROUP BY ALL",
    "o12_lru": f"WITH {PACKED} SELECT clip_id FROM packed QUALIFY row_number() OVER (PARTITION BY track_id ORDER BY start_tick DESC, clip_id) > 100",
    "x7_commands": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_type IN ('view', 'click') THEN 'do the rest now' END AS expanded FROM events",
    "x8_adjust_summary": f"""WITH {PACKED} SELECT clip_id, concat_ws(', ', CASE WHEN line <> 4 THEN 'brightness=' || printf('%.2f', (line - 4) / 4.0::DOUBLE) END, CASE WHEN abs(volume - 0.5) > 1e-9 THEN 'contrast=' || printf('%.2f', volume - 0.5) END) AS summary FROM packed""",
    "x10_id_map": f"WITH {PACKED} SELECT track_id, count(*) AS n, sum(dur_tick)::BIGINT AS total FROM packed GROUP BY ALL",
    "s8_bounded_read": f"WITH {PCM} SELECT media_id, count(*) AS frames FROM pcm GROUP BY ALL HAVING count(*) <= 3200",
    "s9_range_read": f"WITH {PCM} SELECT media_id, count(*) AS n, round(sum(sample::DOUBLE), 6) AS total FROM pcm WHERE frame BETWEEN 1000 AND 1063 GROUP BY ALL",
    "s18_content_key": "SELECT doc_id, sha256(text) AS content_key FROM documents",
}
