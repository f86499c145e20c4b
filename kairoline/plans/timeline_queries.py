"""Queries of timelines: joins, sums, edits, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import introspect as I
from ..operators import timeline as T
from ..operators.intervals import interval_join, overlaps_before, stab_join
from .fixtures import CLIPS, MEDIA, PACKED, TRACKS, clips, media, packed, table, tracks


def j1_clip_lookup(spark, sf):
    return clips(spark, sf).join(tracks(spark, sf), "track_id").join(media(spark, sf), "media_id").select("clip_id", "kind", "path", "muted")


def _ticks(spark, sf):
    """A tick in the middle of every order's day."""
    at = (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) * 24 + 12).cast("long")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("probe"), at.alias("t"))


_TICKS = "ticks AS (SELECT o_orderkey AS probe, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) * 24 + 12 AS t FROM orders)"


def j2_stab(spark, sf):
    """Each order's tick on the tracks of its own lines."""
    asked = _ticks(spark, sf).join(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("probe"), F.col("l_suppkey").alias("track_id")).distinct(), "probe")
    return stab_join(asked, clips(spark, sf), ["track_id"], "t", ("start_tick", "dur_tick"), 48).groupBy("probe", "track_id").agg(F.count("*").alias("n"), F.min("clip_id").alias("first_clip"))


def j3_overlap(spark, sf):
    c = clips(spark, sf)
    return c.select("clip_id", overlaps_before(c, ["track_id"], "start_tick", "dur_tick", ["clip_id"]).alias("overlaps"))


def j4_window_clamp(spark, sf):
    views = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("track_id"), (F.col("s_suppkey") % 50 * 1000).alias("view_start"), F.lit(700).cast("long").alias("view_dur"))
    j = interval_join(clips(spark, sf), views, ["track_id"], ("start_tick", "dur_tick"), ("view_start", "view_dur"), 256)
    a, b = F.greatest("start_tick", "view_start"), F.least(T.end(), F.col("view_start") + F.col("view_dur"))
    return j.select("clip_id", "track_id", a.alias("seen_start"), (b - a).alias("seen_dur"))


def j5_abut(spark, sf):
    return T.abutting(packed(spark, sf)).groupBy("track_id").agg(F.count("*").alias("junctions"), F.sum("cut").alias("cuts"))


def j6_detached_audio(spark, sf):
    c = clips(spark, sf).join(tracks(spark, sf).select("track_id", "kind"), "track_id")
    on_audio = c.where("kind = 'audio'").select("link").distinct()
    video = c.where("kind = 'video'")
    return video.join(on_audio, "link", "left_semi").groupBy("track_id").agg(F.count("*").alias("detached")).join(video.join(on_audio, "link", "left_anti").groupBy("track_id").agg(F.count("*").alias("own")), "track_id", "full")


def j7_unused_media(spark, sf):
    used = clips(spark, sf).where("volume > 0.9").select("media_id")
    m = media(spark, sf)
    return m.join(used, "media_id", "left_anti").select("media_id", "path")


def j12_slot_picks(spark, sf):
    slots = packed(spark, sf).select("track_id", F.row_number().over(Window.partitionBy("track_id").orderBy("start_tick", "clip_id")).alias("slot"), "clip_id")
    picks = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("track_id"), F.posexplode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("slot", "pick")).withColumn("slot", F.col("slot") + 1)
    return slots.join(picks, ["track_id", "slot"]).select("clip_id", "pick")


def j15_free_lane(spark, sf):
    """For each probe, the lowest unlocked track without a clip at its tick, if any."""
    return T.first_free_lane(_ticks(spark, sf), clips(spark, sf), tracks(spark, sf).where("NOT locked"), 48)


def g1_content_end(spark, sf):
    ends = clips(spark, sf).groupBy("track_id").agg(F.max(T.end()).alias("e"))
    return tracks(spark, sf).join(ends, "track_id", "left").select("track_id", F.coalesce("e", F.lit(0).cast("long")).alias("content_end"), F.max(F.coalesce("e", F.lit(0).cast("long"))).over(Window.partitionBy(F.lit(0))).alias("duration"))


def g2_counts(spark, sf):
    return clips(spark, sf).groupBy("track_id").agg(F.count("*").alias("clips"), F.countDistinct("media_id").alias("media"), F.countDistinct("link").alias("links"), F.count_if(F.col("reversed")).alias("reversed"))


def g12_auto_canvas(spark, sf):
    seen = packed(spark, sf).select("track_id", "media_id").distinct().join(media(spark, sf).where("NOT is_image"), "media_id")
    best = seen.groupBy("track_id").agg(F.min(F.struct((-F.col("width") * F.col("height")).alias("area"), "media_id", "width", "height")).alias("b"))
    even = lambda c: F.greatest(F.floor(c / 2) * 2, F.lit(2))
    return best.select("track_id", even(F.col("b.width")).cast("long").alias("width"), even(F.col("b.height")).cast("long").alias("height"))


def g15_in_view(spark, sf):
    c = clips(spark, sf)
    inside = (F.col("start_tick") < 40_000) & (T.end() > 20_000)
    return c.groupBy("track_id").agg(F.count_if(inside).alias("shown"), F.count_if(~inside).alias("hidden"), F.sum(F.when(inside, F.least(T.end(), F.lit(40_000)) - F.greatest("start_tick", F.lit(20_000)))).alias("ticks"))


def g14_summary(spark, sf):
    c = packed(spark, sf).withColumn("item", F.struct("start_tick", "clip_id", "dur_tick"))
    rows = c.groupBy("track_id").agg(F.array_sort(F.collect_list("item")).alias("items"))
    text = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["start_tick"].cast("string"), x["clip_id"].cast("string"), x["dur_tick"].cast("string"))), ",")
    return rows.join(tracks(spark, sf), "track_id").select("track_id", F.concat(F.col("kind"), F.when(F.col("muted"), " muted").otherwise(""), F.lit("|"), text).alias("summary"))


def o4_clips_ordered(spark, sf):
    return clips(spark, sf).select("clip_id", F.row_number().over(Window.partitionBy("track_id").orderBy("start_tick", "clip_id")).cast("long").alias("position"))


def o5_lane_zones(spark, sf):
    return T.lane_order(tracks(spark, sf)).select("track_id", "main", "lane")


def o8_page(spark, sf):
    return I.page(media(spark, sf).select("media_id", "path"), ["media_id"], 3)


def o9_by_visibility(spark, sf):
    hidden = (F.col("media_id") % 5 == 0).cast("int")
    return I.positions(media(spark, sf).select("media_id"), F.struct(hidden.alias("h"), F.floor(F.col("media_id") / 1024).alias("b")), ["media_id"])


def o10_capped_rows(spark, sf):
    """Eight rows for each kind, the main lane always among them, and one row for those left out."""
    t = T.lane_order(tracks(spark, sf)).withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.col("main").cast("int")), "lane")))
    kept = t.where("rank <= 8").select("kind", F.col("track_id").cast("string").alias("row"))
    rest = t.where("rank > 8").groupBy("kind").agg(F.concat(F.count("*").cast("string"), F.lit(" omitted")).alias("row"))
    return kept.unionByName(rest)


def u5_prune_transitions(spark, sf):
    """Of transitions between neighbours on a track, those whose clips still touch."""
    c = packed(spark, sf)
    nxt = F.lead("clip_id").over(Window.partitionBy("track_id").orderBy("start_tick", "clip_id"))
    wanted = c.select(F.col("clip_id").alias("left_id"), nxt.alias("right_id")).where("right_id IS NOT NULL")
    return wanted.join(T.abutting(c).select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")


def u7_unlink(spark, sf):
    c = clips(spark, sf)
    return T.unlink(c, c.where("clip_id % 97 = 0").select("clip_id")).select("clip_id", "link")


def p6_accepts(spark, sf):
    contents = sorted({x for own in T.ACCEPTS.values() for x in own})
    rows = tracks(spark, sf).select("track_id", "kind", F.explode(F.array(*map(F.lit, contents))).alias("content"))
    return rows.where(T.accepts(F.col("kind"), F.col("content"))).select("track_id", "content", F.col("kind").isin(*T.VISUAL).alias("visual"))


def p10_marquee(spark, sf):
    c = packed(spark, sf).join(tracks(spark, sf).where("NOT locked").select("track_id", "order_idx"), "track_id")
    hit = c.where("order_idx BETWEEN 2 AND 9 AND start_tick < 4000 AND start_tick + dur_tick > 3000")
    first = Window.orderBy("order_idx", "start_tick", "clip_id")
    primary = hit.withColumn("r", F.row_number().over(first)).where("r = 1").select(F.col("clip_id").alias("primary_id"))
    grown = packed(spark, sf).join(hit.select("link").distinct(), "link", "left_semi")
    return grown.crossJoin(F.broadcast(primary)).select("clip_id", (F.col("clip_id") == F.col("primary_id")).alias("is_primary"))


def p11_audible(spark, sf):
    c = clips(spark, sf).join(tracks(spark, sf), "track_id").join(media(spark, sf), "media_id")
    own = c.where("NOT muted AND volume > 0 AND NOT reversed AND has_audio")
    detached = c.where("kind = 'audio'").select("link").distinct()
    return own.where("kind = 'audio'").select("clip_id").unionByName(own.where("kind <> 'audio'").join(detached, "link", "left_anti").select("clip_id"))


def e3_split(spark, sf):
    c = packed(spark, sf).select("clip_id", "track_id", "start_tick", "dur_tick")
    cuts = c.where("clip_id % 10 = 1").select("clip_id", (F.col("start_tick") + F.floor(F.col("dur_tick") / 2)).alias("cut"))
    return T.split(c, cuts, 100_000_000)


def e4_trim(spark, sf):
    c = packed(spark, sf).select("clip_id", "start_tick", "dur_tick", (F.col("line") * 10).alias("src_start"), F.col("dur_tick").alias("src_dur"), "reversed")
    edges = c.where("clip_id % 3 = 0").select("clip_id", (F.col("start_tick") + 2).alias("new_start"), (F.col("dur_tick") - 4).alias("new_dur"))
    return T.trim(c, edges).drop("reversed")


def e6_shift(spark, sf):
    moves = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("track_id"), (F.col("s_suppkey") * 7 % 900).cast("long").alias("from_tick"), (F.col("s_suppkey") % 21 - 10).cast("long").alias("delta"))
    return T.shift_all(packed(spark, sf), moves).select("clip_id", "start_tick", "shifted")


def e7_ripple_delete(spark, sf):
    c = packed(spark, sf)
    return T.ripple_delete(c, c.where("clip_id % 5 = 2").select("clip_id")).select("clip_id", "track_id", "start_tick", "dur_tick")


def a14_beats_on_timeline(spark, sf):
    c = packed(spark, sf).select("*", F.explode(F.array(*(F.lit(x).cast("long") for x in (3, 10, 25, 60)))).alias("beat"))
    at = T.source_in_timeline(F.col("beat"), F.col("start_tick"), F.col("dur_tick"), F.lit(5).cast("long"), F.col("dur_tick") * 2, F.lit(2), F.lit(1), F.col("reversed"))
    return c.select("clip_id", "beat", at.alias("tick")).where("tick IS NOT NULL")


def p12_beats_kept(spark, sf):
    c = packed(spark, sf)
    raw = F.array(F.col("dur_tick"), F.lit(7).cast("long"), F.col("line"), F.lit(7).cast("long"), F.lit(30).cast("long"))
    kept = F.array_sort(F.array_distinct(F.filter(raw, lambda b: (b >= 2) & (b < F.col("dur_tick")))))
    return c.select("clip_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("beats"))


QUERIES = {f.__name__: f for f in (j1_clip_lookup, j2_stab, j3_overlap, j4_window_clamp, j5_abut, j6_detached_audio, j7_unused_media, j12_slot_picks, j15_free_lane, g1_content_end, g2_counts, g12_auto_canvas, g14_summary, g15_in_view, o4_clips_ordered, o5_lane_zones, o8_page, o9_by_visibility, o10_capped_rows, u5_prune_transitions, u7_unlink, p6_accepts, p10_marquee, p11_audible, p12_beats_kept, e3_split, e4_trim, e6_shift, e7_ripple_delete, a14_beats_on_timeline)}

_ACCEPTS = " OR ".join(f"(kind = '{k}' AND content IN ({', '.join(repr(c) for c in own)}))" for k, own in T.ACCEPTS.items())
_CONTENTS = sorted({x for own in T.ACCEPTS.values() for x in own})
_LANES = """lanes AS (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN main THEN 1 WHEN kind = 'audio' THEN 0 WHEN kind = 'text' THEN 3 ELSE 2 END, order_idx, track_id) - 1 AS lane
  FROM (SELECT *, coalesce(kind = 'video' AND track_id = arg_min(track_id, order_idx) FILTER (WHERE kind = 'video') OVER (), false) AS main FROM tracks))"""
_ABUT = "ab AS (SELECT a.clip_id AS left_id, b.clip_id AS right_id, a.track_id, b.start_tick AS cut FROM packed a JOIN packed b ON a.track_id = b.track_id AND a.start_tick + a.dur_tick = b.start_tick AND a.clip_id <> b.clip_id)"

ORACLE_SQL = {
    "j1_clip_lookup": f"WITH {CLIPS}, {TRACKS}, {MEDIA} SELECT clip_id, kind, path, muted FROM clips JOIN tracks USING (track_id) JOIN media USING (media_id)",
    "j2_stab": f"WITH {CLIPS}, {_TICKS} SELECT probe, track_id, count(*) AS n, min(clip_id) AS first_clip FROM ticks JOIN (SELECT DISTINCT l_orderkey AS probe, l_suppkey AS track_id FROM lineitem) USING (probe) JOIN clips USING (track_id) WHERE t >= start_tick AND t < start_tick + dur_tick GROUP BY ALL",
    "j3_overlap": f"WITH {CLIPS} SELECT clip_id, coalesce(max(start_tick + dur_tick) OVER (PARTITION BY track_id ORDER BY start_tick, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > start_tick, false) AS overlaps FROM clips",
    "j4_window_clamp": f"""WITH {CLIPS}, v AS (SELECT *, track_id % 50 * 1000 AS vs FROM clips)
      SELECT clip_id, track_id, greatest(start_tick, vs) AS seen_start, least(start_tick + dur_tick, vs + 700) - greatest(start_tick, vs) AS seen_dur FROM v WHERE start_tick < vs + 700 AND vs < start_tick + dur_tick AND dur_tick > 0""",
    "j5_abut": f"WITH {PACKED}, {_ABUT} SELECT track_id, count(*) AS junctions, sum(cut)::BIGINT AS cuts FROM ab GROUP BY ALL",
    "j6_detached_audio": f"""WITH {CLIPS}, {TRACKS}, c AS (SELECT * FROM clips JOIN tracks USING (track_id)), au AS (SELECT DISTINCT link FROM c WHERE kind = 'audio')
      SELECT track_id, nullif(count(*) FILTER (WHERE link IN (SELECT link FROM au)), 0) AS detached, nullif(count(*) FILTER (WHERE link NOT IN (SELECT link FROM au)), 0) AS own FROM c WHERE kind = 'video' GROUP BY ALL""",
    "j7_unused_media": f"WITH {CLIPS}, {MEDIA} SELECT media_id, path FROM media WHERE media_id NOT IN (SELECT media_id FROM clips WHERE volume > 0.9)",
    "j12_slot_picks": f"WITH {PACKED}, s AS (SELECT clip_id, row_number() OVER (PARTITION BY track_id ORDER BY start_tick, clip_id) AS slot FROM packed) SELECT clip_id, ['a', 'b', 'c'][slot] AS pick FROM s WHERE slot <= 3",
    "j15_free_lane": f"""WITH {CLIPS}, {TRACKS}, {_TICKS}, d AS (SELECT DISTINCT t FROM ticks), b AS (SELECT DISTINCT d.t, track_id FROM d JOIN clips ON d.t >= start_tick AND d.t < start_tick + dur_tick),
      f AS (SELECT d.t, arg_min(k.track_id, order_idx) AS lane FROM d CROSS JOIN (SELECT * FROM tracks WHERE NOT locked) k LEFT JOIN b ON b.t = d.t AND b.track_id = k.track_id WHERE b.t IS NULL GROUP BY d.t)
      SELECT probe, lane FROM ticks JOIN f USING (t)""",
    "g1_content_end": f"WITH {CLIPS}, {TRACKS}, e AS (SELECT t.track_id, coalesce(max(start_tick + dur_tick), 0) AS content_end FROM tracks t LEFT JOIN clips c ON t.track_id = c.track_id GROUP BY ALL) SELECT *, max(content_end) OVER () AS duration FROM e",
    "g2_counts": f"WITH {CLIPS} SELECT track_id, count(*) AS clips, count(DISTINCT media_id) AS media, count(DISTINCT link) AS links, count(*) FILTER (WHERE reversed) AS reversed FROM clips GROUP BY ALL",
    "g12_auto_canvas": f"""WITH {PACKED}, {MEDIA}, r AS (SELECT track_id, width, height, row_number() OVER (PARTITION BY track_id ORDER BY width * height DESC, media_id) AS n FROM packed JOIN media USING (media_id) WHERE NOT is_image)
      SELECT track_id, width // 2 * 2 AS width, height // 2 * 2 AS height FROM r WHERE n = 1""",
    "g14_summary": f"""WITH {PACKED}, {TRACKS} SELECT track_id, any_value(kind) || CASE WHEN any_value(muted) THEN ' muted' ELSE '' END || '|' || string_agg(start_tick || ':' || clip_id || ':' || dur_tick, ',' ORDER BY start_tick, clip_id) AS summary
      FROM packed JOIN tracks USING (track_id) GROUP BY track_id""",
    "g15_in_view": f"""WITH {CLIPS}, r AS (SELECT *, start_tick < 40000 AND start_tick + dur_tick > 20000 AS i FROM clips)
      SELECT track_id, count(*) FILTER (WHERE i) AS shown, count(*) FILTER (WHERE NOT i) AS hidden, sum(CASE WHEN i THEN least(start_tick + dur_tick, 40000) - greatest(start_tick, 20000) END)::BIGINT AS ticks FROM r GROUP BY ALL""",
    "o4_clips_ordered": f"WITH {CLIPS} SELECT clip_id, row_number() OVER (PARTITION BY track_id ORDER BY start_tick, clip_id) AS position FROM clips",
    "o5_lane_zones": f"WITH {TRACKS}, {_LANES} SELECT track_id, main, lane FROM lanes",
    "o8_page": f"WITH {MEDIA} SELECT media_id, path FROM media ORDER BY media_id LIMIT 12 OFFSET 24",
    "o9_by_visibility": f"WITH {MEDIA} SELECT media_id, row_number() OVER (ORDER BY media_id % 5 = 0, media_id) AS position FROM media",
    "o10_capped_rows": f"""WITH {TRACKS}, {_LANES}, r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY main DESC, lane) AS n FROM lanes)
      SELECT kind, track_id::VARCHAR AS row FROM r WHERE n <= 8 UNION ALL SELECT kind, count(*)::VARCHAR || ' omitted' FROM r WHERE n > 8 GROUP BY kind""",
    "u5_prune_transitions": f"WITH {PACKED}, n AS (SELECT *, lead(clip_id) OVER w AS right_id, lead(start_tick) OVER w AS rs FROM packed WINDOW w AS (PARTITION BY track_id ORDER BY start_tick, clip_id)) SELECT clip_id AS left_id, right_id FROM n WHERE rs = start_tick + dur_tick",
    "u7_unlink": f"WITH {CLIPS} SELECT clip_id, CASE WHEN link NOT IN (SELECT link FROM clips WHERE clip_id % 97 = 0) THEN link END AS link FROM clips",
    "p6_accepts": f"WITH {TRACKS}, c AS (SELECT track_id, kind, unnest({_CONTENTS}) AS content FROM tracks) SELECT track_id, content, kind <> 'audio' AS visual FROM c WHERE {_ACCEPTS}",
    "p10_marquee": f"""WITH {PACKED}, {TRACKS}, h AS (SELECT clip_id, link, row_number() OVER (ORDER BY order_idx, start_tick, clip_id) AS r FROM packed JOIN tracks USING (track_id) WHERE NOT locked AND order_idx BETWEEN 2 AND 9 AND start_tick < 4000 AND start_tick + dur_tick > 3000)
      SELECT clip_id, clip_id = (SELECT clip_id FROM h WHERE r = 1) AS is_primary FROM packed WHERE link IN (SELECT link FROM h)""",
    "p11_audible": f"""WITH {CLIPS}, {TRACKS}, {MEDIA}, c AS (SELECT * FROM clips JOIN tracks USING (track_id) JOIN media USING (media_id))
      SELECT clip_id FROM c WHERE NOT muted AND volume > 0 AND NOT reversed AND has_audio AND (kind = 'audio' OR link NOT IN (SELECT link FROM c WHERE kind = 'audio'))""",
    "p12_beats_kept": f"WITH {PACKED} SELECT clip_id, array_to_string(list_sort(list_distinct(list_filter([dur_tick, 7, line, 7, 30], lambda b: b >= 2 AND b < dur_tick))), ',') AS beats FROM packed",
    "e3_split": f"""WITH {PACKED}, c AS (SELECT *, clip_id % 10 = 1 AND dur_tick >= 2 AS hit, start_tick + dur_tick // 2 AS cut FROM packed),
      n AS (SELECT clip_id, row_number() OVER (ORDER BY clip_id) - 1 + 100000000 AS new_id FROM c WHERE clip_id % 10 = 1)
      SELECT clip_id, track_id, start_tick, CASE WHEN hit THEN cut - start_tick ELSE dur_tick END AS dur_tick FROM c
      UNION ALL SELECT new_id, track_id, cut, start_tick + dur_tick - cut FROM c JOIN n USING (clip_id) WHERE hit""",
    "e4_trim": f"""WITH {PACKED}, c AS (SELECT *, CASE WHEN reversed THEN line * 10 + dur_tick - 2 - (dur_tick - 4) ELSE line * 10 + 2 END AS src, clip_id % 3 = 0 AND dur_tick - 4 >= 1 AS hit FROM packed)
      SELECT clip_id, CASE WHEN hit THEN start_tick + 2 ELSE start_tick END AS start_tick, CASE WHEN hit THEN dur_tick - 4 ELSE dur_tick END AS dur_tick,
             CASE WHEN hit THEN src ELSE line * 10 END AS src_start, CASE WHEN hit THEN dur_tick - 4 ELSE dur_tick END AS src_dur FROM c""",
    "e6_shift": f"""WITH {PACKED}, c AS (SELECT *, start_tick >= track_id * 7 % 900 AS later, track_id % 21 - 10 AS delta FROM packed),
      g AS (SELECT *, min(start_tick) FILTER (WHERE later) OVER (PARTITION BY track_id) AS f, max(start_tick + dur_tick) FILTER (WHERE NOT later) OVER (PARTITION BY track_id) AS b FROM c),
      s AS (SELECT *, coalesce(later AND delta <> 0 AND f + delta >= greatest(0, coalesce(b, 0)), false) AS shifted FROM g)
      SELECT clip_id, CASE WHEN shifted THEN start_tick + delta ELSE start_tick END AS start_tick, shifted FROM s""",
    "e7_ripple_delete": f"""WITH {PACKED}, c AS (SELECT *, coalesce(sum(CASE WHEN clip_id % 5 = 2 THEN dur_tick ELSE 0 END) OVER (PARTITION BY track_id ORDER BY start_tick, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM packed)
      SELECT clip_id, track_id, (start_tick - freed)::BIGINT AS start_tick, dur_tick FROM c WHERE clip_id % 5 <> 2""",
    "a14_beats_on_timeline": f"""WITH {PACKED}, c AS (SELECT *, unnest([3, 10, 25, 60]) AS beat FROM packed), o AS (SELECT *, CASE WHEN reversed THEN 5 + dur_tick * 2 - 1 - beat ELSE beat - 5 END AS off FROM c WHERE beat >= 5 AND beat < 5 + dur_tick * 2)
      SELECT clip_id, beat::BIGINT AS beat, start_tick + least(round(off / 2.0::DOUBLE)::BIGINT, dur_tick - 1) AS tick FROM o""",
}
