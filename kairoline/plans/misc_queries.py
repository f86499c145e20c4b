"""Further queries over project tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import introspect as I
from .fixtures import MEDIA, MOMENTS, PACKED, clips, media, moments, packed, table


def j9_frame_at(spark, sf):
    frames = clips(spark, sf).select("track_id", F.col("start_tick").alias("pts")).distinct()
    wanted = table(spark, sf, "orders").select((F.col("o_orderkey") % 50 + 1).alias("track_id"), F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") * 13 % 60000).alias("t"))
    return I.frame_at(wanted, frames, ["track_id"]).select("probe", "pts")


def j10_snap(spark, sf):
    c = packed(spark, sf)
    seq = F.row_number().over(Window.partitionBy("track_id").orderBy("start_tick", "clip_id"))
    cand = c.where("line % 2 = 0").withColumn("seq", seq).select("track_id", "seq", F.col("start_tick").alias("tick"))
    drags = c.select("track_id", F.col("clip_id").alias("drag_id"), (F.col("start_tick") + 7).alias("cursor"), F.col("dur_tick").alias("dur"))
    return I.snap(drags, cand, 6, ["track_id"])


def s16_evict(spark, sf):
    files = clips(spark, sf).select("track_id", F.col("clip_id").alias("path"), F.col("dur_tick").alias("bytes"), F.col("start_tick").alias("mtime"), (F.col("line") == 4).alias("protected"))
    return I.evict_oldest(files, 5000, ["track_id"]).select("path")


def s17_disk_usage(spark, sf):
    return clips(spark, sf).groupBy(F.col("line").alias("folder")).agg(F.sum("dur_tick").alias("bytes"), F.count("*").alias("files"))


def o11_latest_jobs(spark, sf):
    jobs = moments(spark, sf).select("content_key", "event_id", "start_seconds")
    return I.keep_latest(jobs, 40, F.col("start_seconds"), "event_id", ["content_key"]).select("event_id", F.col("position").cast("long").alias("position"), "truncated")


def s11_seek_cost(spark, sf):
    o = table(spark, sf, "orders")
    m = I.moving_cost(o, ["o_custkey"], "o_orderkey", "o_totalprice")
    return m.select("o_custkey", F.floor(F.col("mean") * 100 + 0.5).cast("long").alias("mean"), F.round(I.roll_window(F.col("mean"), F.lit(2000.0), 30.0), 6).alias("window"))


def s11_busy_key(spark, sf):
    """The running mean of each type's events, a key as large as a table's part."""
    m = I.moving_cost(table(spark, sf, "events"), ["event_type"], "event_id", "value")
    return m.select("event_type", F.round("mean", 6).alias("mean"))


def a12_moment_rows(spark, sf):
    """Events of a kind as indexed moment rows."""
    m = moments(spark, sf).where("kind = 'click'")
    i = F.row_number().over(Window.partitionBy("content_key").orderBy("start_seconds", "event_id")) - 1
    return m.withColumn("i", i).select("event_id", F.to_json(F.struct(F.lit(1).alias("v"), F.col("i").alias("index"))).alias("payload"))


def a11_out_of_order(spark, sf):
    """Every third frame is stamped two days late, so that some come after later ones."""
    from ..operators.shots import out_of_order

    late = F.when(F.col("event_id") % 3 == 0, 172800).otherwise(0)
    e = moments(spark, sf).select(F.col("content_key").alias("media_id"), "event_id", (F.col("start_seconds") + late).alias("t"))
    return out_of_order(e, "event_id").select("event_id")


def f26_motion_ticks(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.posexplode(I.motion_ticks(F.col("o_orderkey").cast("double"), 180.0, 5)).alias("i", "at")).select("o_orderkey", F.col("i").cast("long").alias("i"), F.round("at", 6).alias("at"))


def f28_crop_uv(spark, sf):
    m = media(spark, sf)
    x, y, w, h = F.col("media_id") % 50 / 100.0, F.col("media_id") % 30 / 100.0, F.lit(0.5), F.lit(0.25)
    uv = I.crop_uv(x, y, w, h, F.col("is_image"), F.col("has_audio"))
    return m.select("media_id", *(F.round(uv[i], 9).alias(n) for i, n in enumerate(("u0", "v0", "u1", "v1"))))


def f31_interval(spark, sf):
    return media(spark, sf).select("media_id", I.interval(F.col("duration_ticks") / 25.0, 12).alias("interval"))


def f32_tiles(spark, sf):
    k = I.tile_step(F.col("media_id") / 7.0, 64.0)
    return media(spark, sf).select("media_id", k.cast("long").alias("k"), I.tile_micros(k).alias("micros"))


def f33_strip_times(spark, sf):
    t = I.strip_times(F.lit(0.0), F.col("duration_ticks") / 25.0, 6)
    return media(spark, sf).select("media_id", F.posexplode(t).alias("i", "at")).select("media_id", F.col("i").cast("long").alias("i"), F.round("at", 6).alias("at"))


def f36_looping_frame(spark, sf):
    d = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("idx")).agg(F.max("l_quantity").cast("long").alias("delay"))
    asks = table(spark, sf, "orders").select((F.col("o_orderkey") % 50 + 1).alias("k"), F.col("o_orderkey").alias("probe"), (F.col("o_orderkey") * 31).alias("ms"))
    return I.looping_frame(d, asks, ["k"]).select("probe", F.col("idx").cast("long").alias("idx"))


def x3_clock_labels(spark, sf):
    s = F.floor(F.col("duration_ticks") / 25)
    m, r = F.floor(s / 60), s % 60
    label = F.when(s >= 60, F.concat(m.cast("string"), F.lit(":"), F.lpad(r.cast("string"), 2, "0"))).otherwise(F.concat(r.cast("string"), F.lit("s")))
    return media(spark, sf).select("media_id", label.alias("label"))


def x6_tool_names(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("app__"), "event_type", F.lit("_"), (F.col("user_id") % 3).cast("string")).alias("name")).distinct()
    return e.select("name", F.split_part("name", F.lit("__"), F.lit(1)).alias("space"), F.split_part("name", F.lit("__"), F.lit(2)).alias("tool"), F.col("name").rlike("^[a-z][a-z0-9_]*$").alias("valid"))


def x11_lower_command(spark, sf):
    """Tool calls in JSON as typed commands, with the reason why one is rejected."""
    e = table(spark, sf, "events").select("event_id", "event_type", F.concat(F.lit('{"clip": '), "event_id", F.lit(', "seconds": '), (F.col("event_id") % 9 - 2).cast("string"), F.lit("}")).alias("args"))
    a = F.from_json("args", "clip BIGINT, seconds DOUBLE")
    reason = F.when(~F.col("event_type").isin("view", "click"), "unknown tool").when(a["seconds"] < 0, "negative time")
    return e.select("event_id", reason.isNull().alias("valid"), reason.alias("reason"), F.when(reason.isNull(), F.round(a["seconds"] * 30).cast("long")).alias("tick"))


QUERIES = {f.__name__: f for f in (j9_frame_at, j10_snap, s11_seek_cost, s11_busy_key, s16_evict, s17_disk_usage, o11_latest_jobs, a11_out_of_order, a12_moment_rows, f26_motion_ticks, f28_crop_uv, f31_interval, f32_tiles, f33_strip_times, f36_looping_frame, x3_clock_labels, x6_tool_names, x11_lower_command)}

_LIST = ", ".join(f"{x}::DOUBLE" for x in I.INTERVALS)
ORACLE_SQL = {
    "j9_frame_at": f"WITH {PACKED.partition(', packed AS')[0]} SELECT probe, start_tick AS pts FROM (SELECT o_orderkey AS probe, o_orderkey % 50 + 1 AS track_id, o_orderkey * 13 % 60000 AS t FROM orders) o ASOF LEFT JOIN (SELECT DISTINCT track_id, start_tick FROM clips) c ON c.track_id = o.track_id AND o.t <= c.start_tick",
    "j10_snap": f"""WITH {PACKED}, c AS (SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY start_tick, clip_id) AS seq, start_tick AS tick FROM packed WHERE line % 2 = 0),
      d AS (SELECT track_id, clip_id AS drag_id, start_tick + 7 AS cur, dur_tick AS dur FROM packed),
      e AS (SELECT *, 0 AS side, cur AS edge FROM d UNION ALL SELECT *, 1, cur + dur FROM d WHERE dur >= 12),
      h AS (SELECT drag_id, tick, CASE side WHEN 1 THEN tick - dur ELSE tick END AS start, row_number() OVER (PARTITION BY drag_id ORDER BY abs(tick - edge), seq, side) AS r FROM e JOIN c USING (track_id) WHERE abs(tick - edge) <= 6)
      SELECT d.drag_id, h.drag_id IS NOT NULL AS snapped, coalesce(start, cur) AS start, tick AS line FROM d LEFT JOIN h ON d.drag_id = h.drag_id AND r = 1""",
    "s11_busy_key": "SELECT event_type, round(list_reduce(list(value ORDER BY event_id), lambda m, v: m + 0.3::DOUBLE * (v - m)), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "s11_seek_cost": """WITH RECURSIVE o AS MATERIALIZED (SELECT o_custkey, o_totalprice AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) AS n FROM orders),
      m(k, n, s) AS (SELECT o_custkey, n, v FROM o WHERE n = 1 UNION ALL SELECT m.k, o.n, m.s + 0.3::DOUBLE * (o.v - m.s) FROM m JOIN o ON o.o_custkey = m.k AND o.n = m.n + 1)
      SELECT k AS o_custkey, floor(s * 100 + 0.5)::BIGINT AS mean, round(greatest(2.0::DOUBLE / 30, least(s / 2000 / 30, 10.0)), 6) AS "window" FROM (SELECT k, arg_max(s, n) AS s FROM m GROUP BY k)""",
    "s16_evict": f"""WITH {PACKED.partition(', packed AS')[0]}, f AS (SELECT *, sum(dur_tick) OVER (PARTITION BY track_id) - coalesce(sum(dur_tick) OVER (PARTITION BY track_id ORDER BY start_tick, clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM clips WHERE line <> 4)
      SELECT clip_id AS path FROM f WHERE rest > 5000""",
    "s17_disk_usage": f"WITH {PACKED.partition(', packed AS')[0]} SELECT line AS folder, sum(dur_tick)::BIGINT AS bytes, count(*) AS files FROM clips GROUP BY line",
    "o11_latest_jobs": f"""WITH {MOMENTS}, r AS (SELECT event_id, row_number() OVER (PARTITION BY content_key ORDER BY start_seconds DESC, event_id) AS position, count(*) OVER (PARTITION BY content_key) AS n FROM moments)
      SELECT event_id, position, n > 40 AS truncated FROM r WHERE position <= 40""",
    "a11_out_of_order": f"WITH {MOMENTS}, s AS (SELECT content_key, event_id, start_seconds + CASE WHEN event_id % 3 = 0 THEN 172800 ELSE 0 END AS t FROM moments), b AS (SELECT event_id, t, lag(t) OVER (PARTITION BY content_key ORDER BY event_id) AS p FROM s) SELECT event_id FROM b WHERE t < p",
    "a12_moment_rows": f"""WITH {MOMENTS} SELECT event_id, '{{"v":1,"index":' || (row_number() OVER (PARTITION BY content_key ORDER BY start_seconds, event_id) - 1)::VARCHAR || '}}' AS payload FROM moments WHERE kind = 'click'""",
    "f26_motion_ticks": "SELECT o_orderkey, i, round(o_orderkey + (i / 4.0::DOUBLE - 0.5) * 0.5, 6) AS at FROM orders, range(0, 5) t(i)",
    "f28_crop_uv": f"""WITH {MEDIA}, c AS (SELECT *, media_id % 50 / 100.0::DOUBLE AS x, media_id % 30 / 100.0::DOUBLE AS y FROM media)
      SELECT media_id, round(CASE WHEN is_image THEN x + 0.5 ELSE x END, 9) AS u0, round(CASE WHEN has_audio THEN y + 0.25 ELSE y END, 9) AS v0, round(CASE WHEN is_image THEN x ELSE x + 0.5 END, 9) AS u1, round(CASE WHEN has_audio THEN y ELSE y + 0.25 END, 9) AS v1 FROM c""",
    "f31_interval": f"WITH {MEDIA} SELECT media_id, coalesce(list_filter([{_LIST}], lambda x: duration_ticks / 25.0::DOUBLE / x <= 12)[1], 1800.0::DOUBLE) AS interval FROM media",
    "f32_tiles": f"""WITH {MEDIA}, k AS (SELECT media_id, greatest(-6, least(12, ceil(log2(64.0::DOUBLE / (media_id / 7.0::DOUBLE)))))::BIGINT AS k FROM media WHERE media_id > 0
      UNION ALL SELECT media_id, 12 FROM media WHERE media_id = 0) SELECT media_id, k, CASE WHEN k >= 0 THEN 1000000 * (1::BIGINT << k) ELSE 1000000 >> (-k) END AS micros FROM k""",
    "f33_strip_times": f"WITH {MEDIA} SELECT media_id, i, round(duration_ticks / 25.0::DOUBLE * i / 5, 6) AS at FROM media, range(0, 6) t(i)",
    "f36_looping_frame": """WITH d AS (SELECT l_suppkey AS k, l_linenumber AS idx, max(l_quantity)::BIGINT AS delay FROM lineitem GROUP BY ALL),
      r AS (SELECT *, sum(delay) OVER (PARTITION BY k ORDER BY idx) AS u, sum(delay) OVER (PARTITION BY k) AS total FROM d)
      SELECT o_orderkey AS probe, min(idx)::BIGINT AS idx FROM orders JOIN r ON k = o_orderkey % 50 + 1 WHERE o_orderkey * 31 % total < u GROUP BY o_orderkey""",
    "x3_clock_labels": f"WITH {MEDIA}, s AS (SELECT media_id, duration_ticks // 25 AS s FROM media) SELECT media_id, CASE WHEN s >= 60 THEN (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE s::VARCHAR || 's' END AS label FROM s",
    "x6_tool_names": "SELECT DISTINCT 'app__' || event_type || '_' || (user_id % 3)::VARCHAR AS name, 'app' AS space, event_type || '_' || (user_id % 3)::VARCHAR AS tool, true AS valid FROM events",
    "x11_lower_command": """WITH r AS (SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown tool' WHEN event_id % 9 - 2 < 0 THEN 'negative time' END AS reason FROM events)
      SELECT event_id, reason IS NULL AS valid, reason, CASE WHEN reason IS NULL THEN (event_id % 9 - 2) * 30 END AS tick FROM r""",
}
