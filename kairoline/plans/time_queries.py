"""Queries of exact time arithmetic and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeexpr as X
from .fixtures import CLIPS, MEDIA, PACKED, clips, media, packed, table


def p1_interval_predicates(spark, sf):
    c = clips(spark, sf)
    s, d, s2, d2 = F.col("start_tick"), F.col("dur_tick"), F.col("line") * 10_000, F.col("line") % 3 * 8000
    cut = X.intersection(s, d, s2, d2)
    return c.select("clip_id", X.contains(s, d, s2).alias("holds"), X.overlaps(s, d, s2, d2).alias("meets"), cut["start"].alias("cut_start"), cut["dur"].alias("cut_dur"))


def p2_rational_compare(spark, sf):
    m = media(spark, sf)
    v, n, d = F.col("duration_ticks"), F.col("rate_num"), F.col("rate_den")
    return m.select("media_id", X.compare(v, n, d, F.col("media_id") * 7, F.lit(30), F.lit(1)).cast("long").alias("cmp"), X.resample(v, n, d, F.lit(25), F.lit(1)).alias("at25"), X.resample(-v, n, d, F.lit(24000), F.lit(1001)).alias("at23976"))


def p3_seconds(spark, sf):
    m = media(spark, sf)
    n, d = F.col("rate_num"), F.col("rate_den")
    s = X.seconds(F.col("duration_ticks"), n, d)
    return m.select("media_id", F.round(s, 9).alias("seconds"), X.seconds(F.col("duration_ticks"), n * 0, d).alias("no_rate"), X.seconds_to_ticks(s * 1.37, n, d).alias("ticks"), X.seconds_to_ticks(F.lit(float("nan")), n, d).alias("not_finite"))


def p5_rational_speed(spark, sf):
    r = X.rational_speed(F.col("l_discount") * 20 + F.col("l_tax"))
    return table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("clip_id"), r["num"].alias("num"), r["den"].alias("den"))


def f12_retime(spark, sf):
    c = packed(spark, sf)
    num, den = F.col("line") * 3 + 1, F.lit(7)
    t = F.col("start_tick") + F.col("dur_tick") - 3
    return c.select(
        "clip_id",
        X.scale_by_speed(-F.col("dur_tick"), num, den).alias("scaled"),
        X.unscale_by_speed(F.col("dur_tick"), num, den).alias("unscaled"),
        X.retimed_duration(F.col("dur_tick"), num, den).alias("retimed"),
        X.animation_tick(t, F.col("start_tick"), F.col("dur_tick")).alias("anim"),
        X.source_tick(t, F.col("start_tick"), F.col("dur_tick"), F.lit(100).cast("long"), F.col("dur_tick") * 2, num, den, F.col("reversed"), F.col("line") == 5).alias("source"),
    )


def f18_ticks_to_samples(spark, sf):
    m = media(spark, sf)
    n, d, v = F.col("rate_num"), F.col("rate_den"), F.col("duration_ticks")
    return m.select("media_id", X.ticks_to_samples(v, n, d).alias("samples"), (X.ticks_to_samples(v + 1, n, d) - X.ticks_to_samples(v, n, d)).alias("block"), X.ticks_to_samples(v, 0, 1).alias("no_rate"))


def f29_timecode(spark, sf):
    o = table(spark, sf, "orders")
    f = F.col("o_orderkey") * 331
    return o.select("o_orderkey", X.timecode(f, 24, 1).alias("tc24"), X.timecode(f, 30000, 1001, True).alias("df2997"), X.timecode(f, 60000, 1001, True).alias("df5994"))


QUERIES = {f.__name__: f for f in (p1_interval_predicates, p2_rational_compare, p3_seconds, p5_rational_speed, f12_retime, f18_ticks_to_samples, f29_timecode)}


def _tc(frame: str, fps: int, sep: str) -> str:
    t = f"({frame} // {fps})"
    return f"lpad(({t} // 3600)::VARCHAR, 2, '0') || ':' || lpad((({t} // 60) % 60)::VARCHAR, 2, '0') || ':' || lpad(({t} % 60)::VARCHAR, 2, '0') || '{sep}' || lpad(({frame} % {fps})::VARCHAR, 2, '0')"


def _dropped(f: str, fps: int, skip: int) -> str:
    minute, ten = fps * 60 - skip, fps * 600 - skip * 9
    return f"({f} + {skip * 9} * ({f} // {ten}) + CASE WHEN {f} % {ten} > {skip} THEN {skip} * (({f} % {ten} - {skip}) // {minute}) ELSE 0 END)"


def _half_away(num: str, den: str) -> str:
    return f"(sign({num}) * ((abs({num}) + ({den}) // 2) // ({den})))::BIGINT"


ORACLE_SQL = {
    "p1_interval_predicates": f"""WITH {CLIPS}, r AS (SELECT *, line * 10000 AS s2, line % 3 * 8000 AS d2 FROM clips),
      o AS (SELECT *, d2 > 0 AND dur_tick > 0 AND start_tick < s2 + d2 AND s2 < start_tick + dur_tick AS meets FROM r)
      SELECT clip_id, s2 >= start_tick AND s2 < start_tick + dur_tick AS holds, meets, CASE WHEN meets THEN greatest(start_tick, s2) END AS cut_start,
             CASE WHEN meets THEN least(start_tick + dur_tick, s2 + d2) - greatest(start_tick, s2) END AS cut_dur FROM o""",
    "p2_rational_compare": f"""WITH {MEDIA} SELECT media_id, sign(duration_ticks::HUGEINT * rate_den * 30 - media_id * 7 * rate_num)::BIGINT AS cmp,
      {_half_away("(duration_ticks::HUGEINT * rate_den * 25)", "rate_num::HUGEINT")} AS at25, {_half_away("(-duration_ticks::HUGEINT * rate_den * 24000)", "(rate_num::HUGEINT * 1001)")} AS at23976 FROM media""",
    "p3_seconds": f"""WITH {MEDIA}, s AS (SELECT *, duration_ticks::DOUBLE * rate_den / rate_num AS s FROM media)
      SELECT media_id, round(s, 9) AS seconds, 0.0::DOUBLE AS no_rate, round(s * 1.37 * rate_num / rate_den)::BIGINT AS ticks, NULL::BIGINT AS not_finite FROM s""",
    "p5_rational_speed": """WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS clip_id, l_discount * 20 + l_tax AS s FROM lineitem),
      h AS (SELECT clip_id, CASE WHEN s BETWEEN 0.05 AND 100 THEN round(s * 100)::BIGINT END AS h FROM s)
      SELECT clip_id, h // gcd(h, 100) AS num, CASE WHEN h IS NOT NULL THEN 100 // gcd(h, 100) END AS den FROM h""",
    "f12_retime": f"""WITH {PACKED}, r AS (SELECT *, line * 3 + 1 AS num, start_tick + dur_tick - 3 AS t, (dur_tick - 3) * (line * 3 + 1) // 7 AS off, 100 + dur_tick * 2 - 1 AS last FROM packed)
      SELECT clip_id, -(dur_tick * num // 7) AS scaled, dur_tick * 7 // num AS unscaled, greatest(dur_tick * 7 // num, 1) AS retimed,
             greatest(0, least(t - start_tick, greatest(dur_tick - 1, 0))) AS anim,
             CASE WHEN t >= start_tick AND t < start_tick + dur_tick THEN CASE WHEN line = 5 THEN 100 ELSE greatest(100, least(last, CASE WHEN reversed THEN last - off ELSE 100 + off END)) END END AS source FROM r""",
    "f18_ticks_to_samples": f"""WITH {MEDIA} SELECT media_id, (duration_ticks::HUGEINT * rate_den * 48000 // rate_num)::BIGINT AS samples,
      ((duration_ticks + 1)::HUGEINT * rate_den * 48000 // rate_num - duration_ticks::HUGEINT * rate_den * 48000 // rate_num)::BIGINT AS block, 0::BIGINT AS no_rate FROM media""",
    "f29_timecode": f"""WITH o AS (SELECT o_orderkey, o_orderkey * 331 AS f FROM orders), d AS (SELECT *, {_dropped("f", 30, 2)} AS a, {_dropped("f", 60, 4)} AS b FROM o)
      SELECT o_orderkey, {_tc("f", 24, ":")} AS tc24, {_tc("a", 30, ";")} AS df2997, {_tc("b", 60, ";")} AS df5994 FROM d""",
}
