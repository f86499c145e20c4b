"""Queries of sound and pictures, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audio as A
from ..operators import ducking as D
from ..operators import shots as S
from .fixtures import MOMENTS, PACKED, PCM, PIXELS, RATE, moments, packed, pcm, pixels

SILENCE = A.Silence(A.Loudness(0.050, 0.025, -120.0), -19.0, 0.05, 0.03, 0.7)
BEATS = A.Beats(A.Loudness(0.016, 0.008, -120.0), 0.2, 1.5, 3.0, 0.12)
DUCK = D.Duck(-18.5, 1.5, 12.0, 3.0, 1.0)
SHOTS = S.Config(columns=8, rows=8, bins=16, threshold=0.16, minimum_seconds=2.0)


def a3_loudness(spark, sf):
    return A.loudness_contour(pcm(spark, sf), SILENCE.loudness, RATE).select("media_id", F.col("win").cast("long").alias("win"), "start_seconds", "end_seconds", F.round(F.col("dbfs").cast("double"), 3).alias("dbfs"))


def g3_energy_windows(spark, sf):
    w = A.energy_windows(pcm(spark, sf), A.Loudness(0.3, 0.2), 10)
    return w.select("media_id", F.col("win").cast("long").alias("win"), F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"), F.round("mean_square", 9).alias("mean_square"), "full")


def a4_silence(spark, sf):
    return A.detect_silence(pcm(spark, sf), SILENCE, RATE)


def a7_onsets(spark, sf):
    c = A.onset_candidates(pcm(spark, sf), BEATS, RATE)
    return c.select("media_id", F.col("win").cast("long").alias("win"), F.round("flux", 2).alias("flux"))


def a8_beats(spark, sf):
    return A.detect_beats(pcm(spark, sf), BEATS, RATE).select("media_id", "time_seconds", F.round("strength_db", 2).alias("strength_db"))


def a8_dense_gate(spark, sf):
    """Of all moments of a kind, in one long row without gaps, those six hours after the last one kept."""
    return A.greedy_gate(moments(spark, sf), "kind", "start_seconds", 21600.0, "confidence")


def g13_energy(spark, sf):
    """Energy of the media of each track's clips, played at many speeds, every four ticks."""
    energy = A.energy_windows(pcm(spark, sf), A.Loudness(0.050, 0.025, -120.0), RATE).select("media_id", "win", F.col("mean_square").alias("energy"))
    c = packed(spark, sf)
    spans = c.select(F.col("track_id").alias("timeline"), (F.col("clip_id") % 10).cast("int").alias("media_id"), F.col("start_tick").alias("start"), F.col("dur_tick").alias("dur"), (F.col("line") * 40).alias("first"), (F.col("line") * 20).alias("num"), F.lit(1).alias("den"))
    return D.place_energy(energy, spans, 25, 4).select("timeline", "k", F.round("energy", 9).alias("energy"))


def e19_duck(spark, sf):
    return D.duck_curve(g13_energy(spark, sf), DUCK).select("timeline", "k", F.round("down", 6).alias("down"))


def g4_channel_mean(spark, sf):
    p = pcm(spark, sf)
    stereo = p.unionByName(p.withColumn("ch", F.lit(1)).withColumn("sample", (F.col("sample") * 0.5).cast("float")))
    return stereo.groupBy("media_id", "frame").agg(F.avg(F.col("sample").cast("double")).alias("m")).groupBy("media_id").agg(F.round(F.sum(F.abs("m")), 5).alias("total"), F.count("*").alias("frames"))


def g5_peaks(spark, sf):
    return A.peaks(pcm(spark, sf), 100).select("media_id", F.col("chunk").cast("long").alias("chunk"), F.round(F.col("peak").cast("double"), 6).alias("peak"))


def g6_rebucket(spark, sf):
    return A.rebucket(A.peaks(pcm(spark, sf), 100), 37).select("media_id", F.col("bucket").cast("long").alias("bucket"), F.round(F.col("peak").cast("double"), 6).alias("peak"))


def g8_features(spark, sf):
    f = S.features(pixels(spark, sf), SHOTS)
    return f.select("media_id", "t", F.col("n").alias("n"), "luma_sum", F.array_join(F.transform("hist", lambda x: x.cast("string")), ",").alias("hist"))


def a9_scores(spark, sf):
    s = S.scores(S.features(pixels(spark, sf), SHOTS), SHOTS)
    return s.select("media_id", "t", "previous_t", F.round(F.col("score").cast("double"), 5).alias("score"))


def a9_shots(spark, sf):
    return S.detect_shots(pixels(spark, sf), SHOTS).select("media_id", "t", "previous_t", F.round(F.col("score").cast("double"), 5).alias("score"))


def f16_gain_pan(spark, sf):
    c = packed(spark, sf)
    gain = A.fade_gain(F.col("dur_tick") - F.col("line"), F.col("dur_tick"), F.col("volume"), F.col("line") * 2, F.col("line") * 3)
    left, right = A.pan_gains(F.col("line") / F.lit(4.0) - 1)
    return c.select("clip_id", F.round(gain, 9).alias("gain"), F.round(left, 9).alias("left"), F.round(right, 9).alias("right"))


def g11_mix(spark, sf):
    spans = packed(spark, sf).select((F.col("clip_id") % 10).cast("int").alias("media_id"), F.col("start_tick").alias("at"), F.col("line").alias("first"), F.col("dur_tick").alias("length"), "volume", (F.col("line") / 4.0 - 1).alias("pan"), F.lit(5).alias("fade_in"), F.lit(7).alias("fade_out"))
    return A.mix(spans, pcm(spark, sf)).select("frame", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"))


QUERIES = {f.__name__: f for f in (a3_loudness, g3_energy_windows, a4_silence, a7_onsets, a8_beats, a8_dense_gate, g13_energy, e19_duck, g4_channel_mean, g5_peaks, g6_rebucket, g8_features, a9_scores, a9_shots, f16_gain_pan, g11_mix)}


def _windows(w: float, h: float, rate: int) -> str:
    frames = lambda s: f"CASE WHEN {s * rate!r} >= n THEN n ELSE {max(int(s * rate + 0.5), 1)} END::BIGINT"
    return f"""sz AS (SELECT media_id, max(frame) + 1 AS n FROM pcm GROUP BY ALL), wh AS (SELECT *, {frames(w)} AS w, {frames(h)} AS h FROM sz),
      win AS (SELECT media_id, k AS win, k * h AS start_frame, least(k * h + w, n) AS end_frame, n, w, h FROM wh, LATERAL (SELECT unnest(range(0, (n - 1) // h + 1)) AS k)),
      cum AS (SELECT media_id, frame, sum(sample::DOUBLE * sample) OVER (PARTITION BY media_id ORDER BY frame) AS s FROM pcm),
      en AS (SELECT win.*, (b.s - coalesce(a.s, 0)) / (end_frame - start_frame) AS mean_square, end_frame - start_frame >= w AS complete
             FROM win JOIN cum b ON b.media_id = win.media_id AND b.frame = end_frame - 1 LEFT JOIN cum a ON a.media_id = win.media_id AND a.frame = start_frame - 1)"""


_DB = "(CASE WHEN mean_square <= 0 THEN -120.0 ELSE greatest(-120.0, least(0.0, 10.0 * log10(mean_square))) END)::FLOAT"
_PCM = f"WITH RECURSIVE {PCM}, "
_LUMA = "((77 * r + 150 * g + 29 * b + 128) >> 8)"
_FEAT = f"""fe AS (SELECT media_id, t, count(*) AS n, sum({_LUMA})::BIGINT AS luma_sum FROM pixels GROUP BY ALL)"""
_SCORE = f"""{_FEAT},
  hi AS (SELECT media_id, t, k, count(*) FILTER (WHERE {_LUMA} * 16 // 256 <= k) AS upto FROM pixels, range(0, 15) q(k) GROUP BY ALL),
  em AS (SELECT a.media_id, a.t, sum(abs(a.upto - b.upto)) AS moved FROM hi a JOIN hi b ON a.media_id = b.media_id AND a.k = b.k AND b.t = a.t - 1 GROUP BY ALL),
  pd AS (SELECT q.media_id, q.t, sum(abs(q.r::DOUBLE - p.r - s) + abs(q.g::DOUBLE - p.g - s) + abs(q.b::DOUBLE - p.b - s)) AS diff
         FROM pixels q JOIN pixels p ON p.media_id = q.media_id AND p.t = q.t - 1 AND p.x = q.x AND p.y = q.y
         JOIN (SELECT media_id, t, (luma_sum - lag(luma_sum) OVER (PARTITION BY media_id ORDER BY t)) / n::DOUBLE AS s FROM fe) f ON f.media_id = q.media_id AND f.t = q.t GROUP BY ALL),
  sc AS (SELECT media_id, t, t - 1 AS previous_t, least(1, greatest(0, (0.4 * moved / (64.0 * 15) + 0.6 * diff / (64 * 4.0 * 255)) / 1.0))::FLOAT AS score FROM em JOIN pd USING (media_id, t))"""

_PLACED = f"""{_PCM}{_windows(0.05, 0.025, RATE)}, {PACKED},
      e AS (SELECT media_id, win, mean_square AS a, coalesce(lead(mean_square) OVER (PARTITION BY media_id ORDER BY win), mean_square) AS b, max(win) OVER (PARTITION BY media_id) AS high FROM en),
      gr AS (SELECT track_id AS timeline, clip_id % 10 AS m, start_tick AS s, line, unnest(range((start_tick + 3) // 4, (start_tick + dur_tick + 3) // 4)) AS k FROM packed),
      ps AS (SELECT timeline, m, k, least((line * 40 + (k * 4 - s) * (line * 20)) / 25.0::DOUBLE, high) AS p FROM gr JOIN (SELECT DISTINCT media_id, high::DOUBLE AS high FROM e) ON media_id = m),
      placed AS (SELECT timeline, k, round(max(a + (b - a) * (p - win)), 9) AS energy FROM ps JOIN e ON media_id = m AND win = floor(p)::BIGINT GROUP BY timeline, k)"""

ORACLE_SQL = {
    "g13_energy": f"{_PLACED} SELECT * FROM placed",
    "e19_duck": f"""{_PLACED}, v AS (SELECT timeline, k, greatest(0, least(1, (10 * log10(energy) + 18.5::DOUBLE) / 1.5::DOUBLE)) * 12 AS a FROM placed WHERE energy > 0), w AS (SELECT * FROM v WHERE a > 0),
      st AS (SELECT DISTINCT timeline, k + d AS k FROM w, range(-6, 15) q(d)),
      dn AS (SELECT st.timeline, st.k, coalesce(max(greatest(0, CASE WHEN w.k <= st.k THEN w.a - (st.k - w.k) ELSE w.a - 3 * (w.k - st.k) END)), 0) AS down FROM st LEFT JOIN w ON w.timeline = st.timeline AND w.k BETWEEN st.k - 14 AND st.k + 6 GROUP BY ALL)
      SELECT timeline, k, round(down, 6) AS down FROM dn x WHERE down > 0 OR EXISTS (SELECT 1 FROM dn y WHERE y.timeline = x.timeline AND y.k IN (x.k - 1, x.k + 1) AND y.down > 0)""",
    "a3_loudness": f"{_PCM}{_windows(0.05, 0.025, RATE)} SELECT media_id, win, start_frame / {RATE}.0::DOUBLE AS start_seconds, end_frame / {RATE}.0::DOUBLE AS end_seconds, round({_DB}::DOUBLE, 3) AS dbfs FROM en",
    "g3_energy_windows": f"{_PCM}{_windows(0.3, 0.2, 10)} SELECT media_id, win, start_frame, end_frame, round(mean_square, 9) AS mean_square, complete AS \"full\" FROM en",
    "a4_silence": f"""{_PCM}{_windows(0.05, 0.025, RATE)}, lv AS (SELECT *, {_DB} AS db FROM en),
      st AS (SELECT *, coalesce(last_value(CASE WHEN db <= -19 THEN 1 WHEN db > -18.3 THEN 0 END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY win ROWS UNBOUNDED PRECEDING), 0) AS silent FROM lv),
      tu AS (SELECT * FROM (SELECT *, silent <> coalesce(lag(silent) OVER (PARTITION BY media_id ORDER BY win), 0) AS turn FROM st) WHERE turn),
      cl AS (SELECT media_id, start_frame AS a, b FROM (SELECT *, coalesce(lead(start_frame) OVER (PARTITION BY media_id ORDER BY win), n) AS b FROM tu) WHERE silent = 1),
      isl AS (SELECT *, sum(CASE WHEN gap <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY a) AS g FROM (SELECT *, a - lag(b) OVER (PARTITION BY media_id ORDER BY a) AS gap FROM cl))
      SELECT media_id, min(a) / {RATE}.0::DOUBLE AS start_seconds, max(b) / {RATE}.0::DOUBLE AS end_seconds FROM isl GROUP BY media_id, g HAVING max(b) - min(a) >= 50""",
    "g4_channel_mean": f"WITH {PCM} SELECT media_id, round(sum(abs((sample::DOUBLE + (sample::DOUBLE * 0.5)::FLOAT) / 2)), 5) AS total, count(*) AS frames FROM pcm GROUP BY ALL",
    "g5_peaks": f"WITH {PCM} SELECT media_id, frame // 100 AS chunk, round(max(least(abs(sample), 1))::DOUBLE, 6) AS peak FROM pcm GROUP BY ALL",
    "g6_rebucket": f"""WITH {PCM}, p AS (SELECT media_id, frame // 100 AS chunk, max(least(abs(sample), 1)) AS peak FROM pcm GROUP BY ALL), n AS (SELECT media_id, max(chunk) + 1 AS n FROM p GROUP BY ALL),
      b AS (SELECT media_id, k AS bucket, k * n // 37 AS a, greatest(((k + 1) * n + 36) // 37, k * n // 37 + 1) AS e FROM n, range(0, 37) t(k))
      SELECT b.media_id, bucket, round(max(peak)::DOUBLE, 6) AS peak FROM b JOIN p ON p.media_id = b.media_id AND chunk >= a AND chunk < e GROUP BY ALL""",
    "g8_features": f"""WITH {PIXELS}, {_FEAT}, h AS (SELECT media_id, t, k, count(*) FILTER (WHERE {_LUMA} * 16 // 256 = k) AS c FROM pixels, range(0, 16) q(k) GROUP BY ALL)
      SELECT media_id, t, n, luma_sum, string_agg(c::VARCHAR, ',' ORDER BY k) AS hist FROM fe JOIN h USING (media_id, t) GROUP BY ALL""",
    "a9_scores": f"WITH {PIXELS}, {_SCORE} SELECT media_id, t, previous_t, round(score::DOUBLE, 5) AS score FROM sc",
    "a9_shots": f"""WITH RECURSIVE {PIXELS}, {_SCORE}, hard AS MATERIALIZED (SELECT * FROM sc WHERE score >= 0.16::FLOAT),
      g(media_id, since) AS (SELECT DISTINCT media_id, 0.0::DOUBLE FROM pixels UNION ALL
        SELECT g.media_id, (SELECT min(t) FROM hard h WHERE h.media_id = g.media_id AND h.t - g.since >= 2 AND h.t > g.since) AS x FROM g WHERE x IS NOT NULL)
      SELECT media_id, t, previous_t, round(score::DOUBLE, 5) AS score FROM hard JOIN g ON g.media_id = hard.media_id AND g.since = hard.t""".replace("SELECT media_id, t, previous_t, round(score::DOUBLE, 5) AS score FROM hard JOIN", "SELECT hard.media_id, t, previous_t, round(score::DOUBLE, 5) AS score FROM hard JOIN"),
    "a7_onsets": f"""{_PCM}{_windows(0.016, 0.008, RATE)}, lv AS (SELECT *, {_DB} AS db FROM en WHERE complete),
      fl AS (SELECT *, coalesce(greatest(db - lag(db) OVER (PARTITION BY media_id ORDER BY win), 0), 0)::DOUBLE AS flux FROM lv),
      th AS (SELECT *, avg(flux) OVER p AS m, avg(flux * flux) OVER p AS q FROM fl WINDOW p AS (PARTITION BY media_id ORDER BY win ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING))
      SELECT media_id, win, round(flux, 2) AS flux FROM th WHERE flux >= greatest(coalesce(m + 1.5 * sqrt(greatest(q - m * m, 0)), 0), 3.0)""",
    "a8_beats": f"""{_PCM}{_windows(0.016, 0.008, RATE)}, lv AS (SELECT *, {_DB} AS db FROM en WHERE complete),
      fl AS (SELECT *, coalesce(greatest(db - lag(db) OVER (PARTITION BY media_id ORDER BY win), 0), 0)::DOUBLE AS flux FROM lv),
      th AS (SELECT *, avg(flux) OVER p AS m, avg(flux * flux) OVER p AS q FROM fl WINDOW p AS (PARTITION BY media_id ORDER BY win ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING)),
      ev AS MATERIALIZED (SELECT media_id, end_frame AS f, flux FROM th WHERE flux >= greatest(coalesce(m + 1.5 * sqrt(greatest(q - m * m, 0)), 0), 3.0)),
      g(media_id, f) AS (SELECT media_id, min(f) FROM ev GROUP BY media_id UNION ALL
        SELECT g.media_id, (SELECT min(e.f) FROM ev e WHERE e.media_id = g.media_id AND e.f - g.f >= 120) AS x FROM g WHERE x IS NOT NULL)
      SELECT ev.media_id, ev.f / {RATE}.0::DOUBLE AS time_seconds, round(flux, 2) AS strength_db FROM g JOIN ev ON ev.media_id = g.media_id AND ev.f = g.f""",
    "a8_dense_gate": f"""WITH RECURSIVE {MOMENTS}, ev AS MATERIALIZED (SELECT kind, start_seconds AS t, min(confidence) AS confidence FROM moments GROUP BY ALL),
      g(kind, t) AS (SELECT kind, min(t) FROM ev GROUP BY kind UNION ALL
        SELECT g.kind, (SELECT min(e.t) FROM ev e WHERE e.kind = g.kind AND e.t - g.t >= 21600) AS x FROM g WHERE x IS NOT NULL)
      SELECT ev.kind, ev.t AS start_seconds, confidence FROM g JOIN ev ON ev.kind = g.kind AND ev.t = g.t""",
    "f16_gain_pan": f"""WITH {PACKED}, r AS (SELECT *, dur_tick - line AS pos FROM packed)
      SELECT clip_id, round(volume * CASE WHEN pos < line * 2 THEN greatest(pos, 0) / (line * 2)::DOUBLE ELSE 1 END * CASE WHEN line < line * 3 THEN line / (line * 3)::DOUBLE ELSE 1 END, 9) AS gain,
             round(cos(line / 4.0::DOUBLE * pi() / 4) * sqrt(2), 9) AS "left", round(sin(line / 4.0::DOUBLE * pi() / 4) * sqrt(2), 9) AS "right" FROM r""",
    "g11_mix": f"""WITH {PACKED}, {PCM}, s AS (SELECT clip_id % 10 AS media_id, start_tick AS out0, line AS first, dur_tick AS len, volume, line / 4.0::DOUBLE - 1 AS pan FROM packed),
      j AS (SELECT out0 + frame - first AS frame, sample::DOUBLE * volume * CASE WHEN frame - first < 5 THEN (frame - first) / 5.0::DOUBLE ELSE 1 END * CASE WHEN len - (frame - first) < 7 THEN (len - (frame - first)) / 7.0::DOUBLE ELSE 1 END AS v, pan
            FROM s JOIN pcm ON pcm.media_id = s.media_id AND frame >= first AND frame < first + len)
      SELECT frame, round(greatest(-1, least(1, sum(v * cos((pan + 1) * pi() / 4) * sqrt(2)))), 6) AS "left", round(greatest(-1, least(1, sum(v * sin((pan + 1) * pi() / 4) * sqrt(2)))), 6) AS "right" FROM j GROUP BY frame""",
}
