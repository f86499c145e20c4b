"""Further edits of project tables: placing, moving, retiming, freezing, transitions, effects, looks, tracks, markers.

Each takes tables and returns tables. Rules that a row breaks are told by a column (``reason``, null if none) where many
rows are edited at once; single edits raise EditError.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeexpr as X
from .intervals import interval_join
from .introspect import frame_at
from .timeline import EditError, abutting, accepts, end, lane_order, require_free, shift, split


def place_media(requests: DataFrame, media: DataFrame, rate: tuple[int, int]) -> DataFrame:
    """requests (clip_id, track_id, media_id, src_start, src_dur, start_tick) with dur_tick at the timeline's rate (at least
    1) and the reason why one is refused. Stills have no end."""
    j = requests.join(media.select("media_id", "rate_num", "rate_den", F.col("duration_ticks").alias("_most"), "is_image"), "media_id", "left")
    dur = F.greatest(X.resample(F.col("src_dur"), F.col("rate_num"), F.col("rate_den"), F.lit(rate[0]), F.lit(rate[1])), F.lit(1).cast("long"))
    reason = F.when(F.col("_most").isNull(), "unknown media").when(F.col("src_dur") <= 0, "empty range").when((F.col("src_start") < 0) | ~F.col("is_image") & (F.col("src_start") + F.col("src_dur") > F.col("_most")), "source out of bounds").when(F.col("start_tick") < 0, "before the start")
    return j.withColumn("dur_tick", dur).withColumn("reason", reason).drop("rate_num", "rate_den", "_most", "is_image")


def add(clips: DataFrame, new: DataFrame) -> DataFrame:
    return require_free(clips.unionByName(new.select(*clips.columns)))


def duplicate(clips: DataFrame, clip: int, track: int, start: int, new_id: int) -> DataFrame:
    """A copy elsewhere, with a new id and no link."""
    copy = clips.where(F.col("clip_id") == clip).withColumn("clip_id", F.lit(new_id).cast("long")).withColumn("track_id", F.lit(track).cast("long")).withColumn("start_tick", F.lit(start).cast("long"))
    return add(clips, copy.withColumn("link", F.lit(None).cast("long")) if "link" in clips.columns else copy)


def move(clips: DataFrame, clip: int, track: int, start: int) -> DataFrame:
    if start < 0:
        raise EditError("before the start")
    hit = F.col("clip_id") == clip
    return require_free(clips.withColumn("track_id", F.when(hit, F.lit(track)).otherwise(F.col("track_id"))).withColumn("start_tick", F.when(hit, F.lit(start)).otherwise(F.col("start_tick"))))


def duplicate_all(clips: DataFrame, copies: DataFrame) -> DataFrame:
    """clips and copies of them (copies: clip_id, new_id, to_track, to_start), with new ids and no link. Copies that don't fit
    are for ``require_free`` to find."""
    j = clips.join(copies, "clip_id")
    new = {"clip_id": F.col("new_id"), "track_id": F.col("to_track"), "start_tick": F.col("to_start"), "link": F.lit(None).cast("long")}
    return clips.unionByName(j.select(*(new[c].cast(clips.schema[c].dataType).alias(c) if c in new else F.col(c) for c in clips.columns)))


def move_all(clips: DataFrame, tracks: DataFrame, moves: DataFrame, content: Column, width: int = 64) -> DataFrame:
    """clips moved (moves: clip_id, to_track, to_start), with the reason why one stays: its content isn't for that kind of
    track, or another clip is in the way, where that was before the moves."""
    kinds = tracks.select(F.col("track_id").alias("to_track"), F.col("kind").alias("_kind"))
    asked = clips.withColumn("_content", content).join(moves, "clip_id").join(kinds, "to_track", "left").select("clip_id", "to_track", "to_start", "_kind", "_content", F.col("dur_tick").alias("_dur"))
    others = clips.select(F.col("clip_id").alias("_other"), F.col("track_id").alias("to_track"), "start_tick", "dur_tick")
    hits = interval_join(asked.select("clip_id", "to_track", "to_start", "_dur"), others, ["to_track"], ("to_start", "_dur"), ("start_tick", "dur_tick"), width).where("clip_id <> _other").select("clip_id").distinct().withColumn("_hit", F.lit(True))
    judged = asked.join(hits, "clip_id", "left")
    reason = F.when(F.col("_kind").isNull(), "unknown track").when(F.col("to_start") < 0, "before the start").when(~accepts(F.col("_kind"), F.col("_content")), "wrong kind of track").when(F.col("_hit"), "overlap")
    decided = judged.select("clip_id", "to_track", "to_start", reason.alias("reason"))
    j = clips.join(decided, "clip_id", "left")
    go = F.col("to_track").isNotNull() & F.col("reason").isNull()
    return j.withColumn("track_id", F.when(go, F.col("to_track")).otherwise(F.col("track_id"))).withColumn("start_tick", F.when(go, F.col("to_start")).otherwise(F.col("start_tick"))).select(*clips.columns, "reason")


def insertion_slots(drops: DataFrame, clips: DataFrame) -> DataFrame:
    """drops (drop_id, track_id, at) with slot: the start of the first clip whose middle lies right of the drop, or else the end
    of the track's last clip; 0 on an empty track."""
    middles = clips.select("track_id", (F.col("start_tick") + F.floor(F.col("dur_tick") / 2)).alias("pts"), "start_tick")
    # the first middle above the drop: one at least one tick later
    found = frame_at(drops.select("drop_id", "track_id", (F.col("at") + 1).alias("t")), middles.select("track_id", "pts").distinct(), ["track_id"])
    starts = middles.groupBy("track_id", "pts").agg(F.min("start_tick").alias("start_tick"))
    ends = clips.groupBy("track_id").agg(F.max(end()).alias("_end"))
    return found.join(starts, ["track_id", "pts"], "left").join(ends, "track_id", "left").select("drop_id", F.coalesce("start_tick", "_end", F.lit(0).cast("long")).alias("slot"))


def trim_limits(clips: DataFrame, ripple: bool = False) -> DataFrame:
    """clips (with head_room and tail_room, the source's ticks beyond each edge) with head_low, head_high, tail_low and
    tail_high: how far each edge may go. Neighbours bound it unless later clips ripple; a clip keeps one tick."""
    w = Window.partitionBy("track_id").orderBy("start_tick", "clip_id")
    before = F.coalesce(F.lag(end()).over(w), F.lit(0)) if not ripple else F.lit(0)
    after = F.lead("start_tick").over(w) if not ripple else F.lit(None).cast("long")
    head = F.greatest(before, F.col("start_tick") - F.col("head_room"), F.lit(0)) - F.col("start_tick")
    tail = F.least(after, end() + F.col("tail_room")) - end()  # least skips nulls
    return clips.withColumns({"head_low": head, "head_high": F.col("dur_tick") - 1, "tail_low": 1 - F.col("dur_tick"), "tail_high": tail})


def resolve_trims(clips: DataFrame, drags: DataFrame, linked: bool = True, ripple: bool = False) -> DataFrame:
    """clip_id, start_tick and dur_tick after drags of an edge (drags: clip_id, head, delta). With ``linked`` the clips of a
    link are dragged along, and the delta is one that all of them allow."""
    limits = trim_limits(clips, ripple)
    asked = limits.join(drags, "clip_id").select(F.col("clip_id").alias("dragged"), "link", "head", "delta")
    group = limits.select("clip_id", "link", "start_tick", "dur_tick", "head_low", "head_high", "tail_low", "tail_high")
    own = asked.join(group.drop("link"), F.col("dragged") == F.col("clip_id")).drop("link")
    if linked:
        others = asked.where("link IS NOT NULL").join(group, "link").where("clip_id <> dragged").drop("link")
        own = own.unionByName(others)
    low, high = F.when(F.col("head"), F.col("head_low")).otherwise(F.col("tail_low")), F.when(F.col("head"), F.col("head_high")).otherwise(F.col("tail_high"))
    bounds = own.groupBy("dragged").agg(F.max(low).alias("_low"), F.min(high).alias("_high"))
    moved = own.join(bounds, "dragged").withColumn("_d", F.least(F.greatest("delta", "_low"), "_high"))
    return moved.select("dragged", "clip_id", F.when(F.col("head"), F.col("start_tick") + F.col("_d")).otherwise(F.col("start_tick")).alias("start_tick"), F.when(F.col("head"), F.col("dur_tick") - F.col("_d")).otherwise(F.col("dur_tick") + F.col("_d")).alias("dur_tick"))


def retime(clips: DataFrame, speeds: DataFrame) -> DataFrame:
    """New lengths at new speeds. speeds: clip_id, num, den. A clip that would meet its right neighbour, or whose speed
    isn't positive, stays as it is; ``reason`` tells why."""
    j = clips.join(speeds, "clip_id", "left")
    dur = X.retimed_duration(F.col("src_dur"), F.col("num"), F.when(F.col("den") > 0, F.col("den")).otherwise(1))
    nxt = F.lead("start_tick").over(Window.partitionBy("track_id").orderBy("start_tick", "clip_id"))
    positive = (F.col("num") > 0) & (F.col("den") > 0)
    reason = F.when(F.col("num").isNull(), F.lit(None)).when(~positive, "speed must be positive").when(F.col("start_tick") + F.when(positive, dur) > F.col("_next"), "overlap")
    out = j.withColumn("_next", nxt).withColumn("reason", reason)
    return out.withColumn("dur_tick", F.when(F.col("num").isNotNull() & F.col("reason").isNull(), dur).otherwise(F.col("dur_tick"))).select(*clips.columns, "reason")


def freeze(clips: DataFrame, clip: int, at: int, hold: int, new_ids: tuple[int, int]) -> DataFrame:
    """Hold the frame at a tick of a clip: the clip is split there (not at its start), what follows moves on by ``hold``,
    and a held clip comes into the hole."""
    own = clips.where(F.col("clip_id") == clip).select("track_id", "start_tick", end().alias("end_tick")).first()
    if own is None or not own["start_tick"] <= at < own["end_tick"]:
        raise EditError("the tick lies outside the clip")
    cut = clips
    if at > own["start_tick"]:
        cut = split(clips, clips.sparkSession.createDataFrame([(clip, at)], "clip_id long, cut long"), new_ids[0])
    held = clips.where(F.col("clip_id") == clip).withColumn("clip_id", F.lit(new_ids[1]).cast("long")).withColumn("start_tick", F.lit(at).cast("long")).withColumn("dur_tick", F.lit(hold).cast("long"))
    return require_free(shift(cut, own["track_id"], at, hold).unionByName(held))


def upsert_transitions(transitions: DataFrame, clips: DataFrame, new: DataFrame) -> DataFrame:
    """transitions and new: left_id, right_id, name, duration (at least 1). New ones need clips that touch; they take the
    place of others on the same cut."""
    legal = new.where("duration >= 1").join(abutting(clips).select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")
    return transitions.join(legal, ["left_id", "right_id"], "left_anti").unionByName(legal.select(*transitions.columns))


def prune_transitions(transitions: DataFrame, clips: DataFrame) -> DataFrame:
    return transitions.join(abutting(clips).select("left_id", "right_id"), ["left_id", "right_id"], "left_semi")


def move_effect(effects: DataFrame, moves: DataFrame) -> DataFrame:
    """Chains of effects (clip_id, position from 0, effect) with one effect of a clip moved: moves are clip_id, a, b."""
    j = effects.join(moves, "clip_id", "left")
    p, a, b = F.col("position"), F.col("a"), F.col("b")
    to = F.when(a.isNull(), p).when(p == a, b).when((a < b) & (p > a) & (p <= b), p - 1).when((b < a) & (p >= b) & (p < a), p + 1).otherwise(p)
    return j.withColumn("position", to).select(*effects.columns)


def remove_effect(effects: DataFrame, gone: DataFrame) -> DataFrame:
    """Without an effect of a clip (clip_id, at); later ones move up."""
    j = effects.join(gone, "clip_id", "left")
    kept = j.where(F.col("at").isNull() | (F.col("position") != F.col("at")))
    return kept.withColumn("position", F.when(F.col("at").isNotNull() & (F.col("position") > F.col("at")), F.col("position") - 1).otherwise(F.col("position"))).select(*effects.columns)


def set_values(table: DataFrame, key: str, changes: DataFrame) -> DataFrame:
    """Columns of rows with a key replaced by those of ``changes`` that aren't null: flags, names, look structs."""
    names = [c for c in changes.columns if c != key]
    j = table.join(changes.select(key, *(F.col(c).alias(f"_n_{c}") for c in names)), key, "left")
    return j.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns))


def move_track(tracks: DataFrame, track: int, to: int) -> DataFrame:
    """A track put at a place in the order; lanes keep their zones."""
    w = Window.orderBy(F.when(F.col("track_id") == track, F.lit(to - 0.5)).otherwise(F.col("order_idx").cast("double")), "track_id")
    placed = tracks.withColumn("order_idx", (F.row_number().over(w) - 1).cast("long"))
    return lane_order(placed).withColumn("order_idx", F.col("lane")).select(*tracks.columns)


def remove_track(tracks: DataFrame, clips: DataFrame, track: int) -> tuple[DataFrame, DataFrame]:
    left = lane_order(tracks.where(F.col("track_id") != track)).withColumn("order_idx", F.col("lane")).select(*tracks.columns)
    return left, clips.where(F.col("track_id") != track)


def markers_upsert(markers: DataFrame, new: DataFrame) -> DataFrame:
    return markers.join(new, "id", "left_anti").unionByName(new.select(*markers.columns)).orderBy("tick", "id")


def slot_windows(slots: DataFrame, rate: tuple[int, int]) -> DataFrame:
    """slots (dur_tick, num, den, reversed, rate_num, rate_den, most, is_image, src_start) with src_dur, rounded up so that
    a fill covers its slot, and the reason why one is refused."""
    d = lambda x: F.col(x).cast("decimal(38,0)")
    numer = d("dur_tick") * rate[1] * d("num") * d("rate_num")
    denom = F.lit(rate[0]).cast("decimal(38,0)") * d("den") * d("rate_den")
    up = X.truncated(numer + denom - F.lit(1).cast("decimal(1,0)"), denom)
    dur = F.greatest(up, F.lit(1).cast("long"))
    reason = F.when(F.col("reversed"), "retimed slot").when((F.col("src_start") < 0) | ~F.col("is_image") & (F.col("src_start") + F.col("src_dur") > F.col("most")), "media too short")
    return slots.withColumn("src_dur", dur).withColumn("reason", reason)


def nearest_junction(points: DataFrame, clips: DataFrame, threshold: int) -> DataFrame:
    """points (probe, track_id, t) with the nearest cut of the track within the threshold: left_id, right_id and cut."""
    cuts = abutting(clips).withColumn("_b", F.floor(F.col("cut") / threshold))
    b = F.floor(F.col("t") / threshold)
    asked = points.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    near = asked.join(cuts, ["track_id", "_b"]).where(F.abs(F.col("cut") - F.col("t")) <= threshold)
    best = near.groupBy("probe").agg(F.min(F.struct(F.abs(F.col("cut") - F.col("t")).alias("d"), "cut", "left_id", "right_id")).alias("j"))
    return points.join(best, "probe", "left").select("probe", F.col("j.left_id").alias("left_id"), F.col("j.right_id").alias("right_id"), F.col("j.cut").alias("cut"))
