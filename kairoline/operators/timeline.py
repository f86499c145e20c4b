"""Timelines as tables: clips are rows (clip_id, track_id, start_tick, dur_tick, ...), edits map a table to a table.

An edit that the rules forbid raises EditError before anything is returned; checks are one aggregate over the tracks it
touches. Versions give undo and redo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeexpr as X
from .intervals import overlaps_before, stab_join
from .introspect import positions

#: Which content a kind of track takes (fixed values).
ACCEPTS = {
    "video": ("media_video", "media_image", "solid", "shape"),
    "audio": ("media_audio", "media_video"),
    "text": ("text",),
    "sticker": ("sticker", "lottie"),
    "effect": ("effect",),
    "filter": ("filter",),
    "adjustment": ("adjustment",),
}
VISUAL = ("video", "text", "sticker", "effect", "filter", "adjustment")
#: Order of lanes from the bottom: audio, the main lane, others, text.
ZONES = {"audio": 0, "text": 3}


class EditError(ValueError):
    """An edit that would break a rule of the timeline."""


def end(prefix: str = "") -> Column:
    return F.col(f"{prefix}start_tick") + F.col(f"{prefix}dur_tick")


def accepts(kind: Column, content: Column) -> Column:
    out = F.lit(False)
    for k, contents in ACCEPTS.items():
        out = out | (kind == k) & content.isin(*contents)
    return out


def overlapping(clips: DataFrame) -> DataFrame:
    """Clips that begin before an earlier one on their track has ended."""
    return clips.withColumn("_over", overlaps_before(clips, ["track_id"], "start_tick", "dur_tick", ["clip_id"])).where("_over").drop("_over")


def require_free(clips: DataFrame) -> DataFrame:
    if overlapping(clips).limit(1).count():
        raise EditError("clips overlap")
    return clips


def abutting(clips: DataFrame) -> DataFrame:
    """left_id and right_id of clips that touch on a track, and the cut's tick."""
    a = clips.select(F.col("clip_id").alias("left_id"), "track_id", end().alias("cut"))
    b = clips.select(F.col("clip_id").alias("right_id"), "track_id", F.col("start_tick").alias("cut"))
    return a.join(b, ["track_id", "cut"]).where("left_id <> right_id")


def shift(clips: DataFrame, track: int, start: int, delta: int) -> DataFrame:
    """Move all clips of a track that begin at ``start`` or later by ``delta``; without any, nothing changes."""
    if delta == 0:
        raise EditError("a shift needs a distance")
    own = clips.where(F.col("track_id") == track)
    moved = F.col("start_tick") >= start
    at = own.agg(F.min(F.when(moved, F.col("start_tick"))).alias("first"), F.max(F.when(~moved, end())).alias("before")).first()
    if at["first"] is not None and at["first"] + delta < max(0, at["before"] or 0):
        raise EditError("shifted clips would meet an earlier clip or the start")
    return clips.withColumn("start_tick", F.when((F.col("track_id") == track) & moved, F.col("start_tick") + delta).otherwise(F.col("start_tick")))


def shift_all(clips: DataFrame, moves: DataFrame) -> DataFrame:
    """The same for many tracks at once. moves: track_id, from_tick, delta. Tracks where it is forbidden keep their
    clips; ``shifted`` tells which clips moved."""
    own = clips.join(moves, "track_id", "left")
    later = F.coalesce(F.col("start_tick") >= F.col("from_tick"), F.lit(False))
    track = Window.partitionBy("track_id")
    first, before = F.min(F.when(later, F.col("start_tick"))).over(track), F.max(F.when(~later, end())).over(track)
    legal = (F.col("delta") != 0) & (first + F.col("delta") >= F.greatest(F.lit(0), F.coalesce(before, F.lit(0))))
    out = own.withColumn("shifted", F.coalesce(later & legal, F.lit(False)))
    return out.withColumn("start_tick", F.when(F.col("shifted"), F.col("start_tick") + F.col("delta")).otherwise(F.col("start_tick"))).select(*clips.columns, "shifted")


def remove(clips: DataFrame, ids: list[int]) -> DataFrame:
    return clips.where(~F.col("clip_id").isin(*ids)) if ids else clips


def ripple_delete(clips: DataFrame, gone: DataFrame) -> DataFrame:
    """Remove clips (clip_id) and close their gaps: a clip moves left by the removed length before it on its track."""
    marked = clips.join(gone.select("clip_id", F.lit(True).alias("_gone")), "clip_id", "left")
    w = Window.partitionBy("track_id").orderBy("start_tick", "clip_id").rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(F.when(F.col("_gone"), F.col("dur_tick")).otherwise(0)).over(w), F.lit(0))
    out = marked.withColumn("start_tick", (F.col("start_tick") - freed).cast("long"))
    return out.where(F.col("_gone").isNull()).select(*clips.columns)


def ripple_insert(clips: DataFrame, track: int, at: int, new: DataFrame) -> DataFrame:
    """Open a hole for ``new`` (one clip of the same columns, from ``at``) and put it there."""
    length = new.agg(F.sum("dur_tick")).first()[0]
    return require_free(shift(clips, track, at, int(length)).unionByName(new))


def split(clips: DataFrame, cuts: DataFrame, next_id: int) -> DataFrame:
    """Cut clips at ticks strictly inside them. cuts: clip_id, cut (one for each clip). The right part gets a new id, counted
    up from ``next_id`` in order of clip_id, and begins in the source where the left one ends."""
    new = positions(cuts, F.floor(F.col("clip_id") / 4096), ["clip_id"]).withColumn("_new", F.col("position") - 1 + next_id).drop("position")
    both = clips.join(new, "clip_id", "left")
    inside = (F.col("cut") > F.col("start_tick")) & (F.col("cut") < end())
    whole = F.struct(F.col("clip_id").alias("id"), F.col("start_tick").alias("s"), F.col("dur_tick").alias("d"))
    left = F.struct(F.col("clip_id").alias("id"), F.col("start_tick").alias("s"), (F.col("cut") - F.col("start_tick")).alias("d"))
    right = F.struct(F.col("_new").cast("long").alias("id"), F.col("cut").alias("s"), (end() - F.col("cut")).alias("d"))
    parts = both.withColumn("_p", F.explode(F.when(inside, F.array(left, right)).otherwise(F.array(whole))))
    return parts.withColumn("clip_id", F.col("_p.id")).withColumn("start_tick", F.col("_p.s")).withColumn("dur_tick", F.col("_p.d").cast("long")).select(*clips.columns)


def trim(clips: DataFrame, edges: DataFrame, source: tuple[str, str] = ("src_start", "src_dur")) -> DataFrame:
    """New start and length of clips. edges: clip_id, new_start, new_dur (at least 1). The source follows the head that is cut, at the
    clip's speed if it has num and den; a reversed clip loses source from its tail. A start before the source's is refused by
    leaving the clip as it is. Clips without a source have no such bound."""
    a, n = source
    both = clips.join(edges, "clip_id", "left")
    in_source = lambda x: X.scale_by_speed(x, F.col("num"), F.col("den")) if "num" in clips.columns else x
    head, length = in_source(F.col("new_start") - F.col("start_tick")), F.greatest(in_source(F.col("new_dur")), F.lit(1).cast("long"))
    from_source = F.when(F.col("reversed"), F.col(a) + F.col(n) - head - length).otherwise(F.col(a) + head)
    legal = F.coalesce((F.col("new_dur") >= 1) & (F.col("new_start") >= 0) & F.coalesce(from_source >= 0, F.lit(True)), F.lit(False))
    pick = lambda new, old: F.when(legal, new).otherwise(F.col(old)).cast("long").alias(old)
    changed = {"start_tick": pick(F.col("new_start"), "start_tick"), "dur_tick": pick(F.col("new_dur"), "dur_tick"), a: pick(from_source, a), n: pick(F.when(F.col(n).isNotNull(), length), n)}
    return both.select(*(changed.get(c, F.col(c)) for c in clips.columns))


def link(clips: DataFrame, ids: DataFrame, group: int) -> DataFrame:
    chosen = ids.select("clip_id", F.lit(True).alias("_in"))
    return clips.join(chosen, "clip_id", "left").withColumn("link", F.when(F.col("_in"), F.lit(group).cast("long")).otherwise(F.col("link"))).select(*clips.columns)


def unlink(clips: DataFrame, ids: DataFrame) -> DataFrame:
    """Dissolve every group that one of the clips is in."""
    groups = clips.join(ids.select("clip_id"), "clip_id", "left_semi").where("link IS NOT NULL").select("link").distinct().withColumn("_gone", F.lit(True))
    return clips.join(groups, "link", "left").withColumn("link", F.when(F.col("_gone").isNull(), F.col("link"))).select(*clips.columns)


def lane_order(tracks: DataFrame) -> DataFrame:
    """Lanes from the bottom: audio, main, others, text, else as they were. The first video track is the main one."""
    first = F.min(F.when(F.col("kind") == "video", F.struct("order_idx", "track_id"))).over(Window.partitionBy(F.lit(0)))
    main = tracks.withColumn("main", F.coalesce((F.col("kind") == "video") & (F.col("track_id") == first["track_id"]), F.lit(False)))
    zone = F.when(F.col("main"), 1).when(F.col("kind") == "audio", ZONES["audio"]).when(F.col("kind") == "text", ZONES["text"]).otherwise(2)
    return main.withColumn("lane", (F.row_number().over(Window.orderBy(zone, "order_idx", "track_id")) - 1).cast("long"))


def first_free_lane(ticks: DataFrame, clips: DataFrame, tracks: DataFrame, bucket: int) -> DataFrame:
    """probe and lane: of the tracks, in their order, the first without a clip at the probe's tick (probe, t); probes for
    which there is none are left out.

    The tracks are numbered from 0; the lowest number that isn't busy is the first one that the sorted busy numbers skip.
    So free tracks, which are most, are never listed."""
    number = (F.row_number().over(Window.orderBy("order_idx", "track_id")) - 1).cast("long")
    lanes = tracks.select("track_id", "order_idx").withColumn("n", number).select("track_id", "n")
    times = ticks.select("t").distinct()
    busy = stab_join(times, clips.select("track_id", "start_tick", "dur_tick").join(lanes, "track_id"), [], "t", ("start_tick", "dur_tick"), bucket).select("t", "n").distinct()
    place = (F.row_number().over(Window.partitionBy("t").orderBy("n")) - 1).cast("long")
    first = busy.withColumn("p", place).groupBy("t").agg(F.coalesce(F.min(F.when(F.col("n") > F.col("p"), F.col("p"))), F.count("*")).alias("n"))
    found = ticks.select("probe", "t").join(first, "t", "left").select("probe", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return found.join(lanes, "n").select("probe", F.col("track_id").alias("lane"))


def source_in_timeline(beat: Column, start: Column, dur: Column, src_start: Column, src_dur: Column, num: Column, den: Column, reverse: Column) -> Column:
    """A source tick as a timeline tick, rounded; null outside the source window."""
    offset = F.when(reverse, src_start + src_dur - 1 - beat).otherwise(beat - src_start)
    inside = (beat >= src_start) & (beat < src_start + src_dur)
    return F.when(inside, start + F.least(F.round(offset * den / num).cast("long"), dur - 1))


class History:
    """Versions of a table: an edit adds one, undo and redo move between them, a group is one edit."""

    def __init__(self, table: DataFrame, limit: int = 100):
        self.limit, self.versions, self.at, self.saved = limit, [table], 0, 0
        self._group: DataFrame | None = None

    @property
    def table(self) -> DataFrame:
        return self._group if self._group is not None else self.versions[self.at]

    def apply(self, edit, *args, **kwargs) -> DataFrame:
        new = edit(self.table, *args, **kwargs)
        if self._group is not None:
            self._group = new
        else:
            self._push(new)
        return new

    def _push(self, table: DataFrame) -> None:
        self.versions = [*self.versions[: self.at + 1], table][-(self.limit + 1) :]
        self.at = len(self.versions) - 1

    def begin(self) -> None:
        self._group = self.table

    def commit(self) -> None:
        if self._group is not None:
            group, self._group = self._group, None
            self._push(group)

    def rollback(self) -> None:
        self._group = None

    def undo(self) -> bool:
        moved = self.at > 0
        self.at -= moved
        return moved

    def redo(self) -> bool:
        moved = self.at + 1 < len(self.versions)
        self.at += moved
        return moved


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("Column", "DataFrame", "Window", "F", "X")]
