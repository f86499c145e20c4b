"""Gestures of an editor as compositions of a project's commands: each is one step of its history, and all or nothing.

Times are in seconds. The main track is the lowest video track; its clips follow each other without gaps, so edits there
move later clips. Overlays go to the first track of their kind that is free, or to a new one. Media have been imported
before, and are named by their ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import functions as F

from .operators import catalogs
from .operators.timeline import EditError
from .project import TRANSFORM, Project, clip_param

# Seconds of overlays and of held frames where none are given, and the pose of a picture in the picture.
OVERLAY_SECONDS = 3.0
PICTURE_IN_PICTURE = {"position_y": -0.18, "scale_x": 0.5, "scale_y": 0.5}
LANES = {"effect": "effect", "filter": "filter", "adjustment": "adjustment"}


def _one_step(method: Callable) -> Callable:
    @wraps(method)
    def run(self, *args, **kwargs):
        with self.project.group():
            return method(self, *args, **kwargs)

    return run


class Intents:
    def __init__(self, project: Project):
        self.project = project

    # helpers

    def ticks(self, seconds: float) -> int:
        num, den = self.project.state.rate
        return max(0, math.floor(seconds * num / den + 0.5))

    def main(self, create: bool = False) -> int:
        found = self.project.state.tracks.where("kind = 'video'").orderBy("order_idx").select("track_id").first()
        if found is None and not create:
            raise EditError("there is no main track")
        return found[0] if found else self.project.add_track("video", "main")

    def _clips(self, track: int):
        return self.project.state.clips.where(F.col("track_id") == track)

    def _end(self, track: int) -> int:
        return self._clips(track).agg(F.max(F.col("start_tick") + F.col("dur_tick"))).first()[0] or 0

    def _medium(self, media: int) -> dict:
        found = self.project.state.media.where(F.col("media_id") == media).first()
        if found is None:
            raise EditError(f"no medium {media}")
        return found.asDict()

    def _on_main(self, clip: int) -> dict:
        own = self.project._clip(clip)
        if own["track_id"] != self.main():
            raise EditError("the clip isn't on the main track")
        return own

    def lane(self, kind: str, start: int, dur: int, but: int | None = None) -> int:
        """The first track of a kind, but not the main one, that is free there; a new one if none is."""
        s = self.project.state
        tracks = s.tracks.where((F.col("kind") == kind) & ~F.col("locked"))
        if kind == "video":
            tracks = tracks.where(F.col("track_id") != self.main(create=True))
        inside = s.clips.where((F.col("start_tick") < start + dur) & (F.col("start_tick") + F.col("dur_tick") > start))
        taken = inside if but is None else inside.where(F.col("clip_id") != but)
        free = tracks.join(taken.select("track_id"), "track_id", "left_anti").orderBy("order_idx").select("track_id").first()
        return free[0] if free else self.project.add_track(kind)

    def _place(self, track: int, media: int, start: int, dur: int | None = None) -> int:
        own = self._medium(media)
        return self.project.add_clip(track, media, 0, dur or own["duration_ticks"], start)

    def _generated(self, kind: str, content: str, at: float, seconds: float) -> int:
        start, dur = self.ticks(at), max(1, self.ticks(seconds))
        return self.project.add_generated(self.lane(kind, start, dur), content, start, dur)

    # the main track

    @_one_step
    def append_main(self, media: list[int]) -> list[int]:
        """Each at the end of the main track; sound alone goes to an audio track."""
        out = []
        for m in media:
            if self._medium(m)["width"] == 0:
                out.append(self.add_audio(m, self._end(self.main(create=True)) * self.project.state.rate[1] / self.project.state.rate[0]))
            else:
                track = self.main(create=True)
                out.append(self._place(track, m, self._end(track)))
        return out

    @_one_step
    def insert_main(self, media: int, at: float) -> int:
        """At the cut of the main track that is nearest, the earlier of two."""
        track, t = self.main(create=True), self.ticks(at)
        cuts = self._clips(track).select(F.explode(F.array("start_tick", F.col("start_tick") + F.col("dur_tick"))).alias("cut"))
        near = cuts.orderBy(F.abs(F.col("cut") - t), "cut").first()
        own = self._medium(media)
        return self.project.ripple_insert(track, media, 0, own["duration_ticks"], near[0] if near else 0)

    @_one_step
    def ripple_trim_main(self, clip: int, edge: str, seconds: float) -> None:
        """Move an edge (``leading`` or ``trailing``; to the right if positive) and later clips with it. One tick stays."""
        own = self._on_main(clip)
        start, dur, track = own["start_tick"], own["dur_tick"], own["track_id"]
        d = int(math.copysign(self.ticks(abs(seconds)), seconds))
        d = min(d, dur - 1) if edge == "leading" else max(d, 1 - dur)
        grows = d < 0 if edge == "leading" else d > 0
        by = -d if edge == "leading" else d  # of the clip's length
        if by == 0:
            return
        cut = (start + d, dur - d) if edge == "leading" else (start, dur + d)
        if grows:  # room first
            self.project.shift_clips(track, start if edge == "leading" else start + dur, by)
            self.project.trim_clip(clip, start if edge == "leading" else cut[0], cut[1])
        else:
            self.project.trim_clip(clip, *cut)
            self.project.shift_clips(track, cut[0] if edge == "leading" else start + dur, by)

    @_one_step
    def insert_into_main(self, clip: int, index: int) -> None:
        """A clip as the index-th of the main track; one that is there already is counted out first."""
        main, own = self.main(create=True), self.project._clip(clip)
        others = self._clips(main).where(F.col("clip_id") != clip).orderBy("start_tick").limit(max(0, index)).agg(F.sum("dur_tick")).first()[0] or 0
        start, dur = own["start_tick"], own["dur_tick"]
        if own["track_id"] == main:
            if start == others:
                return
            self.project.move_clip(clip, main, self._end(main))
            self.project.shift_clips(main, start, -dur)
        self.project.shift_clips(main, others, dur)
        self.project.move_clip(clip, main, others)

    @_one_step
    def set_transition(self, clip: int, name: str | None, seconds: float = 0.0) -> None:
        """At the cut right of a clip; None takes it away."""
        own = self._on_main(clip)
        after = self._clips(own["track_id"]).where(F.col("start_tick") == own["start_tick"] + own["dur_tick"]).select("clip_id").first()
        if after is None:
            raise EditError("there is no cut")
        if name is None:
            self.project.remove_transition(clip, after[0])
        else:
            self.project.add_transition(clip, after[0], name, self.ticks(seconds) or catalogs.TRANSITION_TICKS)

    @_one_step
    def freeze(self, clip: int, at: float, seconds: float = OVERLAY_SECONDS) -> int:
        self._on_main(clip)
        return self.project.freeze_frame(clip, self.ticks(at), max(1, self.ticks(seconds)))

    # any track

    @_one_step
    def split(self, clip: int, at: float) -> int:
        return self.project.split_clip(clip, self.ticks(at))

    @_one_step
    def trim_lane(self, clip: int, start: float, seconds: float) -> None:
        self.project.trim_clip(clip, self.ticks(start), max(1, self.ticks(seconds)))

    @_one_step
    def move_lane(self, clip: int, start: float, track: int | None = None) -> int:
        """To a track, or to the first free one of the same kind. The main track closes up behind a clip that leaves it."""
        own, t = self.project._clip(clip), self.ticks(start)
        from_main = self.project._kind_of_track(own["track_id"]) == "video" and own["track_id"] == self.main()
        target = self.lane(self.project._kind_of_track(own["track_id"]), t, own["dur_tick"], clip) if track is None else track
        self.project.move_clip(clip, target, t)
        if from_main and target != own["track_id"]:
            self.project.shift_clips(own["track_id"], own["start_tick"] + own["dur_tick"], -own["dur_tick"])
        return target

    @_one_step
    def duplicate(self, clip: int) -> int:
        """Right after itself; what follows on the main track makes room, elsewhere the first free track takes it."""
        own = self.project._clip(clip)
        after, track = own["start_tick"] + own["dur_tick"], own["track_id"]
        if self.project._kind_of_track(track) == "video" and track == self.main():
            self.project.shift_clips(track, after, own["dur_tick"])
        else:
            track = self.lane(self.project._kind_of_track(track), after, own["dur_tick"])
        return self.project.duplicate_clip(clip, track, after)

    @_one_step
    def replace_media(self, clip: int, media: int) -> None:
        """A medium as long as the clip needs; a still is always."""
        own = self.project._clip(clip)
        self.project.set_clip_media(clip, media, 0, own["src_dur"] or own["dur_tick"])

    @_one_step
    def extract_audio(self, clip: int) -> int:
        own = self.project._clip(clip)
        return self.project.extract_audio(clip, self.lane("audio", own["start_tick"], own["dur_tick"]))

    @_one_step
    def set_speed(self, clip: int, speed: float, reverse: bool = False) -> None:
        """In steps of a hundredth."""
        hundredths = math.floor(speed * 100 + 0.5)
        common = math.gcd(hundredths, 100) or 1
        self.project.set_clip_speed(clip, hundredths // common, 100 // common, reverse)

    @_one_step
    def set_speed_preset(self, clip: int, preset: str | None) -> None:
        if preset is not None and preset not in catalogs.SPEED_PRESETS:
            raise EditError(f"no such preset: {preset}")
        self.project.set_speed_curve(clip, [(round(p * 1000), v, e) for p, v, e in catalogs.SPEED_PRESETS[preset]] if preset else None)

    @_one_step
    def set_audio(self, clip: int, volume: float | None = None, fade_in: float = 0.0, fade_out: float = 0.0) -> None:
        own = self.project._clip(clip)
        self.project.set_clip_audio(clip, own["volume"] if volume is None else volume, own["pan"], self.ticks(fade_in), self.ticks(fade_out))

    @_one_step
    def set_transform(self, clip: int, x: float, y: float, scale: float, rotation: float, opacity: float, at: float | None = None) -> None:
        """x and y from 0 to 1 across the canvas."""
        values = {"position_x": x - 0.5, "position_y": y - 0.5, "scale_x": scale, "scale_y": scale, "rotation": rotation, "opacity": opacity}
        self.project.set_clip_transform(clip, None if at is None else self.ticks(at), **values)

    @_one_step
    def toggle_transform_keyframe(self, clip: int, at: float) -> bool:
        """Keyframes of the placement at a time: removed if there are any, or else set to what holds there. Tells which."""
        p, t = self.project, self.ticks(at)
        local = t - p._clip(clip)["start_tick"]
        names = [clip_param(clip, n) for n in TRANSFORM]
        there = [r[0] for r in p.state.keyframes.where(F.col("param_id").isin(*names) & (F.col("tick") == local)).select("param_id").collect()]
        for param in there:
            p.remove_keyframe(param, local)
        if not there:
            now = p.sampled_transforms(p.spark.createDataFrame([(clip, t)], "clip_id long, t long")).first()
            for n in TRANSFORM:
                p.set_keyframe(clip_param(clip, n), local, now[n])
        return not there

    # overlays

    @_one_step
    def add_text(self, at: float, seconds: float = OVERLAY_SECONDS) -> int:
        return self._generated("text", "text", at, seconds)

    @_one_step
    def add_sticker(self, at: float, seconds: float = OVERLAY_SECONDS) -> int:
        return self._generated("sticker", "sticker", at, seconds)

    @_one_step
    def add_effect(self, kind: str, at: float, seconds: float = OVERLAY_SECONDS) -> int:
        """A bar of an effect, a filter or adjustments."""
        return self._generated(LANES[kind], kind, at, seconds)

    @_one_step
    def add_pip(self, media: int, at: float) -> int:
        """A picture of half the size in the upper half."""
        start, dur = self.ticks(at), self._medium(media)["duration_ticks"]
        clip = self._place(self.lane("video", start, dur), media, start)
        self.project.set_clip_transform(clip, **PICTURE_IN_PICTURE)
        return clip

    @_one_step
    def add_audio(self, media: int, at: float, role: str | None = None) -> int:
        start, dur = self.ticks(at), self._medium(media)["duration_ticks"]
        clip = self._place(self.lane("audio", start, dur), media, start)
        if role:
            self.project.set_look(clip, audio_role=role)
        return clip
