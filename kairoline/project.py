"""A project as tables with a history: the commands of an editor as methods.

Every command reads the current tables and pushes new ones as one version; commands between ``group()`` and its end are one
version, and none of them counts if one fails. Tables are ordinary DataFrames and may be as large as one likes. A table
that CUT_EVERY edits have changed is written to the project's folder and read again, so that the plan of the next edit
stays as small as that, however many came before.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import easing, timeexpr
from .operators import catalogs, edits, look_rules, params, timeline
from .operators.timeline import EditError
from .sources import project as documents

TRACKS = "track_id long, order_idx long, kind string, name string, enabled boolean, muted boolean, locked boolean, duck_source boolean"
CLIPS = "clip_id long, track_id long, start_tick long, dur_tick long, media_id long, src_start long, src_dur long, num long, den long, reversed boolean, volume double, pan double, fade_in long, fade_out long, beats array<bigint>, look map<string,string>, link long"
MEDIA = "media_id long, path string, width long, height long, rate_num int, rate_den int, duration_ticks long, has_audio boolean, is_image boolean"
MARKERS = "id long, tick long, name string, color string"
TRANSITIONS = "left_id long, right_id long, name string, duration long"
EFFECTS = "clip_id long, position int, effect string, params map<string,double>"
KEYFRAMES = "param_id string, tick long, value double, easing string"
CONSTANTS = "param_id string, value double"
_TABLES = {"tracks": TRACKS, "clips": CLIPS, "media": MEDIA, "markers": MARKERS, "transitions": TRANSITIONS, "effects": EFFECTS, "keyframes": KEYFRAMES, "constants": CONSTANTS}
# A clip's animated placement with its defaults, the least and greatest speed, and what a slot may hold.
TRANSFORM = {"position_x": 0.0, "position_y": 0.0, "anchor_x": 0.5, "anchor_y": 0.5, "scale_x": 1.0, "scale_y": 1.0, "rotation": 0.0, "opacity": 1.0}
SPEEDS = (0.05, 100.0)
SLOTS = {"any": ("video", "image"), "video_only": ("video",), "image_only": ("image",), "audio_only": ("audio",)}


def clip_param(clip: int, name: str) -> str:
    """The id of a clip's parameter among keyframes and constants."""
    return f"{clip}.{name}"


#: Edits of a table whose plans may pile up.
CUT_EVERY = 8


@dataclass(frozen=True)
class State:
    name: str
    rate: tuple[int, int]
    canvas: str
    tracks: DataFrame
    clips: DataFrame
    media: DataFrame
    markers: DataFrame
    transitions: DataFrame
    effects: DataFrame
    keyframes: DataFrame
    constants: DataFrame


class Project:
    def __init__(self, spark: SparkSession, name: str = "untitled", rate: tuple[int, int] = (24, 1), limit: int = 100, folder: str | None = None):
        """folder: one that driver and executors share; as a rule below spark.checkpoint.dir, in local mode below the
        temporary folder."""
        self.spark, self.limit = spark, limit
        given = folder or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not given and not spark.sparkContext.master.startswith("local"):
            raise ValueError("a project needs a folder that driver and executors share")
        self.folder = f"{given or 'file://' + tempfile.gettempdir()}/project-{uuid.uuid4().hex}"
        self._grown: dict[str, int] = {}
        self.versions = [State(name, rate, "auto", **{t: spark.createDataFrame([], s) for t, s in _TABLES.items()})]
        self.at, self.saved, self._open, self._ids = 0, 0, None, 0

    # versions

    @property
    def state(self) -> State:
        return self._open if self._open is not None else self.versions[self.at]

    @property
    def dirty(self) -> bool:
        return self.state is not self.versions[self.saved] if self.saved < len(self.versions) else True

    def _cut(self, table: str, df: DataFrame) -> DataFrame:
        """df, or what was read again of it once enough edits have piled up."""
        self._grown[table] = self._grown.get(table, 0) + 1
        if self._grown[table] < CUT_EVERY:
            return df
        self._grown[table] = 0
        path = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _put(self, **changes) -> None:
        changes = {k: self._cut(k, v) if k in _TABLES and v is not getattr(self.state, k) else v for k, v in changes.items()}
        new = replace(self.state, **changes)
        if self._open is not None:
            self._open = new
        else:
            self.versions = [*self.versions[: self.at + 1], new][-(self.limit + 1) :]
            self.at = len(self.versions) - 1

    @contextmanager
    def group(self) -> Iterator[None]:
        if self._open is not None:  # a part of the group around it
            yield
            return
        self._open = self.state
        try:
            yield
        except BaseException:
            self._open = None
            raise
        new, self._open = self._open, None
        if new is not self.state:
            self._put(**{k: getattr(new, k) for k in State.__dataclass_fields__})

    def undo(self) -> bool:
        moved = self.at > 0
        self.at -= moved
        return moved

    def redo(self) -> bool:
        moved = self.at + 1 < len(self.versions)
        self.at += moved
        return moved

    def new_id(self) -> int:
        self._ids += 1
        return self._ids

    # rows

    def _row(self, table: str, values: dict) -> DataFrame:
        schema = getattr(self.state, table).schema
        return self.spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)

    def _clip(self, clip: int) -> dict:
        found = self.state.clips.where(F.col("clip_id") == clip).limit(1).collect()
        if not found:
            raise EditError(f"no clip {clip}")
        return found[0].asDict()

    def _update(self, table: str, key: str, ident, **values) -> None:
        current = getattr(self.state, table)
        unknown = set(values) - set(current.columns)
        if unknown:
            raise EditError(f"no such columns: {sorted(unknown)}")
        hit = F.col(key) == ident
        kinds = {f.name: f.dataType for f in current.schema}
        lit = lambda v: v if not isinstance(v, (list, dict)) else F.from_json(F.lit(json.dumps(v)), "array<bigint>" if isinstance(v, list) else "map<string,string>")
        self._put(**{table: current.select(*(F.when(hit, lit(values[c]) if isinstance(values[c], (list, dict)) else F.lit(values[c])).otherwise(F.col(c)).cast(kinds[c]).alias(c) if c in values else F.col(c) for c in current.columns))})

    def _with_clips(self, clips: DataFrame, **more) -> None:
        """Structural edits drop transitions whose clips no longer touch."""
        self._put(clips=clips, transitions=edits.prune_transitions(self.state.transitions, clips), **more)

    # media and tracks

    def import_media(self, path: str, width: int, height: int, rate: tuple[int, int], duration: int, has_audio: bool = True, is_image: bool = False) -> int:
        """A path that is known gives its medium again."""
        known = self.state.media.where(F.col("path") == path).select("media_id").first()
        if known:
            return known[0]
        ident = self.new_id()
        self._put(media=self.state.media.unionByName(self._row("media", {"media_id": ident, "path": path, "width": width, "height": height, "rate_num": rate[0], "rate_den": rate[1], "duration_ticks": duration, "has_audio": has_audio, "is_image": is_image})))
        return ident

    def remove_media(self, media: int) -> None:
        if self.state.clips.where(F.col("media_id") == media).limit(1).count():
            raise EditError("the medium is in use")
        self._put(media=self.state.media.where(F.col("media_id") != media))

    def add_track(self, kind: str, name: str = "", at: int | None = None) -> int:
        if kind not in timeline.ACCEPTS:
            raise EditError(f"no such kind: {kind}")
        ident, n = self.new_id(), self.state.tracks.count()
        new = self.state.tracks.unionByName(self._row("tracks", {"track_id": ident, "order_idx": n, "kind": kind, "name": name or kind, "enabled": True, "muted": False, "locked": False, "duck_source": False}))
        self._put(tracks=edits.move_track(new, ident, n if at is None else at))
        return ident

    def remove_track(self, track: int) -> None:
        tracks, clips = edits.remove_track(self.state.tracks, self.state.clips, track)
        self._with_clips(clips, tracks=tracks)

    def move_track(self, track: int, to: int) -> None:
        self._put(tracks=edits.move_track(self.state.tracks, track, to))

    def set_track(self, track: int, **flags) -> None:
        """name, enabled, muted, locked or duck_source."""
        self._update("tracks", "track_id", track, **flags)

    # clips

    def add_clip(self, track: int, media: int, src_start: int, src_dur: int, start: int) -> int:
        ident = self.new_id()
        asked = self.spark.createDataFrame([(ident, track, media, src_start, src_dur, start)], "clip_id long, track_id long, media_id long, src_start long, src_dur long, start_tick long")
        placed = edits.place_media(asked, self.state.media, self.state.rate).first()
        if placed["reason"]:
            raise EditError(placed["reason"])
        new = self._row("clips", {"clip_id": ident, "track_id": track, "start_tick": start, "dur_tick": placed["dur_tick"], "media_id": media, "src_start": src_start, "src_dur": src_dur, "num": 1, "den": 1, "reversed": False, "volume": 1.0, "pan": 0.0, "fade_in": 0, "fade_out": 0, "beats": [], "look": {}})
        self._with_clips(edits.add(self.state.clips, new))
        return ident

    def add_generated(self, track: int, content: str, start: int, dur: int) -> int:
        kind = self.state.tracks.where(F.col("track_id") == track).select("kind").first()
        if kind is None or content not in timeline.ACCEPTS[kind[0]]:
            raise EditError("the track doesn't take such content")
        if dur < 1:
            raise EditError("empty range")
        ident = self.new_id()
        self._with_clips(edits.add(self.state.clips, self._row("clips", {"clip_id": ident, "track_id": track, "start_tick": start, "dur_tick": dur, "num": 1, "den": 1, "reversed": False, "volume": 1.0, "pan": 0.0, "fade_in": 0, "fade_out": 0, "beats": [], "look": {"content": content}})))
        return ident

    def duplicate_clip(self, clip: int, track: int, start: int) -> int:
        self._clip(clip)
        ident = self.new_id()
        self._with_clips(edits.duplicate(self.state.clips, clip, track, start, ident))
        return ident

    def split_clip(self, clip: int, at: int) -> int:
        own = self._clip(clip)
        if not own["start_tick"] < at < own["start_tick"] + own["dur_tick"]:
            raise EditError("the cut lies outside the clip")
        ident = self.new_id()
        out = timeline.split(self.state.clips, self.spark.createDataFrame([(clip, at)], "clip_id long, cut long"), ident)
        if own["src_dur"] is not None:
            head = (at - own["start_tick"]) * own["num"] // own["den"]
            left, right = (0, head), (head, own["src_dur"] - head)
            if own["reversed"]:
                left, right = (own["src_dur"] - head, head), (0, own["src_dur"] - head)
            part = lambda i: F.when(F.col("clip_id") == clip, left[i]).when(F.col("clip_id") == ident, right[i])
            out = out.withColumn("src_start", F.when(F.col("clip_id").isin(clip, ident), F.col("src_start") + part(0)).otherwise(F.col("src_start"))).withColumn("src_dur", F.coalesce(part(1).cast("long"), "src_dur"))
        self._with_clips(out)
        return ident

    def trim_clip(self, clip: int, start: int, dur: int) -> None:
        self._clip(clip)
        asked = self.spark.createDataFrame([(clip, start, dur)], "clip_id long, new_start long, new_dur long")
        out = timeline.trim(self.state.clips, asked)
        now = out.where(F.col("clip_id") == clip).first()
        if (now["start_tick"], now["dur_tick"]) != (start, dur):
            raise EditError("the source doesn't reach")
        beyond = self.state.media.where((F.col("media_id") == now["media_id"]) & ~F.col("is_image") & (F.col("duration_ticks") < (now["src_start"] or 0) + (now["src_dur"] or 0)))
        if now["media_id"] is not None and beyond.limit(1).count():
            raise EditError("the medium is too short")
        self._with_clips(timeline.require_free(out))

    def move_clip(self, clip: int, track: int, start: int) -> None:
        self._clip(clip)
        self._with_clips(edits.move(self.state.clips, clip, track, start))

    def remove_clip(self, clip: int) -> None:
        self._clip(clip)
        self._with_clips(timeline.remove(self.state.clips, [clip]), effects=self.state.effects.where(F.col("clip_id") != clip))

    def ripple_delete(self, clip: int) -> None:
        self._clip(clip)
        self._with_clips(timeline.ripple_delete(self.state.clips, self.spark.createDataFrame([(clip,)], "clip_id long")))

    def shift_clips(self, track: int, start: int, delta: int) -> None:
        self._with_clips(timeline.shift(self.state.clips, track, start, delta))

    def ripple_insert(self, track: int, media: int, src_start: int, src_dur: int, start: int) -> int:
        with self.group():
            asked = self.spark.createDataFrame([(0, track, media, src_start, src_dur, start)], "clip_id long, track_id long, media_id long, src_start long, src_dur long, start_tick long")
            self.shift_clips(track, start, edits.place_media(asked, self.state.media, self.state.rate).first()["dur_tick"])
            return self.add_clip(track, media, src_start, src_dur, start)

    def set_clip_speed(self, clip: int, num: int, den: int, reverse: bool = False) -> None:
        own = self._clip(clip)
        if own["src_dur"] is None:
            raise EditError("speed needs a medium")
        asked = self.spark.createDataFrame([(clip, num, den)], "clip_id long, num long, den long")
        out = edits.retime(self.state.clips.drop("num", "den"), asked)
        got = out.where(F.col("clip_id") == clip).first()
        if got["reason"]:
            raise EditError(got["reason"])
        dur = got["dur_tick"]
        self._update("clips", "clip_id", clip, dur_tick=dur, num=num, den=den, reversed=reverse)

    def freeze_frame(self, clip: int, at: int, hold: int) -> int:
        ids = self.new_id(), self.new_id()
        self._with_clips(edits.freeze(self.state.clips, clip, at, hold, ids))
        return ids[1]

    def extract_audio(self, clip: int, track: int) -> int:
        """A companion on an audio track, linked with the clip."""
        own = self._clip(clip)
        with self.group():
            new = self.duplicate_clip(clip, track, own["start_tick"])
            self.link_clips([clip, new])
        return new

    def set_clip_audio(self, clip: int, volume: float = 1.0, pan: float = 0.0, fade_in: int = 0, fade_out: int = 0) -> None:
        if not 0 <= volume <= 10 or not -1 <= pan <= 1 or min(fade_in, fade_out) < 0 or max(fade_in, fade_out) > self._clip(clip)["dur_tick"]:
            raise EditError("volume, pan or fade out of bounds")
        self._update("clips", "clip_id", clip, volume=float(volume), pan=float(pan), fade_in=fade_in, fade_out=fade_out)

    def set_beats(self, clip: int, beats: list[int]) -> None:
        """Those inside the source, in order, each once."""
        own = self._clip(clip)
        a, n = own["src_start"] or 0, own["src_dur"] or own["dur_tick"]
        self._update("clips", "clip_id", clip, beats=sorted({b for b in beats if a <= b < a + n}))

    def clear_beats(self, clip: int) -> None:
        self.set_beats(clip, [])

    def set_look(self, clip: int, **look) -> None:
        """Mask, blend mode, filter, adjustments and the like, each a name and a JSON value; None takes one away. Names and bounds
        are those of ``look_rules``."""
        own = self._clip(clip)
        new = {k: json.dumps(v) for k, v in look.items() if v is not None}
        if new:
            wrong = look_rules.violations(self.spark.createDataFrame([(clip, new)], "clip_id long, look map<string,string>")).orderBy("name").first()
            if wrong:
                raise EditError(wrong["reason"] if wrong["name"] in look_rules.NAMES else f"no such look: {wrong['name']}")
        if own["media_id"] is None and {"preserve_pitch", "denoise", "chroma", "mask"} & set(new):
            raise EditError("only a medium has such a look")
        self._update("clips", "clip_id", clip, look={**{k: v for k, v in (own["look"] or {}).items() if k not in look}, **new})

    def _mark(self, clip: int, name: str, value) -> None:
        look = {k: v for k, v in (self._clip(clip)["look"] or {}).items() if k != name}
        self._update("clips", "clip_id", clip, look=look if value is None else {**look, name: json.dumps(value) if not isinstance(value, str) else value})

    def _kind_of_track(self, track: int) -> str:
        return self.state.tracks.where(F.col("track_id") == track).select("kind").first()[0]

    def set_generator(self, clip: int, content: str) -> None:
        """What a generated clip shows."""
        own = self._clip(clip)
        if own["media_id"] is not None or content not in timeline.ACCEPTS[self._kind_of_track(own["track_id"])]:
            raise EditError("the clip doesn't take such content")
        self._mark(clip, "content", content)

    def set_clip_media(self, clip: int, media: int, src_start: int, src_dur: int) -> None:
        """Another medium, or another part of it, in a clip's place."""
        own = self._clip(clip)
        asked = self.spark.createDataFrame([(clip, own["track_id"], media, src_start, src_dur, own["start_tick"])], "clip_id long, track_id long, media_id long, src_start long, src_dur long, start_tick long")
        wrong = edits.place_media(asked, self.state.media, self.state.rate).first()["reason"]
        if wrong or self._kind_of_track(own["track_id"]) not in ("video", "audio"):
            raise EditError(wrong or "the track takes no media")
        self._update("clips", "clip_id", clip, media_id=media, src_start=src_start, src_dur=src_dur)

    def set_replaceable(self, clip: int, order: int | None = None, accepts: str = "any") -> None:
        """Make a clip a slot of a template, filled in that order; None makes it an ordinary clip again."""
        own = self._clip(clip)
        if order is not None:
            if accepts not in SLOTS or own["media_id"] is None:
                raise EditError("a slot is a clip of a medium, and holds one of " + ", ".join(SLOTS))
            if self._kind_of_track(own["track_id"]) != ("audio" if accepts == "audio_only" else "video"):
                raise EditError("such a slot can't be on that track")
        self._mark(clip, "replaceable", None if order is None else {"order": order, "accepts": accepts})

    def set_text_editable(self, clip: int, editable: bool = True) -> None:
        if (self._clip(clip)["look"] or {}).get("content") != "text":
            raise EditError("only a text can be reworded")
        self._mark(clip, "text_editable", True if editable else None)

    def link_clips(self, clips: list[int]) -> int:
        group = self.new_id()
        self._put(clips=timeline.link(self.state.clips, self.spark.createDataFrame([(c,) for c in clips], "clip_id long"), group))
        return group

    def unlink_clips(self, clips: list[int]) -> None:
        self._put(clips=timeline.unlink(self.state.clips, self.spark.createDataFrame([(c,) for c in clips], "clip_id long")))

    # transitions, effects, parameters, markers

    def add_transition(self, left: int, right: int, name: str = "crossfade", duration: int = 24) -> None:
        new = self._row("transitions", {"left_id": left, "right_id": right, "name": name, "duration": duration})
        out = edits.upsert_transitions(self.state.transitions, self.state.clips, new)
        if not out.where((F.col("left_id") == left) & (F.col("right_id") == right) & (F.col("name") == name)).count():
            raise EditError("the clips don't touch")
        self._put(transitions=out)

    def set_transition(self, left: int, right: int, duration: int) -> None:
        here = (F.col("left_id") == left) & (F.col("right_id") == right)
        if duration < 1 or not self.state.transitions.where(here).limit(1).count():
            raise EditError("no such transition, or too short")
        self._put(transitions=self.state.transitions.withColumn("duration", F.when(here, F.lit(duration).cast("long")).otherwise(F.col("duration"))))

    def remove_transition(self, left: int, right: int) -> None:
        self._put(transitions=self.state.transitions.where(~((F.col("left_id") == left) & (F.col("right_id") == right))))

    def add_effect(self, clip: int, effect: str, **params: float) -> None:
        self._clip(clip)
        n = self.state.effects.where(F.col("clip_id") == clip).count()
        self._put(effects=self.state.effects.unionByName(self._row("effects", {"clip_id": clip, "position": n, "effect": effect, "params": {k: float(v) for k, v in params.items()}})))

    def remove_effect(self, clip: int, at: int) -> None:
        self._put(effects=edits.remove_effect(self.state.effects, self.spark.createDataFrame([(clip, at)], "clip_id long, at int")))

    def move_effect(self, clip: int, a: int, b: int) -> None:
        self._put(effects=edits.move_effect(self.state.effects, self.spark.createDataFrame([(clip, a, b)], "clip_id long, a int, b int")))

    def set_effect_param(self, clip: int, at: int, name: str, value: float) -> None:
        """A parameter of the effect at a place of the clip's chain, within the catalog's bounds."""
        here = (F.col("clip_id") == clip) & (F.col("position") == at)
        own = self.state.effects.where(here).first()
        if own is None:
            raise EditError("no such effect")
        bounds = catalogs.EFFECTS.get(own["effect"], {}).get(name)
        if bounds is None or not bounds[1] <= value <= bounds[2]:
            raise EditError(f"{own['effect']} has no {name} of {value}")
        one = F.create_map(F.lit(name), F.lit(float(value)))
        self._put(effects=self.state.effects.withColumn("params", F.when(here, F.map_concat(F.map_filter("params", lambda k, _: k != name), one)).otherwise(F.col("params"))))

    def _keys(self, param: str):
        return self.state.keyframes.where(F.col("param_id") == param)

    def set_keyframe(self, param: str, tick: int, value: float, easing: str = "linear") -> None:
        self._put(keyframes=params.upsert(self.state.keyframes, self._row("keyframes", {"param_id": param, "tick": tick, "value": float(value), "easing": easing})))

    def remove_keyframe(self, param: str, tick: int) -> None:
        """A parameter that loses its last keyframe keeps that one's value."""
        left, lone = params.remove(self.state.keyframes, self.spark.createDataFrame([(param, tick)], "param_id string, tick long"))
        constants = self.state.constants.join(lone, "param_id", "left_anti").unionByName(lone)
        self._put(keyframes=left, constants=constants)

    def set_param_constant(self, param: str, value: float) -> None:
        """One value at all times, in place of any keyframes."""
        other = F.col("param_id") != param
        self._put(keyframes=self.state.keyframes.where(other), constants=self.state.constants.where(other).unionByName(self._row("constants", {"param_id": param, "value": float(value)})))

    def apply_easing_preset(self, param: str, tick: int, preset: str) -> None:
        """An easing from the keyframe at a tick to the one after it; one of several pieces puts its own keyframes between them."""
        pair = self._keys(param).where(F.col("tick") >= tick).orderBy("tick").limit(2).collect()
        if len(pair) < 2 or pair[0]["tick"] != tick:
            raise EditError("no keyframe there with one after it")
        a, b = pair
        if preset in easing.PIECES:
            ends = self.spark.createDataFrame([(param, a["tick"], b["tick"], a["value"], b["value"])], "param_id string, a long, b long, va double, vb double")
            new = params.expand_piecewise(ends, preset)
            # what follows the pair is eased as before
            new = new.withColumn("easing", F.when(F.col("tick") == b["tick"], F.lit(b["easing"])).otherwise(F.col("easing")))
        elif preset in easing.KINDS:
            new = self._row("keyframes", {**a.asDict(), "easing": preset})
        else:
            raise EditError(f"no such easing: {preset}")
        self._put(keyframes=params.upsert(self.state.keyframes, new.select("param_id", "tick", "value", "easing")))

    def set_clip_transform(self, clip: int, at: int | None = None, **values: float) -> None:
        """Placement: position_x, position_y, anchor_x, anchor_y, scale_x, scale_y, rotation and opacity. With a tick of the timeline,
        those that have keyframes get one there; all others, and all without a tick, become constant."""
        own = self._clip(clip)
        if set(values) - set(TRANSFORM):
            raise EditError(f"no such values: {sorted(set(values) - set(TRANSFORM))}")
        wrong = self.spark.range(1).select(look_rules.reason("transform", F.lit(json.dumps({k: float(v) for k, v in values.items()})))).first()[0]
        if wrong:
            raise EditError(wrong)
        names = {clip_param(clip, k): float(v) for k, v in values.items()}
        moving = set() if at is None else {r[0] for r in self.state.keyframes.where(F.col("param_id").isin(*names)).select("param_id").distinct().collect()}
        with self.group():
            for param, value in names.items():
                if param in moving:
                    self.set_keyframe(param, max(0, min(at - own["start_tick"], own["dur_tick"] - 1)), value)
                else:
                    self.set_param_constant(param, value)

    def sampled_transforms(self, at: DataFrame) -> DataFrame:
        """at (clip_id, t, a tick of the timeline) with each placement value at that time."""
        names = F.explode(F.array(*map(F.lit, TRANSFORM)))
        asks = at.select("clip_id", F.col("t").cast("long").alias("t")).distinct().join(self.state.clips.select("clip_id", "start_tick"), "clip_id").select("clip_id", "t", (F.col("t") - F.col("start_tick")).alias("local"), names.alias("name"))
        asks = asks.withColumn("param_id", F.concat_ws(".", F.col("clip_id").cast("string"), "name"))
        moving = params.sample(self.state.keyframes, asks, "local").withColumnRenamed("value", "_key")
        rows = moving.join(self.state.constants.withColumnRenamed("value", "_constant"), "param_id", "left")
        value = F.coalesce("_key", "_constant", *[F.when(F.col("name") == k, v) for k, v in TRANSFORM.items()])
        return rows.groupBy("clip_id", "t").pivot("name", list(TRANSFORM)).agg(F.first(value))

    def set_speed_curve(self, clip: int, curve: list[list] | None = None) -> None:
        """Speeds over a clip's source, as (tick from 0 to 1000, value, easing); None makes it even again. The clip's length
        follows from the curve's mean."""
        own = self._clip(clip)
        if own["src_dur"] is None:
            raise EditError("speed needs a medium")
        param = clip_param(clip, "speed")
        rows = [(param, int(t), float(v), str(e)) for t, v, e in curve or []]
        ticks = [r[1] for r in rows]
        if any(not 0 <= t <= params.CURVE_SCALE for t in ticks) or ticks != sorted(set(ticks)) or any(not SPEEDS[0] <= r[2] <= SPEEDS[1] for r in rows):
            raise EditError("ticks go up from 0 to 1000, speeds lie within " + " and ".join(map(str, SPEEDS)))
        keys = self.spark.createDataFrame(rows, KEYFRAMES)
        mean = params.curve_integral(keys, 1.0).first()["area"] if rows else None
        j = self.state.clips.where(F.col("clip_id") == clip).select("media_id", "src_dur", "num", "den").join(self.state.media, "media_id")
        source = timeexpr.resample(F.col("src_dur"), F.col("rate_num"), F.col("rate_den"), F.lit(self.state.rate[0]), F.lit(self.state.rate[1]))
        dur = j.select(timeexpr.retimed_duration(source, F.col("num"), F.col("den"), None if mean is None else F.lit(mean))).first()[0]
        with self.group():
            self._update("clips", "clip_id", clip, dur_tick=dur)
            timeline.require_free(self.state.clips)
            self._put(keyframes=self.state.keyframes.where(F.col("param_id") != param).unionByName(keys), transitions=edits.prune_transitions(self.state.transitions, self.state.clips))

    def add_marker(self, tick: int, name: str = "", color: str = "") -> int:
        ident = self.new_id()
        self._put(markers=edits.markers_upsert(self.state.markers, self._row("markers", {"id": ident, "tick": tick, "name": name, "color": color})))
        return ident

    def set_marker(self, marker: int, **values) -> None:
        self._update("markers", "id", marker, **values)

    def remove_marker(self, marker: int) -> None:
        self._put(markers=self.state.markers.where(F.col("id") != marker))

    def set_project(self, name: str | None = None, canvas: str | None = None) -> None:
        self._put(**{k: v for k, v in (("name", name), ("canvas", canvas)) if v is not None})

    def relink_media(self, media: int, path: str, width: int, height: int, rate: tuple[int, int], duration: int, has_audio: bool = True, is_image: bool = False) -> None:
        """Another file for a medium, in every version: undo doesn't bring the old one back."""
        if not self.state.media.where(F.col("media_id") == media).limit(1).count():
            raise EditError(f"no medium {media}")
        new = self._row("media", {"media_id": media, "path": path, "width": width, "height": height, "rate_num": rate[0], "rate_den": rate[1], "duration_ticks": duration, "has_audio": has_audio, "is_image": is_image})
        swap = lambda s: replace(s, media=s.media.where(F.col("media_id") != media).unionByName(new.join(s.media, "media_id", "left_semi")))
        self.versions = [swap(v) for v in self.versions]
        if self._open is not None:
            self._open = swap(self._open)

    # folders of projects and templates

    def save(self, path: str, kind: str = "project", **other: DataFrame) -> None:
        """All tables (or others in their places) as Parquet in a new folder below path, then a head file that names it, in one step: a reader finds the old
        project or the new one."""
        own, s = uuid.uuid4().hex, self.state
        for table in _TABLES:
            other.get(table, getattr(s, table)).write.parquet(f"{path}/{own}/{table}")
        head = {"schema": {"kind": kind, "version": documents.VERSION}, "name": s.name, "rate": s.rate, "canvas": s.canvas, "ids": self._ids, "folder": own}
        documents.save(self.spark.createDataFrame([(json.dumps(head),)], "value string"), f"{path}/head.json")
        if kind == "project":
            self.saved = self.at

    def load(self, path: str, kind: str = "project") -> None:
        """What was saved at path in place of this project, with no history. Other kinds and later versions are refused."""
        try:
            head = json.loads(self.spark.read.text(f"{path}/head.json", wholetext=True).first()[0])
            schema, folder = head["schema"], f"{path}/{head['folder']}"
        except Exception as bad:
            raise EditError(f"no project at {path}: {bad}") from bad
        if schema.get("kind") != kind or not 1 <= schema.get("version", 0) <= documents.VERSION:
            raise EditError(f"not a {kind} of a known version: {schema}")
        tables = {t: self.spark.read.schema(d).parquet(f"{folder}/{t}") for t, d in _TABLES.items()}
        self.versions = [State(head["name"], tuple(head["rate"]), head["canvas"], **tables)]
        self.at, self.saved, self._open, self._ids, self._grown = 0, 0, None, head["ids"], {}

    @classmethod
    def open(cls, spark: SparkSession, path: str, **how) -> Project:
        out = cls(spark, **how)
        out.load(path)
        return out

    def save_template(self, path: str) -> None:
        self.save(path, "template")

    def slots(self) -> DataFrame:
        """Clips to be filled, with slot_order and accepts, in the order of filling."""
        mark = F.from_json(F.col("look")["replaceable"], "order int, accepts string")
        return self.state.clips.withColumn("_m", mark).where("_m IS NOT NULL").withColumn("slot_order", F.col("_m.order")).withColumn("accepts", F.col("_m.accepts")).drop("_m").orderBy("slot_order", "clip_id")

    def editable_texts(self) -> DataFrame:
        return self.state.clips.where(F.col("look")["text_editable"] == "true").orderBy("start_tick", "clip_id")

    def apply_template(self, path: str, picks: list[dict]) -> None:
        """A template as this project, its slots for pictures filled in order. picks: media as for ``import_media``, with src_start if
        not from the start. Slots beyond the picks keep what they show; all marks stay."""
        self.load(path, "template")
        self.fill_slots(picks)

    def fill_slots(self, picks: list[dict]) -> None:
        slots = self.slots().where("accepts <> 'audio_only'").limit(len(picks) + 1).collect()
        if len(picks) > len(slots):
            raise EditError("more media than slots")
        with self.group():
            for slot, pick in zip(slots, picks, strict=False):
                pick = dict(pick)
                start = pick.pop("src_start", 0)
                kind = "image" if pick.get("is_image") else "audio" if pick["width"] == 0 else "video"
                if kind not in SLOTS[slot["accepts"]]:
                    raise EditError(f"the slot takes {slot['accepts']}, not {kind}")
                media = self.import_media(**pick)
                row = (slot["dur_tick"], slot["num"], slot["den"], slot["reversed"], *pick["rate"], pick["duration"], bool(pick.get("is_image")), start)
                ask = self.spark.createDataFrame([row], "dur_tick long, num long, den long, reversed boolean, rate_num int, rate_den int, most long, is_image boolean, src_start long")
                found = edits.slot_windows(ask, self.state.rate).first()
                if found["reason"]:
                    raise EditError(found["reason"])
                self.set_clip_media(slot["clip_id"], media, start, found["src_dur"])

    def duration(self) -> int:
        return self.state.clips.agg(F.max(F.col("start_tick") + F.col("dur_tick"))).first()[0] or 0

    # commands in JSON

    COMMANDS = ("import_media", "remove_media", "relink_media", "save", "load", "save_template", "apply_template", "fill_slots", "add_track", "remove_track", "move_track", "set_track", "add_clip", "add_generated", "set_generator", "set_clip_media", "duplicate_clip", "split_clip", "trim_clip", "move_clip", "remove_clip", "ripple_delete", "shift_clips", "ripple_insert", "set_clip_speed", "set_speed_curve", "freeze_frame", "extract_audio", "set_clip_audio", "set_beats", "clear_beats", "set_look", "set_replaceable", "set_text_editable", "link_clips", "unlink_clips", "add_transition", "set_transition", "remove_transition", "add_effect", "remove_effect", "move_effect", "set_effect_param", "set_keyframe", "remove_keyframe", "set_param_constant", "apply_easing_preset", "set_clip_transform", "add_marker", "set_marker", "remove_marker", "set_project")

    def apply(self, command: str):
        """One command as JSON: its name under ``type`` and its arguments."""
        given = json.loads(command)
        name = given.pop("type", None)
        if name not in self.COMMANDS:
            raise EditError(f"unknown command: {name}")
        try:
            return getattr(self, name)(**given)
        except TypeError as bad:
            raise EditError(str(bad)) from bad
