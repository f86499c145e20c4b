import json

import pytest

from kairoline.intents import Intents
from kairoline.operators.timeline import EditError
from kairoline.project import Project
from kairoline.tools import Registry, Tool, ToolError


@pytest.fixture
def intents(spark):
    p = Project(spark, rate=(10, 1))
    i = Intents(p)
    i.film, i.song = p.import_media("a.mp4", 64, 36, (10, 1), 40), p.import_media("a.mp3", 0, 0, (10, 1), 30)
    return i


def lanes(i):
    kinds = {r.track_id: r.kind for r in i.project.state.tracks.collect()}
    return sorted((kinds[r.track_id], r.clip_id, r.start_tick, r.dur_tick) for r in i.project.state.clips.collect())


def test_main_track(intents):
    i = intents
    a, s, b = i.append_main([i.film, i.song, i.film])
    assert lanes(i) == [("audio", s, 40, 30), ("video", a, 0, 40), ("video", b, 40, 40)]
    c = i.insert_main(i.film, 4.5)
    at = i.project.at
    i.ripple_trim_main(a, "leading", 1.0)
    assert i.project.at == at + 1 and lanes(i)[1:] == [("video", a, 0, 30), ("video", b, 70, 40), ("video", c, 30, 40)]
    assert i.project._clip(a)["src_start"] == 10
    i.ripple_trim_main(a, "leading", -0.5)
    i.ripple_trim_main(a, "trailing", -1.0)
    assert lanes(i)[1:] == [("video", a, 0, 25), ("video", b, 65, 40), ("video", c, 25, 40)] and i.project._clip(a)["src_start"] == 5
    i.insert_into_main(a, 2)
    assert lanes(i)[1:] == [("video", a, 80, 25), ("video", b, 40, 40), ("video", c, 0, 40)]
    i.set_transition(c, "wipe_left", 0.6)
    assert i.project.state.transitions.first().duration == 6
    i.set_transition(c, None)
    assert i.project.state.transitions.count() == 0
    before = lanes(i)
    for call in (lambda: i.ripple_trim_main(s, "leading", 1.0), lambda: i.set_transition(a, "crossfade"), lambda: i.ripple_trim_main(a, "trailing", 99.0), lambda: i.set_speed_preset(a, "nope")):
        with pytest.raises(EditError):
            call()
    assert lanes(i) == before
    d = i.duplicate(c)
    assert lanes(i)[1:] == [("video", a, 120, 25), ("video", b, 80, 40), ("video", c, 0, 40), ("video", d, 40, 40)]
    held = i.freeze(c, 2.0, 1.0)
    assert ("video", held, 20, 10) in lanes(i)


def test_lanes_and_overlays(intents):
    i = intents
    (a,) = i.append_main([i.film])
    t, u = i.add_text(1.0), i.add_text(2.0)
    assert i.project._clip(t)["track_id"] != i.project._clip(u)["track_id"]
    i.trim_lane(t, 6.0, 2.0)
    assert (i.project._clip(t)["start_tick"], i.project._clip(t)["dur_tick"]) == (60, 20)
    assert i.move_lane(t, 7.0) == i.project._clip(t)["track_id"]
    e, s = i.add_effect("filter", 0.0), i.add_sticker(0.0, 1.0)
    pip, song = i.add_pip(i.film, 1.0), i.add_audio(i.song, 0.0, "music")
    assert json.loads(i.project._clip(song)["look"]["audio_role"]) == "music" and i.project._clip(pip)["track_id"] != i.main() and e != s
    now = i.project.sampled_transforms(i.project.spark.createDataFrame([(pip, 10)], "clip_id long, t long")).first()
    assert (now.position_y, now.scale_x) == (-0.18, 0.5)
    companion = i.extract_audio(a)
    assert i.project._clip(companion)["link"] == i.project._clip(a)["link"] is not None
    b = i.split(a, 1.5)
    i.replace_media(b, i.film)
    assert i.project._clip(b)["src_start"] == 0
    i.set_audio(b, 0.5, 0.2)
    i.set_speed(b, 1.25)
    assert [i.project._clip(b)[c] for c in ("volume", "fade_in", "num", "den", "dur_tick")] == [0.5, 2, 5, 4, 20]
    i.set_speed(b, 1.0)
    i.set_speed_preset(b, "ramp_down")
    i.set_speed_preset(b, None)
    assert i.project._clip(b)["dur_tick"] == 25
    i.set_transform(b, 0.75, 0.5, 2.0, 90.0, 1.0)
    assert i.toggle_transform_keyframe(b, 2.0)
    i.set_transform(b, 0.5, 0.5, 1.0, 0.0, 1.0, at=3.0)
    assert i.project._keys(f"{b}.position_x").count() == 2
    assert not i.toggle_transform_keyframe(b, 2.0) and i.project._keys(f"{b}.position_x").count() == 1
    lifted = i.move_lane(a, 9.0)
    assert lifted != i.main() and i.project._clip(b)["start_tick"] == 0


def test_registry(intents):
    p, asked = intents.project, []
    r = Registry(confirm=lambda name, args: asked.append(name) or args.get("really", False))
    r.add_edits(p)
    r.add(Tool("project_count", "Count clips.", lambda: p.state.clips.count(), "read_only"))
    r.add(Tool("system_clear", "Clear.", lambda really=False: "done", "system", {"type": "object", "properties": {"really": {"type": "boolean"}}, "required": []}))
    track = r.call("add_track", '{"kind": "video"}')
    clip = r.call("add_clip", {"track": track, "media": intents.film, "src_start": 0, "src_dur": 5, "start": 0})
    assert r.call("project_count", "{}") == 1 and r.call("system_clear", {"really": True}) == "done" and asked == ["system_clear"]
    for name, args, words in (
        ("no_such", "{}", "unknown tool"),
        ("split_clip", "{", "broken JSON"),
        ("split_clip", "[]", "object"),
        ("split_clip", {"clip": clip}, "missing argument: at"),
        ("split_clip", {"clip": clip, "at": "2"}, "type integer"),
        ("split_clip", {"clip": clip, "at": True}, "type integer"),
        ("split_clip", {"clip": clip, "at": 2, "by": 3}, "unknown argument"),
        ("split_clip", {"clip": clip, "at": 9}, "rejected"),
        ("system_clear", "{}", "confirmed"),
    ):
        with pytest.raises(ToolError, match=words):
            r.call(name, args)
    for bad in (Tool("count", "", len), Tool("app_Bad", "", len), Tool("project_count", "", len), Tool("app_x", "", len, "root")):
        with pytest.raises(ToolError):
            r.add(bad)
    rows = {x.name: json.loads(x.parameters) for x in r.table(p.spark).collect()}
    assert rows["split_clip"]["required"] == ["clip", "at"] and rows["set_look"]["additionalProperties"]
