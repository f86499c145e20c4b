import pytest

from kairoline.operators.timeline import EditError
from kairoline.project import Project


@pytest.fixture
def project(spark):
    p = Project(spark, rate=(24, 1))
    p.media = p.import_media("a.mp4", 1920, 1080, (24, 1), 500)
    p.video, p.audio = p.add_track("video"), p.add_track("audio")
    return p


def spans(p):
    return sorted((r.clip_id, r.start_tick, r.dur_tick, r.src_start, r.src_dur) for r in p.state.clips.collect())


def test_edit_undo_redo(project):
    p = project
    assert p.import_media("a.mp4", 1, 1, (1, 1), 1) == p.media
    assert [r.kind for r in p.state.tracks.orderBy("order_idx").collect()] == ["audio", "video"]
    a = p.add_clip(p.video, p.media, 0, 100, 0)
    b = p.split_clip(a, 40)
    assert spans(p) == [(a, 0, 40, 0, 40), (b, 40, 60, 40, 60)]
    p.add_transition(a, b, duration=10)
    p.ripple_delete(a)
    assert spans(p) == [(b, 0, 60, 40, 60)] and p.state.transitions.count() == 0
    assert p.undo() and p.state.transitions.count() == 1 and p.undo() and p.undo() and spans(p) == [(a, 0, 100, 0, 100)]
    assert p.redo() and len(spans(p)) == 2


def test_forbidden_edits_change_nothing(project):
    p = project
    a = p.add_clip(p.video, p.media, 0, 100, 0)
    before = p.at
    for call in (
        lambda: p.add_clip(p.video, p.media, 0, 10, 50),
        lambda: p.add_clip(p.video, p.media, 450, 100, 200),
        lambda: p.split_clip(a, 0),
        lambda: p.trim_clip(a, 0, 0),
        lambda: p.remove_media(p.media),
        lambda: p.set_clip_audio(a, volume=11),
        lambda: p.add_generated(p.audio, "text", 0, 5),
        lambda: p.add_transition(a, a),
        lambda: p.apply('{"type": "no_such"}'),
        lambda: p.apply('{"type": "split_clip", "clip": 1}'),
        lambda: p.ripple_insert(p.video, p.media, 0, 10, 50),
        lambda: p.set_clip_speed(a, 0, 1),
    ):
        with pytest.raises(EditError):
            call()
        assert p.at == before and p._open is None


def test_groups_links_and_looks(project):
    p = project
    a = p.add_clip(p.video, p.media, 10, 100, 0)
    before = p.at
    companion = p.extract_audio(a, p.audio)
    assert p.at == before + 1 and {r.link for r in p.state.clips.collect()} != {None}
    p.unlink_clips([companion])
    assert {r.link for r in p.state.clips.collect()} == {None}
    p.set_beats(a, [5, 60, 20, 20, 200])
    p.set_look(a, blend="screen", mask={"kind": "circle"})
    p.set_clip_speed(a, 2, 1, reverse=True)
    row = p._clip(a)
    assert row["beats"] == [20, 60] and row["look"] == {"blend": '"screen"', "mask": '{"kind": "circle"}'} and (row["dur_tick"], row["reversed"]) == (50, True)
    held = p.freeze_frame(a, 20, 7)
    assert sorted((r.start_tick, r.dur_tick) for r in p.state.clips.where(f"track_id = {p.video}").collect()) == [(0, 20), (20, 7), (27, 30)] and held
    p.move_clip(companion, p.audio, 300)
    assert p.duration() == 400


def test_commands_effects_markers_keyframes(project):
    p = project
    a = p.apply('{"type": "add_clip", "track": %d, "media": %d, "src_start": 0, "src_dur": 50, "start": 5}' % (p.video, p.media))
    for name in ("vignette", "pixelate", "duotone"):
        p.add_effect(a, name, amount=0.5)
    p.move_effect(a, 0, 2)
    p.remove_effect(a, 0)
    assert [r.effect for r in p.state.effects.orderBy("position").collect()] == ["duotone", "vignette"]
    late, early = p.add_marker(9, "late"), p.add_marker(3, "early")
    p.set_marker(late, tick=1)
    p.remove_marker(early)
    assert [(r.tick, r.name) for r in p.state.markers.collect()] == [(1, "late")]
    p.set_keyframe("x", 0, 1.0)
    p.set_keyframe("x", 0, 2.0, "hold")
    p.set_keyframe("x", 9, 3.0)
    p.remove_keyframe("x", 9)
    assert [(r.tick, r.value, r.easing) for r in p.state.keyframes.collect()] == [(0, 2.0, "hold")]
    p.set_track(p.video, muted=True, name="V")
    assert p.state.tracks.where("muted").first().name == "V"
    p.set_project(name="film", canvas="16:9")
    p.remove_track(p.video)
    assert p.state.clips.count() == 0 and p.state.name == "film" and p.dirty


def test_plans_stay_small(project):
    p = project
    a = p.add_clip(p.video, p.media, 0, 100, 0)
    sizes = []
    for k in range(20):
        p.move_clip(a, p.video, k)
        sizes.append(len(p.state.clips._jdf.queryExecution().logical().toString()))
    assert max(sizes[10:]) <= 2 * max(sizes[:10]) and spans(p) == [(a, 19, 100, 0, 100)]
    assert p.undo() and spans(p) == [(a, 18, 100, 0, 100)]
