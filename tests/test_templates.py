import pytest

from kairoline.operators.timeline import EditError
from kairoline.project import Project, clip_param
from kairoline.sources import bundle


@pytest.fixture
def project(spark):
    p = Project(spark, rate=(24, 1))
    p.media = p.import_media("a.mp4", 1920, 1080, (24, 1), 500)
    p.video, p.text = p.add_track("video"), p.add_track("text")
    p.first, p.second = p.add_clip(p.video, p.media, 0, 48, 0), p.add_clip(p.video, p.media, 100, 24, 48)
    return p


def test_contents_and_marks(project):
    p = project
    title = p.add_generated(p.text, "text", 0, 24)
    p.set_text_editable(title)
    p.set_replaceable(p.second, 0, "image_only")
    p.set_replaceable(p.first, 1)
    assert [r.clip_id for r in p.slots().collect()] == [p.second, p.first] and [r.clip_id for r in p.editable_texts().collect()] == [title]
    p.set_clip_media(p.first, p.media, 200, 48)
    assert p._clip(p.first)["src_start"] == 200
    for call in (
        lambda: p.set_generator(p.first, "solid"),
        lambda: p.set_generator(title, "sticker"),
        lambda: p.set_text_editable(p.first),
        lambda: p.set_replaceable(title, 0),
        lambda: p.set_replaceable(p.first, 0, "audio_only"),
        lambda: p.set_clip_media(p.first, p.media, 490, 48),
        lambda: p.set_look(p.first, crop={"x": 0.5, "y": 0, "w": 0.6, "h": 1}),
        lambda: p.set_look(p.first, glitter=1),
        lambda: p.set_look(title, chroma={"strength": 0.5}),
    ):
        with pytest.raises(EditError):
            call()
    p.set_replaceable(p.first)
    p.set_look(p.first, blend="screen", crop={"x": 0.25, "y": 0, "w": 0.5, "h": 1})
    p.set_look(p.first, blend=None)
    assert set(p._clip(p.first)["look"]) == {"crop"} and p.slots().count() == 1


def test_parameters(project):
    p = project
    x = clip_param(p.first, "position_x")
    p.set_clip_transform(p.first, position_x=0.25, opacity=0.5)
    p.set_keyframe(x, 0, 0.0)
    p.set_keyframe(x, 40, 1.0)
    p.set_clip_transform(p.first, at=20, position_x=0.9, opacity=0.75)
    assert [(r.tick, r.value) for r in p._keys(x).orderBy("tick").collect()] == [(0, 0.0), (20, 0.9), (40, 1.0)]
    at = p.spark.createDataFrame([(p.first, 10), (p.second, 50)], "clip_id long, t long")
    got = {r.clip_id: (round(r.position_x, 6), r.opacity, r.scale_x) for r in p.sampled_transforms(at).collect()}
    assert got == {p.first: (0.45, 0.75, 1.0), p.second: (0.0, 1.0, 1.0)}
    p.apply_easing_preset(x, 0, "hold")
    p.apply_easing_preset(x, 20, "back_out")
    assert [(r.tick, round(r.value, 6), r.easing) for r in p._keys(x).orderBy("tick").collect()] == [(0, 0.0, "hold"), (20, 0.9, "ease_out"), (32, 1.01, "ease_in_out"), (40, 1.0, "linear")]
    p.set_param_constant(x, 0.1)
    assert p._keys(x).count() == 0
    p.set_keyframe("lone", 5, 7.0)
    p.remove_keyframe("lone", 5)
    assert p.state.constants.where("param_id = 'lone'").first().value == 7.0
    for call in (lambda: p.set_clip_transform(p.first, scale_x=0), lambda: p.set_clip_transform(p.first, zoom=2), lambda: p.apply_easing_preset(x, 0, "hold"), lambda: p.apply_easing_preset(x, 3, "nope")):
        with pytest.raises(EditError):
            call()


def test_speed_curves_effects_transitions(project):
    p = project
    p.set_speed_curve(p.second, [(0, 2.0, "linear"), (1000, 2.0, "linear")])
    assert p._clip(p.second)["dur_tick"] == 12
    before = p.at
    for curve in ([(0, 0.5, "linear"), (0, 1.0, "linear")], [(0, 0.01, "linear")], [(-1, 1.0, "linear")]):
        with pytest.raises(EditError):
            p.set_speed_curve(p.second, curve)
    with pytest.raises(EditError):  # the second clip is in the way
        p.set_speed_curve(p.first, [(0, 0.5, "linear"), (1000, 0.5, "linear")])
    assert p.at == before and p._clip(p.first)["dur_tick"] == 48
    p.set_speed_curve(p.second)
    assert p._clip(p.second)["dur_tick"] == 24 and p._keys(clip_param(p.second, "speed")).count() == 0
    p.add_effect(p.first, "vignette", amount=0.5)
    p.set_effect_param(p.first, 0, "amount", 0.25)
    assert p.state.effects.first().params == {"amount": 0.25}
    p.add_transition(p.first, p.second, duration=10)
    p.set_transition(p.first, p.second, 6)
    assert p.state.transitions.first().duration == 6
    for call in (lambda: p.set_effect_param(p.first, 0, "amount", 2), lambda: p.set_effect_param(p.first, 1, "amount", 0.1), lambda: p.set_transition(p.first, p.second, 0), lambda: p.set_transition(p.second, p.first, 5)):
        with pytest.raises(EditError):
            call()
    p.relink_media(p.media, "b.mp4", 640, 360, (24, 1), 500)
    p.undo()
    assert [r.path for r in p.state.media.collect()] == ["b.mp4"]


def test_folders_and_templates(project, tmp_path):
    p = project
    p.set_replaceable(p.first, 0)
    p.set_replaceable(p.second, 1, "image_only")
    p.save(str(tmp_path / "p"))
    assert not p.dirty
    again = Project.open(p.spark, str(tmp_path / "p"))
    assert again.state.name == p.state.name and again.state.clips.orderBy("clip_id").collect() == p.state.clips.orderBy("clip_id").collect() and again.new_id() > p.second
    p.save_template(str(tmp_path / "t"))
    with pytest.raises(EditError):
        again.load(str(tmp_path / "t"))
    with pytest.raises(EditError):
        again.load(str(tmp_path / "none"))
    new = Project(p.spark)
    movie = {"path": "new.mp4", "width": 100, "height": 50, "rate": (30, 1), "duration": 600}
    still = {"path": "new.png", "width": 100, "height": 50, "rate": (24, 1), "duration": 1, "is_image": True}
    new.apply_template(str(tmp_path / "t"), [{**movie, "src_start": 30}, still])
    got = {r.clip_id: (r.start_tick, r.dur_tick, r.src_start, r.src_dur) for r in new.state.clips.collect()}
    assert got == {p.first: (0, 48, 30, 60), p.second: (48, 24, 0, 24)} and new.slots().count() == 2
    for picks in ([movie, movie], [movie, still, still], [{**movie, "duration": 40}]):
        before = new.at
        with pytest.raises(EditError):
            new.fill_slots(picks)
        assert new.at == before


def test_bundles(project, tmp_path):
    p = project
    with pytest.raises(bundle.BundleError):
        bundle.write(p, str(tmp_path / "bad"))
    (tmp_path / "a.MP4").write_bytes(b"film")
    p.relink_media(p.media, str(tmp_path / "a.MP4"), 1920, 1080, (24, 1), 500)
    p.set_project(name="trip")
    bundle.write(p, str(tmp_path / "b"))
    assert bundle.manifest(p.spark, str(tmp_path / "b"))["name"] == "trip"
    new = Project(p.spark)
    bundle.install(new, str(tmp_path / "b"), str(tmp_path / "here"))
    path = new.state.media.first().path
    assert path == f"{tmp_path}/here/media/0.mp4" and open(path, "rb").read() == b"film" and new.state.clips.count() == 2
    p.relink_media(p.media, "../up.mp4", 1920, 1080, (24, 1), 500)
    p.save(str(tmp_path / "b" / "template"), "template")
    with pytest.raises(bundle.BundleError):
        bundle.install(new, str(tmp_path / "b"), str(tmp_path / "there"))
    with pytest.raises(bundle.BundleError):
        bundle.manifest(p.spark, str(tmp_path))
