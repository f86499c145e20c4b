import struct
import zlib

import pytest

from kairoline.operators import transcript as T
from kairoline.plans import fixtures
from kairoline.sources import media, project

DOC = """{"schema": {"kind": "project", "version": 2}, "name": "p", "tracks": [
  {"id": 1, "kind": "video", "name": "V", "clips": [{"id": 7, "start": 5, "duration": 9, "media": 3, "src_start": 0, "link": null}]},
  {"id": 2, "kind": "audio", "name": "A", "muted": true, "clips": []}], "markers": [{"id": 2, "tick": 9, "name": "b", "color": "red"}, {"id": 1, "tick": 4, "name": "a", "color": "red"}]}"""


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I4s", 8 + len(data), kind) + data


def test_project_round_trip(spark, tmp_path):
    (tmp_path / "a.json").write_text(DOC)
    (tmp_path / "b.json").write_text('{"project": ' + DOC + "}")
    p = project.read(spark, f"{tmp_path}/*.json").cache()
    assert project.tracks(p).count() == 4 and project.clips(p).count() == 2
    assert [r.tick for r in project.markers(p).collect()] == [4, 9, 4, 9]
    one = p.limit(1)
    doc = project.document("p", project.tracks(one).drop("path"), project.clips(one).drop("path"), project.markers(one).drop("path"))
    (tmp_path / "out.json").write_text("an older save")
    for _ in range(2):  # a save takes the place of the one before
        project.save(doc, f"{tmp_path}/out.json")
    assert sorted(f.name for f in tmp_path.iterdir() if f.name.startswith("out")) == ["out.json"]
    again = project.read(spark, f"{tmp_path}/out.json")
    assert project.clips(again).drop("path").collect() == project.clips(one).drop("path").collect()
    assert project.tracks(again).drop("path").collect() == project.tracks(one).drop("path").collect()


@pytest.mark.parametrize("text", ['{"schema": 9, "tracks": []}', '{"tracks": []}', '{"schema": 1, "tracks": 3}'])
def test_unknown_or_broken_projects_are_refused(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match="(?i)schema|malformed|parse"):
        project.read(spark, f"{tmp_path}/a.json").collect()


def test_mp4_durations(spark, tmp_path):
    header = lambda kind, scale, length: box(kind, struct.pack(">IIIII", 0, 0, 0, scale, length))
    (tmp_path / "plain.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"moov", header(b"mvhd", 1000, 2500)))
    track = box(b"trak", box(b"tkhd", struct.pack(">IIIII", 0, 0, 0, 1, 0)), box(b"mdia", header(b"mdhd", 100, 0)))
    trex = box(b"mvex", box(b"trex", struct.pack(">IIIIII", 0, 1, 1, 10, 0, 0)))
    runs = box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">III", 8, 1, 20)), box(b"trun", struct.pack(">II", 0, 5))))
    runs += box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0, 1)), box(b"trun", struct.pack(">IIII", 0x100, 2, 30, 40))))
    runs += box(b"moof", box(b"traf", box(b"tfhd", struct.pack(">II", 0, 1)), box(b"trun", struct.pack(">II", 0, 3))))
    (tmp_path / "parts.mp4").write_bytes(box(b"moov", header(b"mvhd", 1000, 0), track, trex) + runs)
    (tmp_path / "junk.mp4").write_bytes(b"\0\0\0\1moov")
    found = media.files(spark, str(tmp_path), "*.mp4")
    got = {r.path.rsplit("/", 1)[1]: r.seconds for r in media.mp4_durations(found).collect()}
    assert got == {"plain.mp4": 2.5, "parts.mp4": 2.0, "junk.mp4": None}
    assert media.disk_usage(found).first().files == 3 and media.content_keys(found).where("length(content_key) = 64").count() == 3


def test_cube(spark, tmp_path):
    (tmp_path / "ok.cube").write_text("TITLE x\nLUT_3D_SIZE 2\n" + "\n".join(f"{i} 0.5 1.0" for i in range(8)) + "\n")
    got = media.cube_rows(spark, f"{tmp_path}/ok.cube").orderBy("i").collect()
    assert [(r.i, r.r, r.g, r.b) for r in got] == [(i, float(i), 0.5, 1.0) for i in range(8)]
    (tmp_path / "bad.cube").write_text("LUT_3D_SIZE 2\n0 0 0\n")
    with pytest.raises(Exception, match="not a colour table"):
        media.cube_rows(spark, f"{tmp_path}/bad.cube").collect()


def test_png_frames(spark):
    p = fixtures.pixels(spark, "/root/testdata/sf0.001").where("media_id = 0 AND t < 2")
    got = media.png_frames(p).orderBy("name").collect()
    assert [r.name for r in got] == ["frame_00000.png", "frame_00001.png"]
    png = bytes(got[0].png)
    at = png.index(b"IDAT")
    rows = zlib.decompress(png[at + 4 : at + 4 + struct.unpack(">I", png[at - 4 : at])[0]])
    assert png.startswith(b"\x89PNG") and len(rows) == 8 * (1 + 8 * 4)


def test_transcript(spark):
    nan = float("nan")
    rows = [(0, "<|startoftranscript|>", 0, 0, 1.0), (1, " Hel", -5, 20, nan), (2, "lo", 10, 25, float("inf")), (3, " world", 15, 45, -2.0), (4, "!", 44, 60, 0.8), (5, "[EOT]", 50, 50, 1.0)]
    tokens = spark.createDataFrame([(1, 1, *r) for r in rows] + [(1, 2, 0, " Again", 35, 35, 0.5)], "conv_id int, segment int, pos int, text string, start_cs long, end_cs long, probability double")
    segments = T.clamp_segments(spark.createDataFrame([(1, 1, -10, 50), (1, 2, 40, 30)], "conv_id int, segment int, start_cs long, end_cs long"), "conv_id", "segment")
    assert [(r.start_cs, r.end_cs) for r in segments.orderBy("segment").collect()] == [(0, 50), (50, 50)]
    got = T.words(tokens, segments).orderBy("segment", "word").collect()
    assert [(r.text, r.start_cs, r.end_cs, round(r.probability, 6)) for r in got] == [("Hello", 0, 25, 0.5), ("world!", 25, 50, 0.4), ("Again", 50, 50, 0.5)]


def test_words_are_made_of_lists(spark):
    """F16, F17, F18: many segments, odd tokens among them, in one batch: what a loop over a segment's tokens gives, and no token is sorted."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    odd = [" ", "", "<|x|>", " <|a\nb|>", "[EOT]", "　wide", " \t", "  nb", "\u000bv", "x", " y", "z ", " <|a|>b"]
    rows = [(c, s, p, rng.choice(odd), *rng.choice([(a, a + 9), (a, a - 30), (-5, 3), (None, 4)]), rng.choice([0.3, 0.7, 2.0, -1.0, None, float("nan")])) for c in range(3) for s in range(8) for p in range(rng.randrange(25)) for a in [p * 10]]
    tokens = spark.createDataFrame(rows, "conv_id int, segment int, pos int, text string, start_cs long, end_cs long, probability double")
    bounds = spark.createDataFrame([(c, s, 10 * s, 10 * s + 150) for c in range(3) for s in range(8)], "conv_id int, segment int, start_cs long, end_cs long")
    blank = " \t\n\u000b\f\r 　"
    want = []
    for c in range(3):
        for s in range(8):
            groups, low, high, n = [], 10 * s, 10 * s + 150, 0
            for _, _, _, text, a, b, p in sorted((r for r in rows if r[:2] == (c, s)), key=lambda r: r[2]):
                t = text.strip(" ")
                if not t or a is None or t.startswith("<|") and t.endswith("|>") or t == "[EOT]":
                    continue
                if text[0] in blank or not groups:
                    groups.append([])
                p = 1.0 if p is None else 0.0 if p != p else max(0.0, min(1.0, p))
                groups[-1].append((text.lstrip(" ") if text[0] in blank else text, max(a, 0), max(b, a, 0), p))
            reached = low
            for g in groups:
                text = " ".join("".join(x[0] for x in g).translate({ord(x): " " for x in blank}).split())
                if text:
                    n += 1
                    first, last = max(low, min(min(x[1] for x in g), high)), min(max(x[2] for x in g), high)
                    start = max(first, reached)
                    want.append((c, s, n, text, start, max(last, start), round(sum(x[3] for x in g) / len(g), 9)))
                    reached = max(reached, first, last)
    got = [(*r[:6], round(r[6], 9)) for r in T.words(tokens, bounds).collect()]
    assert sorted(got) == sorted(want)
    lists = tokens.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(F.struct("pos", "text", "start_cs", "end_cs", "probability"))).alias("tokens"))
    plan = T.words_of(lists.join(bounds, ["conv_id", "segment"]))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
