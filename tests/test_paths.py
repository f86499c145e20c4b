"""Probes of paths are measured without sorting chords."""

import math

from kairoline.functions import paths


def test_chords_are_drawn_after_the_join(spark):
    points = spark.createDataFrame([(1, s, True, x, y, x, y, x, y) for s, (x, y) in enumerate([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)])] + [(2, 0, False, 0.0, 0.0, 0.0, 0.0, 0.0, 8.0), (2, 1, False, 8.0, 0.0, 8.0, 8.0, 8.0, 0.0)], "path_id long, seq long, closed boolean, ax double, ay double, inx double, iny double, outx double, outy double")
    probes = spark.createDataFrame([(1, 0, 5.0, 4.0), (1, 1, 13.0, 14.0), (2, 0, 4.0, 6.0)], "path_id long, probe long, px double, py double")
    found = paths.measured(points, probes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")
    got = {(r.path_id, r.probe): (r.distance, r.winding) for r in found.collect()}
    assert math.isclose(got[1, 0][0], 4.0) and got[1, 0][1] != 0
    assert math.isclose(got[1, 1][0], 5.0) and got[1, 1][1] == 0
    assert got[2, 0][0] < 0.01
    assert paths.chords(points).where("path_id = 2").count() == paths.STEPS and paths.chords(points).where("path_id = 1").count() == 4
