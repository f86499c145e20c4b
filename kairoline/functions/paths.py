"""Bezier paths as rows of points: path_id, seq, closed, ax, ay (the point), inx, iny (its handle before) and outx, outy (its
handle after).

A path is drawn as chords: STEPS for a curved piece, one for a straight piece (both handles on their points). Paths of fewer than two
points aren't drawn. Everything is by path, so paths spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: chords of a curved piece.
STEPS = 16


def _pieces(points: DataFrame) -> DataFrame:
    """The points that a piece begins at, with the one after each; closed paths return to their first point."""
    w = Window.partitionBy("path_id").orderBy("seq")
    whole = Window.partitionBy("path_id")
    place = F.struct("ax", "ay", "inx", "iny")
    following = F.coalesce(F.lead(place).over(w), F.when(F.col("closed"), F.first(place).over(w)))
    return points.withColumn("_next", following).withColumn("_n", F.count("*").over(whole)).where((F.col("_n") >= 2) & F.col("_next").isNotNull())


def _drawn(pieces: DataFrame, steps: int, *also: str) -> DataFrame:
    """The chords of pieces: rows are made last, of plain expressions, and never sorted or kept."""
    straight = (F.col("outx") == F.col("ax")) & (F.col("outy") == F.col("ay")) & (F.col("_next.inx") == F.col("_next.ax")) & (F.col("_next.iny") == F.col("_next.ay"))

    def at(k, axis: str):
        t = k / F.lit(float(steps))
        u = 1.0 - t
        curve = u * u * u * F.col(f"a{axis}") + 3.0 * u * u * t * F.col(f"out{axis}") + 3.0 * u * t * t * F.col(f"_next.in{axis}") + t * t * t * F.col(f"_next.a{axis}")
        return F.when(F.col("_straight"), F.when(k == 0, F.col(f"a{axis}")).otherwise(F.col(f"_next.a{axis}"))).otherwise(curve)

    numbered = pieces.withColumn("_straight", straight).withColumn("k", F.explode(F.when(F.col("_straight"), F.array(F.lit(1))).otherwise(F.array(*map(F.lit, range(1, steps + 1))))))
    k = F.col("k")
    return numbered.select("path_id", "closed", F.col("seq").alias("piece"), "k", at(k - 1, "x").alias("x0"), at(k - 1, "y").alias("y0"), at(k, "x").alias("x1"), at(k, "y").alias("y1"), *also)


def chords(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """path_id, closed, piece, k, x0, y0, x1 and y1 of every chord; closed paths return to their first point."""
    return _drawn(_pieces(points), steps)


def bounds(points: DataFrame, steps: int = STEPS) -> DataFrame:
    """path_id, left, top, right and bottom of the drawn chords; handles may lie far outside."""
    low = lambda a: F.least(F.min(f"{a}0"), F.min(f"{a}1"))
    high = lambda a: F.greatest(F.max(f"{a}0"), F.max(f"{a}1"))
    return chords(points, steps).groupBy("path_id").agg(low("x").alias("left"), low("y").alias("top"), high("x").alias("right"), high("y").alias("bottom"))


def measured(points: DataFrame, probes: DataFrame, steps: int = STEPS) -> DataFrame:
    """probes (path_id, probe, px, py) of drawn paths, with closed, the distance to the line and the winding number. Probes meet
    pieces, which are then drawn, so the join sorts no chords."""
    j = _drawn(_pieces(points).join(probes.select("path_id", "probe", "px", "py"), "path_id"), steps, "probe", "px", "py")
    ex, ey, wx, wy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(wx * ex + wy * ey, ex * ex + ey * ey), F.lit(0.0))))
    square = (wx - ex * t) * (wx - ex * t) + (wy - ey * t) * (wy - ey * t)
    side = ex * wy - ey * wx
    up = (F.col("y0") <= F.col("py")) & (F.col("y1") > F.col("py")) & (side > 0)
    down = (F.col("y0") > F.col("py")) & (F.col("y1") <= F.col("py")) & (side < 0)
    turn = F.when(up, 1).when(down, -1).otherwise(0)
    return j.groupBy("path_id", "probe", "px", "py", "closed").agg(F.sqrt(F.min(square)).alias("distance"), F.sum(turn).alias("winding"))


def hits(points: DataFrame, probes: DataFrame, stroke: float = 0.0, steps: int = STEPS) -> DataFrame:
    """path_id, probe and hit: inside a closed path (winding number not zero), or within half the stroke of the line, 1 at
    least. Paths that aren't drawn have no rows."""
    m = measured(points, probes, steps)
    return m.select("path_id", "probe", ((F.col("distance") <= max(stroke / 2, 1.0)) | F.col("closed") & (F.col("winding") != 0)).alias("hit"))


def cover(points: DataFrame, probes: DataFrame, fill: bool = True, stroke: float = 0.0, steps: int = STEPS) -> DataFrame:
    """path_id, probe, and how much of the pixel around it fill and stroke cover; open paths have a stroke only."""
    m = measured(points, probes, steps)
    ramp = lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - d))
    inside = F.col("closed") & (F.col("winding") != 0)
    area = ramp(F.when(inside, -F.col("distance")).otherwise(F.col("distance"))) * F.col("closed").cast("double") if fill else F.lit(0.0)
    line = ramp(F.col("distance") - stroke / 2) if stroke > 0 else F.lit(0.0)
    return m.select("path_id", "probe", area.alias("fill"), line.alias("stroke"))
