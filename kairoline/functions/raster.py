"""Effects on coverage masks, as tables of pixels (image_id, x, y, a; a from 0 to 255), such as those behind letters.

All work is by window over a row or a column of an image and by pixel, so an image spreads over tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shapes import coverage, round_box

# Fixed value: how often the two passes of a blur are run.
BLUR_ROUNDS = 2


def dilate(mask: DataFrame, radius: float) -> DataFrame:
    """Each pixel becomes the greatest one within a circle; pixels outside the image don't count.

    A circle is a chord in each row: the greatest of each chord is a window over the row, and goes to the rows above and below.
    So a pixel is copied twice the radius, not its square."""
    r = int(radius)
    if r <= 0:
        return mask
    row = Window.partitionBy("image_id", "y").orderBy("x")
    half = [math.isqrt(max(0, int(radius * radius) - d * d)) for d in range(r + 1)]
    greatest = mask.select("image_id", "x", "y", *(F.max("a").over(row.rangeBetween(-h, h)).alias(f"_m{d}") for d, h in enumerate(half)))
    sent = F.array(*(F.struct((F.col("y") + s * d).alias("y"), F.col(f"_m{d}").alias("a"), F.lit(d == 0).alias("own")) for d in range(r + 1) for s in ((1, -1) if d else (1,))))
    spread = greatest.select("image_id", "x", F.explode(sent).alias("s")).select("image_id", "x", "s.y", "s.a", "s.own")
    return spread.groupBy("image_id", "x", "y").agg(F.max("a").alias("a"), F.bool_or("own").alias("own")).where("own").drop("own")


def _pass(mask: DataFrame, radius: int, along: str, across: str) -> DataFrame:
    """Mean over 2 * radius + 1 pixels, rounded; beyond an edge its pixel is repeated."""
    line = Window.partitionBy("image_id", across).orderBy(along)
    whole = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    size = 2 * radius + 1
    at, n = F.row_number().over(line) - 1, F.count("*").over(whole)
    before, after = F.greatest(F.lit(0), radius - at), F.greatest(F.lit(0), at + radius - (n - 1))
    total = F.sum("a").over(line.rowsBetween(-radius, radius)) + before * F.first("a").over(whole) + after * F.last("a").over(whole)
    return mask.withColumn("a", F.floor((total + size // 2) / size).cast("int"))


def box_blur(mask: DataFrame, radius: float, rounds: int = BLUR_ROUNDS) -> DataFrame:
    """Rows, then columns, as often as given; near to a Gaussian blur. Images are full rectangles."""
    r = max(1, math.floor(radius + 0.5))
    for _ in range(rounds):
        mask = _pass(_pass(mask, r, "x", "y"), r, "y", "x")
    return mask


def card(x: Column, y: Column, left: float, top: float, right: float, bottom: float, roundness: float) -> Column:
    """Coverage of a rectangle with round corners at a pixel's middle; roundness 1 makes half the shorter side the radius."""
    half = ((right - left) / 2, (bottom - top) / 2)
    if min(half) <= 0:
        return F.lit(0.0)
    return coverage(round_box(x + 0.5 - (left + right) / 2, y + 0.5 - (top + bottom) / 2, half, max(0.0, min(1.0, roundness)) * min(half)), 0.5)
