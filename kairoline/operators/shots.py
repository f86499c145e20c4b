"""Shot boundaries from frames' pixels (media_id, t, x, y, r, g, b, a), in one pass over the sampled pixels.

Features of a frame are one row: a luma histogram, its sum, and the sampled pixels in order as an array, whose size the
sample grid bounds. A frame is compared with the one before it by lag, and the greedy gate keeps boundaries apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .gates import greedy_gate


@dataclass(frozen=True)
class Config:
    columns: int = 64
    rows: int = 36
    bins: int = 32
    histogram_weight: float = 0.4
    pixel_weight: float = 0.6
    threshold: float = 0.38
    minimum_seconds: float = 0.5

    def __post_init__(self):
        if min(self.columns, self.rows) < 1 or not 2 <= self.bins <= 256 or self.histogram_weight + self.pixel_weight <= 0 or not 0 < self.threshold <= 1 or self.minimum_seconds < 0:
            raise ValueError("a grid, 2 to 256 bins, a weight, 0 < threshold <= 1 and a duration are needed")


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def sample_coordinate(i: Column, length: Column, count: Column) -> Column:
    """The middle of the i-th of ``count`` equal parts of ``length``, rounded down."""
    return F.floor((2 * i + 1) * length / (2 * count)).cast("int")


def is_middle(at: Column, length: Column, count: Column) -> Column:
    """Whether a coordinate is the middle of a part: of the one it lies in or, as middles are rounded down, of the next one."""
    part = F.floor(at * count / length)
    hits = lambda i: (i < count) & (sample_coordinate(i, length, count) == at)
    return hits(part) | hits(part + 1)


def features(pixels: DataFrame, config: Config) -> DataFrame:
    """media_id, t, width, height, n, luma_sum, hist and sampled (r, g, b, a in order of y and x)."""
    frame = Window.partitionBy("media_id", "t")
    sized = pixels.withColumn("width", F.max("x").over(frame) + 1).withColumn("height", F.max("y").over(frame) + 1)
    sized = sized.withColumn("_nx", F.least("width", F.lit(config.columns))).withColumn("_ny", F.least("height", F.lit(config.rows)))
    hit = is_middle(F.col("x"), F.col("width"), F.col("_nx")) & is_middle(F.col("y"), F.col("height"), F.col("_ny"))
    some = sized.where(hit).withColumn("l", luma(F.col("r"), F.col("g"), F.col("b")))
    item = F.struct("y", "x", "r", "g", "b", "a")
    rows = some.groupBy("media_id", "t").agg(F.first("width").alias("width"), F.first("height").alias("height"), F.count("*").alias("n"), F.sum("l").alias("luma_sum"), F.array_sort(F.collect_list(item)).alias("sampled"), *(F.count_if(F.floor(F.col("l") * config.bins / 256) == k).alias(f"_h{k}") for k in range(config.bins)))
    return rows.withColumn("hist", F.array(*(f"_h{k}" for k in range(config.bins)))).drop(*(f"_h{k}" for k in range(config.bins)))


def histogram_distance(before: Column, after: Column, n: Column, bins: int) -> Column:
    """What must be moved, and how far, to turn one histogram into the other, as a share of the most there can be."""
    diff = F.slice(F.zip_with(before, after, lambda a, b: b - a), 1, bins - 1)
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))
    moved = F.aggregate(diff, start, lambda s, d: F.struct((s["run"] + d).alias("run"), (s["sum"] + F.abs(s["run"] + d)).alias("sum")))["sum"]
    return moved / (n * (bins - 1))


def pixel_difference(before: Column, after: Column, shift: Column, n: Column) -> Column:
    """Mean change of the channels, the frame's change of brightness taken out of the colours."""
    change = lambda p, q: sum(F.abs(q[c].cast("double") - p[c] - shift) for c in ("r", "g", "b")) + F.abs(q["a"].cast("double") - p["a"])
    total = F.aggregate(F.zip_with(before, after, change), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total / (n * 4.0 * 255)))


def scores(feats: DataFrame, config: Config) -> DataFrame:
    """media_id, t, previous_t, score and kind of each frame but the first."""
    w = Window.partitionBy("media_id").orderBy("t")
    before = feats.withColumn("p", F.lag(F.struct("t", "width", "height", "luma_sum", "hist", "sampled")).over(w)).where("p IS NOT NULL")
    shift = (F.col("luma_sum") - F.col("p.luma_sum")) / F.col("n").cast("double")
    same = (F.col("width") == F.col("p.width")) & (F.col("height") == F.col("p.height"))
    mixed = (config.histogram_weight * histogram_distance(F.col("p.hist"), F.col("hist"), F.col("n"), config.bins) + config.pixel_weight * pixel_difference(F.col("p.sampled"), F.col("sampled"), shift, F.col("n"))) / (config.histogram_weight + config.pixel_weight)
    score = F.when(same, F.greatest(F.lit(0.0), F.least(F.lit(1.0), mixed))).otherwise(1.0)
    return before.select("media_id", "t", F.col("p.t").alias("previous_t"), score.cast("float").alias("score"), F.when(same, "visual").otherwise("dimension").alias("kind"))


def detect_shots(pixels: DataFrame, config: Config) -> DataFrame:
    """Boundaries (media_id, t, previous_t, score, kind): hard changes at least the minimum after the shot's start."""
    feats = features(pixels, config)
    first = feats.groupBy("media_id").agg(F.min("t").alias("start"))
    hard = scores(feats, config).where(F.col("score") >= config.threshold)
    # the first frame starts a shot, so it takes part in the gate and is no boundary
    found = F.struct("previous_t", "score", "kind")
    events = hard.select("media_id", "t", found.alias("found"))
    starts = first.select("media_id", F.col("start").alias("t"), F.lit(None).cast(events.schema["found"].dataType).alias("found"))
    kept = greedy_gate(events.unionByName(starts), "media_id", "t", config.minimum_seconds, "found").where("found IS NOT NULL")
    return kept.select("media_id", "t", "found.previous_t", "found.score", "found.kind")


def out_of_order(frames: DataFrame, order: str) -> DataFrame:
    """Frames earlier than the one that came before them; equal times are fine."""
    w = Window.partitionBy("media_id").orderBy(order)
    return frames.withColumn("before", F.lag("t").over(w)).where("t < before")
