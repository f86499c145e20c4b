"""Summaries, nearest points, paging, eviction and tiling of project tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def snap(drags: DataFrame, candidates: DataFrame, threshold: int, keys: list[str]) -> DataFrame:
    """drags (keys, drag_id, cursor, dur) with the nearest candidate (keys, seq, tick) within the threshold of either edge.

    The trailing edge counts for clips of two thresholds or more. Of equal distances the earlier candidate wins, and the
    leading edge of one candidate. Candidates are met through buckets as wide as the threshold, so each edge looks
    at three buckets only."""
    lead = F.struct(F.lit(0).alias("side"), F.col("cursor").alias("edge"))
    trail = F.struct(F.lit(1).alias("side"), (F.col("cursor") + F.col("dur")).alias("edge"))
    edges = drags.withColumn("_e", F.explode(F.when(F.col("dur") >= 2 * threshold, F.array(lead, trail)).otherwise(F.array(lead))))
    b = F.floor(F.col("_e.edge") / threshold)
    asked = edges.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    near = asked.join(candidates.withColumn("_b", F.floor(F.col("tick") / threshold)), [*keys, "_b"])
    distance = F.abs(F.col("tick") - F.col("_e.edge"))
    hits = near.where(distance <= threshold)
    start = F.when(F.col("_e.side") == 1, F.col("tick") - F.col("dur")).otherwise(F.col("tick"))
    best = hits.groupBy("drag_id").agg(F.min(F.struct(distance.alias("d"), F.col("seq"), F.col("_e.side").alias("side"), start.alias("start"), F.col("tick"))).alias("h"))
    out = drags.join(best, "drag_id", "left")
    return out.select("drag_id", F.col("h").isNotNull().alias("snapped"), F.coalesce("h.start", "cursor").alias("start"), F.col("h.tick").alias("line"))


def evict_oldest(files: DataFrame, quota: int | Column, keys: list[str] | None = None) -> DataFrame:
    """Of files (path, bytes, mtime, protected) those to remove, the oldest first, until the rest fits the quota.
    Protected files neither count nor go."""
    own = Window.partitionBy(*(keys or [F.lit(0)]))
    free = files.where(~F.col("protected"))
    before = F.coalesce(F.sum("bytes").over(own.orderBy("mtime", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return free.withColumn("_left", F.sum("bytes").over(own) - before).where(F.col("_left") > quota).drop("_left")


def keep_latest(rows: DataFrame, n: int, order: Column, tie: str, keys: list[str]) -> DataFrame:
    """The latest n rows of each key and whether there were more."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("_r", F.row_number().over(w.orderBy(order.desc(), tie))).where(F.col("_r") <= n + 1)
    return numbered.withColumn("truncated", F.max("_r").over(w) > n).where(F.col("_r") <= n).withColumnRenamed("_r", "position")


def positions(rows: DataFrame, bucket: Column, order: list[str | Column]) -> DataFrame:
    """rows with position, counted from 1 over the whole table in the order given. The bucket must not fall in that order: rows
    are numbered within buckets, and only one row for each bucket is numbered in one place."""
    named = rows.withColumn("_p", bucket)
    sizes = named.groupBy("_p").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("_p").alias("_q"), before.alias("_before"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    joined = named.withColumn("_own", own).join(offsets, F.col("_p").eqNullSafe(F.col("_q")))
    return joined.select(*rows.columns, (F.col("_before") + F.col("_own")).cast("long").alias("position"))


def page(rows: DataFrame, order: list[str], number: int, size: int = 12) -> DataFrame:
    """The rows of a page, counted from 1. Only the rows up to its end are gathered; a page without rows raises."""
    if number < 1:
        raise ValueError("pages count from 1")
    first = rows.orderBy(*order).limit(number * size)
    shown = first.withColumn("_n", F.row_number().over(Window.orderBy(*order))).where(F.col("_n") > (number - 1) * size).drop("_n")
    if number > 1 and not shown.limit(1).count():
        raise ValueError(f"there is no page {number}")
    return shown


def frame_at(wanted: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The first frame (pts) at or after each wanted time t: a forward as-of join on the sorted union."""
    extra = [c for c in wanted.columns if c not in (*keys, "t")]
    a = wanted.select(*keys, F.col("t").alias("_at"), F.lit(1).alias("_ask"), *extra, F.lit(None).cast(frames.schema["pts"].dataType).alias("pts"))
    b = frames.select(*keys, F.col("pts").alias("_at"), F.lit(0).alias("_ask"), *(F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra), "pts")
    # from the last one back, so that the frame grows from its first row and each row costs a constant
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("pts", F.last("pts", ignorenulls=True).over(w)).where("_ask = 1").select(*keys, F.col("_at").alias("t"), *extra, "pts")


def frame_before(wanted: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """The last frame (pts) at or before each wanted time t: where a seek lands."""
    extra = [c for c in wanted.columns if c not in (*keys, "t")]
    a = wanted.select(*keys, F.col("t").alias("_at"), F.lit(1).alias("_ask"), *extra, F.lit(None).cast(frames.schema["pts"].dataType).alias("pts"))
    b = frames.select(*keys, F.col("pts").alias("_at"), F.lit(0).alias("_ask"), *(F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in extra), "pts")
    w = Window.partitionBy(*keys).orderBy("_at", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("pts", F.last("pts", ignorenulls=True).over(w)).where("_ask = 1").select(*keys, F.col("_at").alias("t"), *extra, "pts")


def tile_step(px_per_second: Column, min_px: float, low: int = -6, high: int = 12) -> Column:
    """The least k, within bounds, with tiles of 2**k seconds at least so wide."""
    size = F.try_divide(F.lit(min_px), px_per_second)
    k = F.ceil(F.log2(size))
    return F.when(size.isNull() | F.isnan(size), high).otherwise(F.greatest(F.lit(low), F.least(k, F.lit(high)))).cast("int")


def tile_micros(k: Column) -> Column:
    return F.when(k >= 0, F.expr("bigint(1000000)") * F.pow(F.lit(2.0), k).cast("long")).otherwise(F.floor(1_000_000 / F.pow(F.lit(2.0), -k))).cast("long")


#: The intervals between labels, in seconds, from which a map's ruler is chosen.
INTERVALS = (0.5, 1.0, 2.0, 5.0, 10.0, 15.0, 30.0, 60.0, 120.0, 300.0, 600.0, 1800.0)


def interval(span_seconds: Column, most: int) -> Column:
    """The first interval that gives at most so many labels, else the last."""
    fits = F.filter(F.array(*map(F.lit, INTERVALS)), lambda x: span_seconds / x <= most)
    return F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(INTERVALS[-1]))


def strip_times(start: Column, end: Column, n: int) -> Column:
    """n times from start to end, both ends exact."""
    if n == 1:
        return F.array((start + end) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == 0, start).when(i == n - 1, end).otherwise(start + (end - start) * i / (n - 1)))


def moving_cost(costs: DataFrame, keys: list[str], order: str, value: str, alpha: float = 0.3, run: int = 1024) -> DataFrame:
    """Exponential mean of a key's values in order (ties by value); the first one starts it.

    Values are split by ranges of key and order, so that a key of any size lies in many tasks, and numbered within them. ``run``
    values after one another are folded at once: a run maps the mean before it, m, to m (1 - alpha)**n + b. The maps
    of a part's runs make the part's, and those of a key's parts its mean; a key within one run is a plain fold. Null values are left out, and so are
    keys that have no other."""
    k, part = [f"_k{i}" for i in range(len(keys))], [f"_k{i}" for i in range(len(keys))] + ["_p"]
    rows = costs.select(*(F.col(c).alias(n) for c, n in zip(keys, k, strict=True)), F.col(order).alias("_o"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    dealt = rows.repartitionByRange(*k, "_o", "_v").withColumn("_p", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy(*part).orderBy("_o", "_v")) - 1
    runs = dealt.withColumn("_i", place).groupBy(*part, F.floor(F.col("_i") / run).alias("_r")).agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("_l"))
    step = lambda s, x: s + alpha * (x["_v"] - s)
    fold = lambda first, rest: F.aggregate(rest, first, step)
    alone = fold(F.element_at("_l", 1)["_v"], F.slice("_l", 2, run))
    maps = runs.select(*part, "_r", F.size("_l").cast("long").alias("n"), fold(F.lit(0.0), F.col("_l")).alias("b"), alone.alias("m"))

    def composed(maps: DataFrame, by: list[str], at: str) -> DataFrame:
        """One map of each group's: values, b, and m, the mean if nothing came before."""
        grouped = maps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(at, "n", "b", "m"))).alias("_l"))
        then = lambda s, x: s * F.pow(F.lit(1.0 - alpha), x["n"]) + x["b"]
        rest = F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(1)))
        head = F.element_at("_l", 1)
        count = F.aggregate("_l", F.lit(0).cast("long"), lambda s, x: s + x["n"])
        return grouped.select(*by, count.alias("n"), F.when(F.size("_l") == 1, head["b"]).otherwise(F.aggregate(rest, head["b"], then)).alias("b"), F.when(F.size("_l") == 1, head["m"]).otherwise(F.aggregate(rest, head["m"], then)).alias("m"))

    means = composed(composed(maps, part, "_r"), k, "_p")
    return means.select(*(F.col(n).alias(c) for c, n in zip(keys, k, strict=True)), F.col("m").alias("mean"))


def roll_window(seek: Column, frame: Column, fps: float, most_seconds: float = 10.0) -> Column:
    """Seconds up to which decoding on is cheaper than a seek: from two frames to ten seconds."""
    return F.greatest(F.lit(2.0 / fps), F.least(seek / frame / fps, F.lit(most_seconds)))


def motion_ticks(t: Column, shutter: float, samples: int) -> Column:
    """Ticks at which a moving layer is sampled: evenly over shutter / 360 of a frame around t."""
    if not 2 <= samples <= 16:
        raise ValueError("from 2 to 16 samples")
    width = shutter / 360
    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: t + (i / float(samples - 1) - 0.5) * width)


def crop_uv(x: Column, y: Column, w: Column, h: Column, flip_h: Column, flip_v: Column) -> Column:
    """Texture rectangle u0, v0, u1, v1 of a crop, ends swapped where flipped."""
    return F.array(F.when(flip_h, x + w).otherwise(x), F.when(flip_v, y + h).otherwise(y), F.when(flip_h, x).otherwise(x + w), F.when(flip_v, y).otherwise(y + h))


def canvas(aspect_w: int, aspect_h: int, base: int = 1080) -> tuple[int, int]:
    """Width and height of an aspect whose shorter side is the base, both rounded down to even."""
    even = lambda x: max(2, x // 2 * 2)
    longer = math.floor(base * max(aspect_w, aspect_h) / min(aspect_w, aspect_h) + 0.5)
    return (even(longer), even(base)) if aspect_w >= aspect_h else (even(base), even(longer))


def fit_scale(w: Column, h: Column, canvas_w: Column, canvas_h: Column) -> Column:
    """The scale at which content just fits a canvas; 1 for empty content."""
    return F.when((w <= 0) | (h <= 0), F.lit(1.0)).otherwise(F.least(F.try_divide(canvas_w, w), F.try_divide(canvas_h, h)))


def looping_frame(delays: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
    """Index of the animation frame shown at a time (ms): frames (keys, idx, delay) run on and start again."""
    w = Window.partitionBy(*keys)
    until = F.sum("delay").over(w.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    runs = delays.withColumn("until", until).withColumn("total", F.sum("delay").over(w))
    j = asks.join(runs, keys)
    return j.where(F.col("ms") % F.col("total") < F.col("until")).groupBy(*asks.columns).agg(F.min("idx").alias("idx"))


# Steps of a ruler's labels, in frames and in seconds, parts between labels, and least widths in pixels.
FRAME_STEPS = (1, 2, 3, 4, 5, 6, 10, 12, 15, 20, 30)
SECOND_STEPS = (1, 2, 3, 5, 10, 15, 30, 60, 120, 180, 300, 600, 900, 1800, 3600, 7200, 18000, 36000)
PARTS = (10, 8, 6, 5, 4, 3, 2)


def label_step(zoom: Column, fps: int, least_px: float) -> Column:
    """Frames between labels: the first step wide enough; steps below a second divide it."""
    steps = [f for f in FRAME_STEPS if f < fps and fps % f == 0] + [s * fps for s in SECOND_STEPS]
    wide = F.filter(F.array(*(F.lit(s).cast("long") for s in steps)), lambda s: s * zoom >= least_px)
    return F.coalesce(F.try_element_at(wide, F.lit(1)), F.lit(steps[-1]).cast("long"))


def dot_step(label: Column, zoom: Column, least_px: float) -> Column:
    """Frames between dots, the densest even parts of a label step that are wide enough; null for none."""
    fits = F.filter(F.array(*(F.lit(p).cast("long") for p in PARTS)), lambda p: (label % p == 0) & (F.floor(label / p) * zoom >= least_px))
    return F.floor(label / F.try_element_at(fits, F.lit(1)))


def padded_range(low: Column, high: Column, part: float) -> Column:
    """A range with room on both sides; a flat one gets room by its size."""
    a, b = F.least(low, high), F.greatest(low, high)
    pad = F.when(b - a < 1e-6, F.greatest(F.abs(a), F.lit(1.0)) * part).otherwise((b - a) * part)
    return F.struct((a - pad).alias("low"), (b + pad).alias("high"))


def capabilities(kind: Column, is_media: Column, frozen: Column, has_sound: Column, detached: Column) -> Column:
    """What may be done with a clip."""
    visual = kind != "audio"
    retime = is_media & ~frozen
    return F.struct(visual.alias("transform"), visual.alias("crop"), ((kind == "audio") & ~frozen).alias("audio"), retime.alias("speed"), visual.alias("effects"), retime.alias("reverse"), ((kind == "video") & ~frozen & has_sound & ~detached).alias("extract_audio"))
