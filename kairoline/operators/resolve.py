"""What shows at a tick: clips on enabled visual tracks in lane order, transitions around cuts first.

Ticks and clips meet in a bucketed equality join, so a whole export is one query over a range of ticks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.styles import REFERENCE_HEIGHT
from .intervals import interval_join, stab_join
from .introspect import fit_scale
from .timeline import VISUAL, abutting


def transition_windows(clips: DataFrame, transitions: DataFrame) -> DataFrame:
    """left_id, right_id, track_id, cut, name, win_start and win_dur of transitions (left_id, right_id, name, duration)
    whose clips touch. The window is the duration around the cut, its first half rounded down."""
    t = transitions.join(abutting(clips), ["left_id", "right_id"])
    return t.select("left_id", "right_id", "track_id", "cut", "name", (F.col("cut") - F.floor(F.col("duration") / 2)).alias("win_start"), F.col("duration").alias("win_dur"))


#: Ticks of a block, one bit of a mask each.
_TICKS = 32


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (_block, _mask and others, by block in the order of their layers), one for each bit of a mask, with _i, the bit, and _n, how many rows of its
    block have had that bit by then. A task holds one count for each bit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, np.zeros(_TICKS, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            blocks, masks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bits = np.unpackbits(masks.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            sums = np.concatenate([np.zeros((1, _TICKS), np.int64), np.cumsum(bits, axis=0, dtype=np.int64)])
            heads = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1]
            before = sums[heads]
            if blocks[0] == block:
                before[0] -= held
            block, held = blocks[-1], sums[-1] - before[-1]
            row, i = np.nonzero(bits)
            n = sums[row + 1, i] - before[np.searchsorted(heads, row, "right") - 1, i]
            own = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(i.astype(np.int32)), pa.array(n)], names=[*own.schema.names, "_i", "_n"])

    return rows.mapInArrow(count, T.StructType([*rows.schema.fields, T.StructField("_i", T.IntegerType()), T.StructField("_n", T.LongType())]))


def layers(ticks: DataFrame, clips: DataFrame, tracks: DataFrame, transitions: DataFrame | None = None, bucket: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """t, layer (from 0, lowest first), track_id, clip_id, other_id and progress of every tick's layers, and columns to keep of clips (null in a
    transition) and tracks.

    In a transition clip_id is the outgoing and other_id the incoming clip. Ticks are whole numbers. Clips meet blocks of ticks and are counted there
    by masks, so what is shuffled and sorted is a row for each clip and block; layers become rows at the very end, counted over arrays."""
    of_clips = [c for c in keep if c in clips.columns]
    of_tracks = [c for c in keep if c not in of_clips]
    shown = tracks.where(F.col("enabled") & F.col("kind").isin(*VISUAL)).select("track_id", "order_idx", *(F.col(c).alias(f"_k_{c}") for c in of_tracks))
    # ticks for all tracks meet clips by time alone, those of one track by track and time
    keys = ["track_id"] if "track_id" in ticks.columns else []
    whole = F.when(F.col("t") == F.floor("t"), F.col("t").cast("long")).otherwise(F.raise_error(F.lit("a tick is a whole number")).cast("long"))
    bits = ticks.where("t IS NOT NULL").select(*keys, whole.alias("t")).select(*keys, F.shiftright("t", 5).alias("_block"), F.expr(f"shiftleft(1L, int(t & {_TICKS - 1}))").alias("_bit"))
    asked = bits.groupBy(*keys, "_block").agg(F.bit_or("_bit").alias("_asked")).select("*", (F.col("_block") * _TICKS).alias("_first"), F.lit(_TICKS).cast("long").alias("_ticks"))
    spans = clips.select("track_id", "clip_id", F.col("start_tick").alias("_start"), F.col("dur_tick").alias("_dur"), *(F.col(c).alias(f"_k_{c}") for c in of_clips))
    order = ["_start", "clip_id"]
    if transitions is not None:
        # of one track a transition goes before a clip
        w = transition_windows(clips, transitions).select("track_id", F.col("left_id").alias("clip_id"), F.col("win_start").alias("_start"), F.col("win_dur").alias("_dur"), F.col("right_id").alias("other_id"), F.col("cut").alias("_at"))
        spans = spans.select("*", F.lit(None).cast("long").alias("other_id"), F.col("_start").alias("_at")).unionByName(w, allowMissingColumns=True)
        order = ["_plain", "_at", "clip_id", "other_id", "_dur"]
    own = spans.join(shown, "track_id")
    met = interval_join(asked, own, keys, ("_first", "_ticks"), ("_start", "_dur"), bucket)
    low, high = F.greatest(F.col("_start") - F.col("_first"), F.lit(0)), F.least(F.col("_start") + F.col("_dur") - F.col("_first"), F.lit(_TICKS))
    met = met.withColumns({"_low": low.cast("int"), "_high": high.cast("int")}).withColumn("_mask", F.expr("_asked & (shiftleft(1L, _high) - shiftleft(1L, _low))")).where("_mask <> 0")
    rest = ["clip_id", "_start"] if transitions is None else ["clip_id", "other_id", "_at", "_start", "_dur"]
    rest += [f"_k_{c}" for c in keep]
    dealt = met.select("_block", "_mask", "order_idx", "track_id", *rest).repartition("_block")
    if transitions is not None:
        dealt = dealt.withColumn("_plain", F.col("other_id").isNull())
    # of a track the first that covers a tick shows there; both windows have one order, so rows are sorted once
    lane = Window.partitionBy("_block", "order_idx", "track_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.bit_or("_mask").over(lane), F.lit(0).cast("long"))
    free = dealt.withColumn("_mask", F.col("_mask").bitwiseAND(F.bitwise_not(taken))).where("_mask <> 0")
    each = _numbered(free.sortWithinPartitions("_block", "order_idx", "track_id", *order).select("_block", "_mask", "track_id", *rest))
    t = F.col("_block") * _TICKS + F.col("_i")
    other, progress = F.lit(None).cast("long"), F.lit(None).cast("double")
    if transitions is not None:
        other, progress = F.col("other_id"), F.when(F.col("other_id").isNotNull(), (t - F.col("_start")) / F.col("_dur"))
    return each.select(t.cast(ticks.schema["t"].dataType).alias("t"), (F.col("_n") - 1).cast("int").alias("layer"), "track_id", "clip_id", other.alias("other_id"), progress.alias("progress"), *(F.col(f"_k_{c}").alias(c) for c in keep))


def ticks_of_clip(ticks: DataFrame, clips: DataFrame, clip: int, bucket: int = 64) -> DataFrame:
    """Those of the ticks (t) that lie in a clip: all that ``partition_layers`` can name for it, where there are no transitions."""
    own = clips.where(F.col("clip_id") == clip).select(F.col("start_tick").alias("_start"), F.col("dur_tick").alias("_dur"))
    return stab_join(ticks.select("t"), own, [], "t", ("_start", "_dur"), bucket).select("t").distinct()


def with_overrides(layers_: DataFrame, overrides: DataFrame, columns: list[str]) -> DataFrame:
    """Values of single clips replaced while they are being edited. overrides: clip_id and the columns."""
    o = overrides.select("clip_id", *(F.col(c).alias(f"_o_{c}") for c in columns))
    out = layers_.join(o, "clip_id", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_o_{c}", c))
    return out.drop(*(f"_o_{c}" for c in columns))


def partition_layers(layers_: DataFrame, clip: int) -> DataFrame:
    """Layers below, at and above that of a clip, for each tick that shows it."""
    at = F.max(F.when(F.col("clip_id") == clip, F.col("layer"))).over(Window.partitionBy("t"))
    return layers_.withColumn("_at", at).where("_at IS NOT NULL").withColumn("side", F.when(F.col("layer") < F.col("_at"), "below").when(F.col("layer") > F.col("_at"), "above").otherwise("sprite")).drop("_at")


def scene(layers_: DataFrame, clips: DataFrame, media: DataFrame, sampled: DataFrame, canvas: tuple[int, int]) -> DataFrame:
    """t, layer, clip_id and scene, a struct of where and how each layer of a picture is drawn on the canvas.

    sampled: clip_id, t, position_x, position_y, anchor_x, anchor_y, scale_x, scale_y, rotation (degrees) and opacity, as
    ``params.sample`` gives them; a clip without a row stands in the middle as it is. The content fits the canvas before it is
    scaled. Media without a picture place nothing. ``px`` is the length of a style's pixel, for canvases and scales other than
    those it was made for."""
    width, height = (float(c) for c in canvas)
    own = layers_.select("t", "layer", "clip_id").join(clips.select("clip_id", "media_id"), "clip_id")
    shown = own.join(media.select("media_id", F.col("width").cast("double").alias("_w"), F.col("height").cast("double").alias("_h")), "media_id").where("_w > 0 AND _h > 0")
    s = shown.join(sampled, ["clip_id", "t"], "left")
    value = lambda name, default: F.coalesce(F.col(name).cast("double"), F.lit(default))
    sx, sy, fit = value("scale_x", 1.0), value("scale_y", 1.0), fit_scale(F.col("_w"), F.col("_h"), F.lit(width), F.lit(height))
    parts = F.struct(
        F.struct((width * (0.5 + value("position_x", 0.0))).alias("x"), (height * (0.5 + value("position_y", 0.0))).alias("y")).alias("center"),
        F.struct(value("anchor_x", 0.5).alias("x"), value("anchor_y", 0.5).alias("y")).alias("anchor"),
        F.struct((F.col("_w") * fit * sx).alias("w"), (F.col("_h") * fit * sy).alias("h")).alias("size"),
        F.radians(value("rotation", 0.0)).alias("rotation"),
        value("opacity", 1.0).alias("opacity"),
        (height / REFERENCE_HEIGHT * F.sqrt(sx * sy)).alias("px"),
    )
    return s.select("t", "layer", "clip_id", parts.alias("scene"))
