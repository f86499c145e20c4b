"""Sound analysis on PCM tables (media_id, frame, ch, sample).

Windows start at frame 0 and every hop; the last ones are cut short at the end. Frames are dealt to their windows by
integer arithmetic and summed, so a medium's sound may be spread over any number of tasks. Only one row for each window is
ordered, by medium.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .gates import greedy_gate


@dataclass(frozen=True)
class Loudness:
    window_seconds: float = 0.050
    hop_seconds: float = 0.025
    floor_dbfs: float = -120.0

    def __post_init__(self):
        if not 0 < self.hop_seconds <= self.window_seconds < float("inf") or not self.floor_dbfs < 0:
            raise ValueError("0 < hop <= window and floor < 0")


@dataclass(frozen=True)
class Silence:
    loudness: Loudness = Loudness()
    threshold_dbfs: float = -50.0
    minimum_seconds: float = 0.2
    merge_gap_seconds: float = 0.1
    hysteresis_db: float = 3.0

    def __post_init__(self):
        if not self.loudness.floor_dbfs <= self.threshold_dbfs < 0 or self.hysteresis_db < 0 or self.threshold_dbfs + self.hysteresis_db > 0:
            raise ValueError("floor <= threshold < 0 and threshold + hysteresis <= 0")


@dataclass(frozen=True)
class Beats:
    loudness: Loudness = Loudness(0.020, 0.010)
    history_seconds: float = 0.5
    deviations: float = 1.5
    minimum_db: float = 3.0
    refractory_seconds: float = 0.12


def duration_to_frames(seconds: float, rate: int, count: Column) -> Column:
    """All frames if the duration covers them, else at least one; none of nothing."""
    frames = seconds * rate
    return F.when(count == 0, 0).when(F.lit(frames) >= count, count).otherwise(max(int(frames + 0.5), 1)).cast("long")


def dbfs(mean_square: Column, floor: float) -> Column:
    raw = 10.0 * F.log10(mean_square)
    level = F.when(F.isnan(raw) | (F.abs(raw) == float("inf")), 0.0).otherwise(F.greatest(F.lit(floor), F.least(raw, F.lit(0.0))))
    return F.when(mean_square <= 0, floor).otherwise(level).cast("float")


def energy_windows(pcm: DataFrame, config: Loudness, rate: int) -> DataFrame:
    """media_id, win, start_frame, end_frame, mean_square, frames (of the medium) and full (whether not cut short)."""
    size = pcm.groupBy("media_id").agg((F.max("frame") + 1).alias("frames"), F.max("ch").alias("channels"))
    w, h = duration_to_frames(config.window_seconds, rate, F.col("frames")), duration_to_frames(config.hop_seconds, rate, F.col("frames"))
    square = F.col("sample").cast("double") * F.col("sample").cast("double")
    by_frame = pcm.select("media_id", "frame", square.alias("sq")).join(size.select("media_id", "frames", w.alias("w"), h.alias("h")), "media_id")
    last = F.floor(F.col("frame") / F.col("h"))
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - F.col("w")) / F.col("h")) + 1)
    dealt = by_frame.select("media_id", "sq", "frames", "w", "h", F.explode(F.sequence(first, last)).alias("win"))
    out = dealt.groupBy("media_id", "win").agg(F.sum("sq").alias("sum"), F.count("*").alias("n"), F.first("frames").alias("frames"), F.first("w").alias("w"), F.first("h").alias("h"))
    start = F.col("win") * F.col("h")
    end = F.least(start + F.col("w"), F.col("frames"))
    return out.select("media_id", "win", start.alias("start_frame"), end.alias("end_frame"), (F.col("sum") / F.col("n")).alias("mean_square"), "frames", "h", (end - start >= F.col("w")).alias("full"))


def loudness_contour(pcm: DataFrame, config: Loudness, rate: int) -> DataFrame:
    w = energy_windows(pcm, config, rate)
    return w.select("media_id", "win", (F.col("start_frame") / rate).alias("start_seconds"), (F.col("end_frame") / rate).alias("end_seconds"), dbfs(F.col("mean_square"), config.floor_dbfs).alias("dbfs"))


def merge_islands(spans: DataFrame, key: str, gap: float, least: float) -> DataFrame:
    """key, a and b: spans (key, a, b) that don't overlap, joined where they are at most ``gap`` apart; then those shorter
    than ``least`` go."""
    by_start = Window.partitionBy(key).orderBy("a")
    numbered = spans.withColumn("_new", F.when(F.col("a") - F.lag("b").over(by_start) <= gap, 0).otherwise(1))
    island = F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    merged = numbered.withColumn("_island", island).groupBy(key, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.where(F.col("b") - F.col("a") >= least).drop("_island")


def detect_silence(pcm: DataFrame, config: Silence, rate: int) -> DataFrame:
    """media_id, start_seconds and end_seconds of silence: entered at the threshold, left above threshold plus
    hysteresis; short gaps are merged before short spans go."""
    w = energy_windows(pcm, config.loudness, rate)
    level = dbfs(F.col("mean_square"), config.loudness.floor_dbfs)
    by_time = Window.partitionBy("media_id").orderBy("win")
    # a window between the two thresholds is as the one before it
    says = F.when(level <= config.threshold_dbfs, 1).when(level > config.threshold_dbfs + config.hysteresis_db, 0)
    state = F.coalesce(F.last(says, ignorenulls=True).over(by_time.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    marked = w.withColumn("silent", state).withColumn("turn", F.col("silent") != F.lag("silent", 1, 0).over(by_time))
    turns = marked.where("turn").select("media_id", "win", "silent", "start_frame", "frames")
    closed = turns.withColumn("end_frame", F.coalesce(F.lead("start_frame").over(by_time), "frames")).where("silent = 1")
    merged = merge_islands(closed.select("media_id", F.col("start_frame").alias("a"), F.col("end_frame").alias("b")), "media_id", config.merge_gap_seconds * rate, config.minimum_seconds * rate)
    return merged.select("media_id", (F.col("a") / rate).alias("start_seconds"), (F.col("b") / rate).alias("end_seconds"))


def onset_flux(pcm: DataFrame, config: Loudness, rate: int) -> DataFrame:
    """Whole windows with flux: by how much each is louder than the one before, 0 for the first and where it isn't."""
    by_time = Window.partitionBy("media_id").orderBy("win")
    w = energy_windows(pcm, config, rate).where("full").withColumn("db", dbfs(F.col("mean_square"), config.floor_dbfs))
    rise = F.greatest(F.col("db") - F.lag("db").over(by_time), F.lit(0.0).cast("float"))
    return w.withColumn("flux", F.coalesce(rise, F.lit(0.0).cast("float")).cast("double"))


def onset_candidates(pcm: DataFrame, config: Beats, rate: int) -> DataFrame:
    """media_id, win, end_frame, flux and threshold of windows whose rise reaches the threshold of the local history."""
    rise = onset_flux(pcm, config.loudness, rate)
    by_time = Window.partitionBy("media_id").orderBy("win")
    # a medium shorter than the history has fewer windows than that, so one length serves all
    most = max(1, -(-max(int(config.history_seconds * rate + 0.5), 1) // max(int(config.loudness.hop_seconds * rate + 0.5), 1)))
    past = by_time.rowsBetween(-most, -1)
    mean = F.avg("flux").over(past)
    spread = F.sqrt(F.greatest(F.avg(F.col("flux") * F.col("flux")).over(past) - mean * mean, F.lit(0.0)))
    threshold = F.greatest(F.coalesce(mean + config.deviations * spread, F.lit(0.0)), F.lit(config.minimum_db))
    return rise.withColumn("threshold", threshold).where("flux >= threshold").select("media_id", "win", "end_frame", "flux", "threshold")


def detect_beats(pcm: DataFrame, config: Beats, rate: int) -> DataFrame:
    """media_id, time_seconds and strength_db of onsets, each at least the refractory time after the one before."""
    kept = greedy_gate(onset_candidates(pcm, config, rate), "media_id", "end_frame", config.refractory_seconds * rate, "flux")
    return kept.select("media_id", (F.col("end_frame") / rate).alias("time_seconds"), F.col("flux").alias("strength_db"))


def peaks(pcm: DataFrame, chunk: int) -> DataFrame:
    """The largest size of a sample, at most 1, in every chunk of frames."""
    size = F.least(F.abs(F.col("sample")), F.lit(1.0).cast("float"))
    return pcm.groupBy("media_id", F.floor(F.col("frame") / chunk).alias("chunk")).agg(F.max(size).alias("peak"))


def rebucket(peaks_: DataFrame, buckets: int) -> DataFrame:
    """Peaks of every medium in a fixed number of buckets; neighbours share a chunk where it doesn't divide evenly."""
    n = peaks_.groupBy("media_id").agg((F.max("chunk") + 1).alias("n"))
    all_ = peaks_.join(n, "media_id")
    # chunk c lies in bucket b if floor(b n / B) <= c < max(ceil((b + 1) n / B), start + 1)
    first = F.greatest(F.lit(0), F.floor(F.col("chunk") * buckets / F.col("n")) - 1)
    last = F.least(F.lit(buckets - 1), F.ceil((F.col("chunk") + 1) * buckets / F.col("n")))
    spread = all_.withColumn("bucket", F.explode(F.sequence(first, last)))
    a = F.floor(F.col("bucket") * F.col("n") / buckets)
    b = F.greatest(F.ceil((F.col("bucket") + 1) * F.col("n") / buckets), a + 1)
    return spread.where((F.col("chunk") >= a) & (F.col("chunk") < b)).groupBy("media_id", "bucket").agg(F.max("peak").alias("peak"))


def fade_gain(pos: Column, length: Column, volume: Column, fade_in: Column, fade_out: Column) -> Column:
    """Volume with linear ramps at both ends of a span."""
    up = F.when((fade_in > 0) & (pos < fade_in), F.greatest(pos, F.lit(0)) / fade_in).otherwise(1.0)
    down = F.when((fade_out > 0) & (length - pos < fade_out), F.greatest(length - pos, F.lit(0)) / fade_out).otherwise(1.0)
    return volume * up * down


def pan_gains(pan: Column) -> tuple[Column, Column]:
    """Constant power, unity in the middle."""
    angle = (pan + 1.0) * (3.141592653589793 / 4)
    return F.cos(angle) * 2**0.5, F.sin(angle) * 2**0.5


#: Frames of a page of sums, and pages that a task holds before it hands them on.
_PAGE, _PAGES = 64, 1 << 15


def _packed() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """media_id, _b, _low, _a and _has of ``_blocks`` -> the same with _s, the samples' bytes, and _h, for each 0 where it lacks, 1 where it is null, else 2; null
    where all are 2. A cut from bytes goes to Python as it is, where a list would be written anew."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: tuple[list, list] = ([], [])
            for samples, has in zip(batch.column(3), batch.column(4), strict=True):
                own, there = samples.values, has.values.to_numpy(zero_copy_only=False)
                marks = there + (there & own.is_valid().to_numpy(zero_copy_only=False)).astype(np.uint8)
                done[0].append(own.fill_null(0.0).to_numpy(zero_copy_only=False).tobytes())
                done[1].append(None if (marks == 2).all() else marks.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(d, pa.binary()) for d in done)], names=["media_id", "_b", "_low", "_s", "_h"])

    return pack


def _sums() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """_at, _pos, length, volume, fade_in, fade_out, _left, _right, _s and _h (of ``_packed``, from _pos on) -> page, left, right and seen: sums over what a task has met, a row for each page of frames. Pages are bounded in number."""
    page, pages = _PAGE, _PAGES
    nowhere = np.iinfo(np.int64).min  # the frame of what has none

    def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all values, one after the other, and how many each has."""
        column = column.cast(pa.large_binary())
        _, offsets, data = column.buffers()
        ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        return (np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)), np.diff(ends)

    def numbers(column: pa.Array, null: float) -> np.ndarray:
        return column.cast(pa.float64()).fill_null(null).to_numpy(zero_copy_only=False)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots: dict[int, int] = {}
        sums, seen = np.zeros((2, 0)), np.zeros(0, np.int8)

        def handed() -> pa.RecordBatch:
            own = np.fromiter(slots, np.int64, len(slots))
            size = len(own) * page
            cut = [pa.FixedSizeBinaryArray.from_buffers(pa.binary(n), len(own), [None, pa.py_buffer(np.ascontiguousarray(v[:size]))]).cast(pa.binary()) for v, n in ((sums[0], 8 * page), (sums[1], 8 * page), (seen, page))]
            return pa.RecordBatch.from_arrays([pa.array(own, mask=own == nowhere), *cut], names=["page", "left", "right", "seen"])

        for batch in batches:
            if not batch.num_rows:
                continue
            at, pos, length, volume, up, down, left, right = (batch.column(k) for k in range(8))
            flat, n = raw(batch.column(8))
            flat, n = flat.view(np.float64), n // 8
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            there = np.full(len(row), 2, np.uint8)
            marks = batch.column(9)
            if marks.null_count < len(marks):
                there[np.repeat(marks.is_valid().to_numpy(zero_copy_only=False), n)] = raw(marks)[0]
            whole, given = there > 0, there == 2
            # as fade_gain has it
            p, size, rise, fall = pos.to_numpy()[row] + k, length.to_numpy()[row], numbers(up, 0)[row], numbers(down, 0)[row]
            gain = numbers(volume, np.nan)[row] * np.divide(np.maximum(p, 0), rise, out=np.ones(len(row)), where=(rise > 0) & (p < rise))
            gain *= np.divide(np.maximum(size - p, 0), fall, out=np.ones(len(row)), where=(fall > 0) & (size - p < fall))
            value = flat * gain
            given &= (volume.is_valid().to_numpy(zero_copy_only=False) & left.is_valid().to_numpy(zero_copy_only=False))[row]
            # the pages that each row meets
            low = at.fill_null(0).to_numpy()
            first, last = low // page, (low + n - 1) // page
            lost = at.is_null().to_numpy(zero_copy_only=False)
            met = np.where(n > 0, last - first + 1, 0)
            start = np.cumsum(met) - met
            pair = np.repeat(np.arange(len(n)), met)
            asked = np.where(lost[pair], nowhere, first[pair] + np.arange(len(pair)) - start[pair])
            different, which = np.unique(asked, return_inverse=True)
            if len(slots) + len(different) > pages and slots:
                yield handed()
                slots, sums, seen = {}, np.zeros((2, 0)), np.zeros(0, np.int8)
            slot = np.array([slots.setdefault(x, len(slots)) for x in different.tolist()], np.int64)
            if len(slots) * page > len(seen):
                more = max(len(slots), min(2 * len(seen) // page, pages)) * page - len(seen)
                sums, seen = np.concatenate([sums, np.zeros((2, more))], axis=1), np.concatenate([seen, np.zeros(more, np.int8)])
            frame = low[row] + k
            place = slot[which[start[row] + np.where(lost[row], 0, frame // page - first[row])]] * page + np.where(lost[row], 0, frame % page)
            seen[place[whole]] |= 1
            place, value, row = place[given], value[given], row[given]
            seen[place] |= 2
            np.add.at(sums[0], place, value * numbers(left, 0)[row])
            np.add.at(sums[1], place, value * numbers(right, 0)[row])
        if slots:
            yield handed()

    return add


def _met() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """page, left, right and seen, in order of their pages -> frame, left and right: the sums of equal pages, null where all that were added are null."""
    page = _PAGE

    def laid(first: int | None, left: np.ndarray, right: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        where = np.flatnonzero(seen)
        frame = pa.nulls(len(where), pa.int64()) if first is None else pa.array(first * page + where)
        none = seen[where] == 1
        return pa.RecordBatch.from_arrays([frame, pa.array(left[where], mask=none), pa.array(right[where], mask=none)], names=["frame", "left", "right"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            own = batch.column(0)
            left, right, seen = (np.frombuffer(b"".join(batch.column(k).to_pylist()), kind).reshape(rows, page) for k, kind in ((1, np.float64), (2, np.float64), (3, np.int8)))
            keys, none = own.fill_null(0).to_numpy(), own.is_null().to_numpy(zero_copy_only=False)
            heads = np.flatnonzero(np.r_[True, (np.diff(keys) != 0) | np.diff(none)])
            sums = np.add.reduceat(left, heads), np.add.reduceat(right, heads), np.bitwise_or.reduceat(seen, heads)
            done = []
            for k, head in enumerate(heads.tolist()):
                now = (None if none[head] else int(keys[head]), *(s[k] for s in sums))
                if last is not None and last[0] == now[0]:
                    now = (now[0], last[1] + now[1], last[2] + now[2], last[3] | now[3])
                elif last is not None:
                    done.append(laid(*last))
                last = now
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if last is not None:
            yield laid(*last)

    return add


def mix(spans: DataFrame, pcm: DataFrame, bucket: int = 1024) -> DataFrame:
    """frame, left and right: the sum of all spans' samples with gain and pan, clamped to -1..1.

    spans: media_id, at (first frame of the output), first (of the medium), length, volume, pan, fade_in, fade_out. Spans meet blocks
    of ``bucket`` frames, and their samples are added up over arrays in the task that meets them. So spans and blocks are shuffled, and sums, no row for
    each sample."""
    block = lambda frame: F.floor(frame / bucket)
    left, right = pan_gains(F.col("pan"))
    met = F.sequence(block(F.col("first")), block(F.col("first") + F.col("length") - 1))
    asked = spans.where("length > 0").select("media_id", "at", "first", "length", "volume", "fade_in", "fade_out", left.alias("_left"), right.alias("_right"), F.explode(met).alias("_b"))
    # samples at one frame of a medium count together
    rows = pcm.where("ch = 0").select("media_id", "frame", F.col("sample").cast("double").alias("sample")).groupBy("media_id", "frame").agg(F.sum("sample").alias("sample"))
    laid = _blocks(rows.withColumn("ch", F.lit(0)), bucket)
    kinds = {f.name: f.dataType for f in laid.schema.fields}
    kinds = T.StructType([*(T.StructField(n, kinds[n]) for n in ("media_id", "_b", "_low")), T.StructField("_s", T.BinaryType()), T.StructField("_h", T.BinaryType())])
    blocks = laid.mapInArrow(_packed(), kinds)
    since = F.greatest(F.col("first"), F.col("_b") * bucket, F.col("_low"))
    until = F.least(F.col("first") + F.col("length"), (F.col("_b") + 1) * bucket, F.col("_low") + F.length("_s") / 8)
    each = asked.join(blocks, ["media_id", "_b"]).withColumns({"_since": since.cast("long"), "_until": until.cast("long")}).where("_since < _until")
    part = lambda c, n: F.substring(c, ((F.col("_since") - F.col("_low")) * n + 1).cast("int"), ((F.col("_until") - F.col("_since")) * n).cast("int")).alias(c)
    pos = F.col("_since") - F.col("first")
    double = [F.col(c).cast("double").alias(c) for c in ("volume", "fade_in", "fade_out", "_left", "_right")]
    pieces = each.select((F.col("at") + pos).cast("long").alias("_at"), pos.cast("long").alias("_pos"), F.col("length").cast("long").alias("length"), *double, part("_s", 8), part("_h", 1))
    clamp = lambda c: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(c))).alias(c)
    pages = pieces.mapInArrow(_sums(), "page long, left binary, right binary, seen binary").repartition("page").sortWithinPartitions("page")
    return pages.mapInArrow(_met(), "frame long, left double, right double").select("frame", clamp("left"), clamp("right"))


def warped_frame(rel: Column, num: Column, den: Column) -> Column:
    """Source position, in frames, of an output sample at constant speed."""
    return rel.cast("double") * num / den


def warp_bounds(spans: DataFrame, block: int) -> DataFrame:
    """span_id, block, low and high: the source frames that each block of a span's output needs (spans: span_id, length,
    num, den). Speeds are positive, so a block's first and last frame bound it."""
    blocks = spans.where("length > 0").select("span_id", "length", "num", "den", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block))).alias("block"))
    first, last = F.col("block") * block, F.least((F.col("block") + 1) * block, F.col("length")) - 1
    low, high = F.floor(warped_frame(first, F.col("num"), F.col("den"))), F.ceil(warped_frame(last, F.col("num"), F.col("den"))) + 1
    return blocks.select("span_id", "block", low.alias("low"), high.alias("high"))


def _blocks(pcm: DataFrame, bucket: int) -> DataFrame:
    """media_id, _b, _low, _a and _has: the samples of each ``bucket`` frames and the one after them, from frame _low on; _has is false where a
    frame lacks."""
    rows = pcm.where("ch = 0").select("media_id", "frame", "sample").withColumn("_b", F.floor(F.col("frame") / bucket))
    edge = rows.where(F.col("frame") % bucket == 0).withColumn("_b", F.col("_b") - 1)
    gap = F.lead("frame").over(Window.partitionBy("media_id", "_b").orderBy("frame")) - F.col("frame") - 1
    each = rows.unionByName(edge).withColumn("_gap", F.coalesce(gap, F.lit(0)).cast("int"))
    held = each.groupBy("media_id", "_b").agg(F.array_sort(F.collect_list(F.struct("frame", "sample", "_gap"))).alias("_all"))

    def laid(value: Callable[[Column], Column], none: Column) -> Column:
        return F.flatten(F.transform("_all", lambda x: F.concat(F.array(value(x)), F.array_repeat(none, x["_gap"]))))

    sample = laid(lambda x: x["sample"], F.lit(None).cast(pcm.schema["sample"].dataType))
    return held.select("media_id", "_b", F.col("_all")[0]["frame"].alias("_low"), sample.alias("_a"), laid(lambda x: F.lit(True), F.lit(False)).alias("_has"))


def resample(spans: DataFrame, pcm: DataFrame, bucket: int = 4096) -> DataFrame:
    """span_id, rel and value: the samples of spans (span_id, media_id, first, length, num, den) at a speed, each between
    the two source frames around it; the last frame stands for one beyond it.

    Spans meet blocks of ``bucket`` frames, and each block gives its part of a span's samples. So what is shuffled is spans and blocks, not a
    row for each sample."""
    block = lambda frame: F.floor(frame / bucket)
    last = F.col("first") + F.floor(warped_frame(F.col("length") - 1, F.col("num"), F.col("den")))
    met = F.sequence(block(F.least("first", last)), block(F.greatest("first", last)))
    asked = spans.where("length > 0").select("span_id", "media_id", "first", "length", "num", "den", F.explode(met).alias("_b"))
    # the outputs that a block can have, and one more at both ends against rounding
    ends = [(edge * bucket - F.col("first")).cast("double") * F.col("den") / F.nullif(F.col("num"), F.lit(0)) for edge in (F.col("_b"), F.col("_b") + 1)]
    low, high = F.coalesce(F.floor(F.least(*ends)) - 1, F.lit(0)), F.coalesce(F.ceil(F.greatest(*ends)) + 1, F.col("length"))
    low, high = F.greatest(low, F.lit(0)).cast("long"), F.least(high, F.col("length") - 1).cast("long")
    rel = F.explode(F.when(low <= high, F.sequence(low, high)))
    each = asked.join(_blocks(pcm, bucket), ["media_id", "_b"]).withColumn("rel", rel)
    at = warped_frame(F.col("rel"), F.col("num"), F.col("den"))
    frame = F.col("first") + F.floor(at)
    k = (frame - F.col("_low")).cast("int")
    a = F.get("_a", k).cast("double")
    b = F.coalesce(F.get("_a", k + 1).cast("double"), a)
    return each.where((block(frame) == F.col("_b")) & F.get("_has", k)).select("span_id", "rel", (a + (b - a) * (at - F.floor(at))).alias("value"))


def realized_rate(per_second: Column, most: int, chunks: Column, rate: int = 48_000) -> Column:
    """Peaks a second that chunks of whole samples give, less if there were more than may be kept."""
    chunk = F.greatest(F.lit(1).cast("long"), F.floor(rate / per_second + 0.5))
    return rate / chunk * F.when(chunks <= most, 1.0).otherwise(most / chunks)
