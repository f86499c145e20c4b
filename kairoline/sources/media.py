"""Media files: content hashes, durations of MP4 containers, colour tables and picture sequences."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, modificationTime, length and content of every file below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def content_keys(found: DataFrame) -> DataFrame:
    return found.select("path", F.sha2("content", 256).alias("content_key"), "length")


def disk_usage(found: DataFrame) -> DataFrame:
    return found.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), F.count("*").alias("files"))


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the contents of each box in a range; a broken one ends it."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _find(data: bytes, start: int, end: int, *path: bytes) -> Iterator[tuple[int, int]]:
    for kind, a, b in _boxes(data, start, end):
        if kind == path[0]:
            if len(path) == 1:
                yield a, b
            else:
                yield from _find(data, a, b, *path[1:])


def _times(data: bytes, at: int) -> tuple[int, int]:
    """Time scale and duration of a movie or media header."""
    if data[at] == 1:
        scale, duration = struct.unpack_from(">IQ", data, at + 20)
    else:
        scale, duration = struct.unpack_from(">II", data, at + 12)
    return scale, duration


def mp4_seconds(data: bytes) -> float | None:
    """Seconds of a movie: its header's, or else the longest track's sum of fragments. A fragment's own default sample
    duration goes before the track's."""
    end = len(data)
    header = next(_find(data, 0, end, b"moov", b"mvhd"), None)
    if header is None:
        return None
    scale, duration = _times(data, header[0])
    if scale and duration and duration not in (0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF):
        return duration / scale
    scales, defaults, sums = {}, {}, {}
    for a, b in _find(data, 0, end, b"moov", b"trak"):
        head, media = next(_find(data, a, b, b"tkhd"), None), next(_find(data, a, b, b"mdia", b"mdhd"), None)
        if head and media:
            track = struct.unpack_from(">I", data, head[0] + (20 if data[head[0]] == 1 else 12))[0]
            scales[track] = _times(data, media[0])[0]
    for a, _ in _find(data, 0, end, b"moov", b"mvex", b"trex"):
        track, _, length = struct.unpack_from(">III", data, a + 4)
        defaults[track] = length
    for a, b in _find(data, 0, end, b"moof", b"traf"):
        head = next(_find(data, a, b, b"tfhd"), None)
        if head is None:
            continue
        flags, track = struct.unpack_from(">II", data, head[0])
        flags &= 0xFFFFFF
        at = head[0] + 8 + 8 * bool(flags & 1) + 4 * bool(flags & 2)
        length = struct.unpack_from(">I", data, at)[0] if flags & 8 else defaults.get(track, 0)
        for c, _ in _find(data, a, b, b"trun"):
            own, count = struct.unpack_from(">II", data, c)
            own &= 0xFFFFFF
            at = c + 8 + 4 * bool(own & 1) + 4 * bool(own & 4)
            width = 4 * sum(bool(own & f) for f in (0x100, 0x200, 0x400, 0x800))
            total = sum(struct.unpack_from(">I", data, at + i * width)[0] for i in range(count)) if own & 0x100 else count * length
            sums[track] = sums.get(track, 0) + total
    found = [sums[t] / scales[t] for t in sums if scales.get(t)]
    return max(found, default=None)


def mp4_durations(found: DataFrame) -> DataFrame:
    """path and seconds (null for what isn't a movie) of files."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for data in batch.column(1).to_pylist():
                try:
                    values.append(mp4_seconds(data or b""))
                except (struct.error, IndexError):
                    values.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["path", "seconds"])

    return found.select("path", "content").mapInArrow(scan, "path string, seconds double")


def cube_rows(spark: SparkSession, path: str) -> DataFrame:
    """path, size, i, r, g, b of .cube colour tables: i counts the rows in order. A size outside 2..65, a number of rows
    that isn't its cube or a value that isn't finite raises."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    size = F.regexp_extract(F.array_join("lines", "\n"), r"(?m)^\s*LUT_3D_SIZE\s+(\d+)\s*$", 1).cast("int")
    rows = F.filter("lines", lambda x: x.rlike(r"^\s*[-+0-9.]"))
    checked = lines.select("path", size.alias("size"), rows.alias("rows")).withColumn("rows", F.when(F.col("size").between(2, 65) & (F.size("rows") == F.pow("size", F.lit(3))), F.col("rows")).otherwise(F.raise_error(F.concat(F.lit("not a colour table: "), F.col("path")))))
    each = checked.select("path", "size", F.posexplode("rows").alias("i", "row")).withColumn("v", F.split(F.trim("row"), r"\s+"))
    value = lambda k: F.when(F.try_element_at("v", F.lit(k + 1)).try_cast("double").isNotNull(), F.try_element_at("v", F.lit(k + 1)).try_cast("double")).otherwise(F.raise_error(F.lit("a colour that isn't a number")))
    return each.select("path", "size", "i", *(value(k).alias(c) for k, c in enumerate("rgb")))


def encode_png(pixels: np.ndarray) -> bytes:
    """Rows of RGBA bytes as a PNG file."""
    height, width, _ = pixels.shape
    rows = b"".join(b"\0" + pixels[y].astype(np.uint8).tobytes() for y in range(height))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def png_frames(pixels: DataFrame) -> DataFrame:
    """media_id, name (frame_00000.png ...) and png of every frame of a pixel table (media_id, t, x, y, r, g, b, a).

    Pixels are sorted by frame and row within tasks and streamed: a task holds the bytes of one frame, and frames are numbered without
    their pixels."""
    from pyspark.sql import Window

    keys = ["media_id", "t"]
    numbers = pixels.select(*keys).distinct().withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("t")) - 1)

    def finished(key: tuple, held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        png = encode_png(rows[:, 1:].astype(np.uint8).reshape(-1, int(rows[:, 0].max()) + 1, 4))
        return pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([png], pa.binary())], [*keys, "png"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(k) for k in (0, 1)]
            changes = [pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in own]
            cuts = [0, *(np.flatnonzero(changes[0] | changes[1]) + 1).tolist(), batch.num_rows]
            rows = np.stack([batch.column(k).to_numpy() for k in range(2, 7)], 1)
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = (own[0][a], own[1][a])
                if held and here != key:
                    yield finished(key, held)
                    held = []
                key = here
                held.append(rows[a:b])
        if held:
            yield finished(key, held)

    ordered = pixels.where("media_id IS NOT NULL AND t IS NOT NULL").select(*keys, "y", *(F.col(c).cast("int").alias(c) for c in ("x", "r", "g", "b", "a"))).repartition(*keys).sortWithinPartitions(*keys, "y", "x").drop("y")
    kinds = ", ".join(f"{k} {pixels.schema[k].dataType.simpleString()}" for k in keys)
    pngs = ordered.mapInArrow(scan, f"{kinds}, png binary")
    return pngs.join(numbers, keys).select("media_id", F.format_string("frame_%05d.png", F.col("n")).alias("name"), "png")
