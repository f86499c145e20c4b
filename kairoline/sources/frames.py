"""Folders of frames as a Spark data source: ``frame_00000.png`` and, for frames with sound, ``frame_00000.f32``.

    register(spark)
    frames.write.format("frame_folder").mode("overwrite").save("hdfs://.../out")
    spark.read.format("frame_folder").load("hdfs://.../out")

Rows are frame, width, height, rgba (bytes by row) and sound (32-bit floats, left and right in turn, or null). Each task writes to a folder of its own
beside the target. The commit moves the files of the tasks that count into one folder and puts that in the target's place, in one step where the
file system renames folders; failed, repeated and cancelled tasks leave nothing, and until the commit the target is as it was. ``written`` counts
the frames written so far. A frame number that comes twice fails the job, as does a target that isn't empty without ``overwrite``.

Paths are any that pyarrow's file systems know; on a cluster it must be one that all machines share.
"""

from __future__ import annotations

import contextlib
import re
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .media import encode_png

SCHEMA = "frame long, width int, height int, rgba binary, sound binary"
_NAME = re.compile(r"frame_(\d{5,})\.png\Z")
#: Frames that one task reads.
LOT = 64


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    system, root = pafs.FileSystem.from_uri(path) if re.match(r"[a-z][a-z0-9+.-]*:", path) else (pafs.LocalFileSystem(), path)
    return system, root.rstrip("/")


def _staged(path: str) -> list[tuple[pafs.FileSystem, str]]:
    system, root = _place(path)
    parent, _, name = root.rpartition("/")
    listed = system.get_file_info(pafs.FileSelector(parent or "/", allow_not_found=True))
    return [(system, f.path) for f in listed if f.base_name.startswith(f"{name}.staging-")]


def written(path: str) -> int:
    """Frames that the running export to a path has written so far."""
    return sum(1 for system, folder in _staged(path) for f in system.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if _NAME.match(f.base_name))


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    frames: int


class _FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, columns: list[str], overwrite: bool):
        missing = {"frame", "width", "height", "rgba"} - set(columns)
        if missing:
            raise ValueError(f"frames lack {sorted(missing)}")
        self.path, self.overwrite = path, overwrite
        self.token = uuid.uuid4().hex
        # made here alone: tasks that outlive an abort find it gone and can't make it anew
        system, _, staging = self._folders
        system.create_dir(staging, recursive=True)

    @property
    def _folders(self) -> tuple[pafs.FileSystem, str, str]:
        system, root = _place(self.path)
        return system, root, f"{root}.staging-{self.token}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, _, staging = self._folders
        task = TaskContext.get()
        folder = f"{staging}/task-{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(folder, recursive=False)
        n = 0
        for batch in iterator:
            for row in batch.to_pylist():
                pixels = np.frombuffer(row["rgba"], np.uint8).reshape(row["height"], row["width"], 4)
                self._put(system, f"{folder}/frame_{row['frame']:05d}.png", encode_png(pixels))
                if row.get("sound") is not None:
                    self._put(system, f"{folder}/frame_{row['frame']:05d}.f32", row["sound"])
                n += 1
        return _Written(folder, n)

    @staticmethod
    def _put(system: pafs.FileSystem, path: str, data: bytes) -> None:
        if system.get_file_info(path).type != pafs.FileType.NotFound:
            raise ValueError(f"{path.rpartition('/')[2]} comes twice")
        with system.open_output_stream(path) as out:
            out.write(data)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root, staging = self._folders
        info = system.get_file_info(root)
        empty = info.type == pafs.FileType.NotFound or info.type == pafs.FileType.Directory and not system.get_file_info(pafs.FileSelector(root))
        if not empty and not self.overwrite:
            raise FileExistsError(f"{self.path} isn't empty")
        final = f"{staging}/frames"
        system.create_dir(final, recursive=True)
        seen: set[str] = set()
        for message in messages:
            for f in system.get_file_info(pafs.FileSelector(message.folder)) if message else ():
                if f.base_name in seen:
                    raise ValueError(f"{f.base_name} comes twice")
                seen.add(f.base_name)
                system.move(f.path, f"{final}/{f.base_name}")
        if info.type != pafs.FileType.NotFound:
            system.move(root, f"{staging}/replaced")
        system.move(final, root)
        system.delete_dir(staging)

    def abort(self, messages: list[_Written | None]) -> None:
        system, _, staging = self._folders
        for _ in range(20):  # a task that is being stopped may put a file into a folder while it goes
            if system.get_file_info(staging).type == pafs.FileType.NotFound:
                break
            with contextlib.suppress(OSError):
                system.delete_dir(staging)
            time.sleep(0.05)


@dataclass
class _Lot(InputPartition):
    paths: list[str]


class _FrameReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_Lot]:
        system, root = _place(self.path)
        names = sorted(f.path for f in system.get_file_info(pafs.FileSelector(root)) if _NAME.match(f.base_name))
        return [_Lot(names[i : i + LOT]) for i in range(0, len(names), LOT)] or [_Lot([])]

    def read(self, partition: _Lot) -> Iterator[tuple]:
        system, _ = _place(self.path)
        for path in partition.paths:
            with system.open_input_stream(path) as file:
                pixels = decode_png(file.read())
            sound = f"{path[:-4]}.f32"
            block = None
            if system.get_file_info(sound).type != pafs.FileType.NotFound:
                with system.open_input_stream(sound) as file:
                    block = file.read()
            height, width, _ = pixels.shape
            yield int(_NAME.search(path.rpartition("/")[2])[1]), width, height, pixels.tobytes(), block


class FrameFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _FrameReader:
        return _FrameReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> _FrameWriter:
        return _FrameWriter(self.options["path"], schema.names, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameFolder)


# Fixed value: the number of channels of each of the format's colour types that are read here.
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
#: Pixels that a picture may have, so that a small file can't fill a task's memory.
MAX_PIXELS = 1 << 27


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes with its filter undone."""
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    if kind not in (3, 4):
        raise ValueError("an unknown filter")
    out, up = bytearray(line.tobytes()), above.tobytes()
    for i, x in enumerate(out):
        a, b = out[i - step] if i >= step else 0, up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[i - step] if i >= step else 0
            pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
        out[i] = (x + guess) & 255
    return np.frombuffer(bytes(out), np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """Rows of RGBA bytes of a PNG file with 8 bits a channel: grey or colour, with or without alpha, not interlaced. Anything else,
    and a file that is cut short or damaged, raises."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG file")
    at, parts, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("a damaged PNG file")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if not head or head[2] != 8 or head[3] not in _CHANNELS or any(head[4:]):
        raise ValueError("a kind of PNG file that isn't read")
    width, height, channels = head[0], head[1], _CHANNELS[head[3]]
    if width * height > MAX_PIXELS:
        raise ValueError("a picture that is too large")
    stride = width * channels
    raw = zlib.decompressobj().decompress(b"".join(parts), height * (stride + 1))
    if len(raw) != height * (stride + 1):
        raise ValueError("a PNG file that is cut short")
    lines = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    above, rows = np.zeros(stride, np.uint8), []
    for line in lines:
        above = _unfiltered(int(line[0]), line[1:], above, channels)
        rows.append(above)
    pixels = np.stack(rows).reshape(height, width, channels) if height else np.zeros((0, width, channels), np.uint8)
    colour = pixels[..., :1].repeat(3, 2) if channels < 3 else pixels[..., :3]
    alpha = pixels[..., -1:] if channels in (2, 4) else np.full((height, width, 1), 255, np.uint8)
    return np.concatenate([colour, alpha], 2)
