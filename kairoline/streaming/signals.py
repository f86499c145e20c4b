"""Streaming forms: windows over event time, and shot boundaries with state of constant size.

``events.ts`` has no time zone and counts as UTC, whatever the session's zone is; watermarks need a timestamp.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.shots import Config


def _event_time() -> Column:
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts").cast("timestamp_ntz")).cast("timestamp")


def windowed(events: DataFrame, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Events of each type in tumbling (or sliding) windows; later ones than the delay are dropped."""
    own = events.withColumn("at", _event_time()).withWatermark("at", delay)
    window = F.window("at", size, slide) if slide else F.window("at", size)
    return own.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "peak")


def sessions(events: DataFrame, gap: str, delay: str = "1 hour") -> DataFrame:
    """Runs of a user's events without a longer pause than the gap."""
    own = events.withColumn("at", _event_time()).withWatermark("at", delay)
    return own.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def shot_boundaries(scored: DataFrame, config: Config, arrival: str = "t") -> DataFrame:
    """Boundaries of a stream of scored frames (media_id, t, previous_t, score, kind and start, the first frame's time).

    ``arrival`` names the column that numbers frames as they came, as a shuffle doesn't keep their order. State is
    the start of the medium's shot and the last frame's time. A frame earlier than the one that came before it raises, within a
    batch too, and leaves the state as it was; equal times are fine. The result is that of the batch operator."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last = state.get if state.exists else (None, None)
        rows = pd.concat(list(frames)).sort_values(arrival, kind="stable")
        t = rows["t"].to_numpy(float)
        before = np.append(t[0] if last is None else last, t[:-1])
        if (early := np.nonzero(t < before)[0]).size:
            raise ValueError(f"frame at {t[early[0]]} after {before[early[0]]}")
        since = float(rows["start"].iloc[0]) if since is None else since
        kept = []
        for i in np.nonzero(rows["score"].to_numpy() >= np.float32(config.threshold))[0]:
            if t[i] - since >= config.minimum_seconds:
                kept.append(i)
                since = float(t[i])
        state.update((since, float(t[-1])))
        out = rows.iloc[kept]
        yield pd.DataFrame({"media_id": [key[0]] * len(out), "t": out["t"], "previous_t": out["previous_t"], "score": out["score"], "kind": out["kind"]})

    kind = scored.schema["media_id"].dataType.simpleString()
    return scored.groupBy("media_id").applyInPandasWithState(step, f"media_id {kind}, t double, previous_t double, score float, kind string", "since double, last double", "append", GroupStateTimeout.NoTimeout)


def frame_features(frames: DataFrame, config: Config, arrival: str = "t") -> DataFrame:
    """media_id, arrival, t, width, height, n, luma_sum, hist and sampled (four bytes a pixel, by y and x) of frames
    (media_id, t, width, height and rgba, four bytes a pixel). Frames without a time, a size or bytes are left out; bytes
    that don't fit the size raise. Works on streams and tables; only features go on to a shuffle."""
    columns, lines, bins = config.columns, config.rows, config.bins
    kind, came = frames.schema["media_id"].dataType.simpleString(), frames.schema[arrival].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for w, h, data in zip(batch["width"].to_pylist(), batch["height"].to_pylist(), batch["rgba"], strict=True):
                flat = np.frombuffer(data.as_buffer(), np.uint8)
                if len(flat) != w * h * 4:
                    raise ValueError(f"{len(flat)} bytes for a frame of {w} by {h}")
                nx, ny = min(w, columns), min(h, lines)
                x, y = (2 * np.arange(nx) + 1) * w // (2 * nx), (2 * np.arange(ny) + 1) * h // (2 * ny)
                some = flat.reshape(h, w, 4)[np.ix_(y, x)].reshape(-1, 4)
                luma = some[:, :3].astype(np.int64) @ np.array([77, 150, 29]) + 128 >> 8
                found.append((len(some), int(luma.sum()), np.bincount(luma * bins // 256, minlength=bins), some.tobytes()))
            n, total, hist, sampled = zip(*found, strict=True) if found else ((), (), (), ())
            own = [batch[c] for c in ("media_id", "_a", "t", "width", "height")]
            rest = [pa.array(n, pa.int64()), pa.array(total, pa.int64()), pa.array(hist, pa.list_(pa.int64())), pa.array(sampled, pa.binary())]
            yield pa.RecordBatch.from_arrays(own + rest, ["media_id", "arrival", "t", "width", "height", "n", "luma_sum", "hist", "sampled"])

    whole = frames.select("media_id", F.col(arrival).alias("_a"), F.col("t").cast("double").alias("t"), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"), "rgba")
    whole = whole.where("t IS NOT NULL AND width > 0 AND height > 0 AND rgba IS NOT NULL")
    return whole.mapInArrow(scan, f"media_id {kind}, arrival {came}, t double, width int, height int, n long, luma_sum long, hist array<long>, sampled binary")


def shots_of_frames(frames: DataFrame, config: Config, arrival: str = "t") -> DataFrame:
    """Boundaries (media_id, t, previous_t, score, kind) of a stream of frames as ``frame_features`` takes them.

    State is the features of a medium's last frame and the start of its shot, so it doesn't grow, and a frame is scored
    against the one before it in whatever micro-batch that came. ``arrival`` numbers frames as they came; one earlier than
    the one before it raises and leaves the state as it was. Frames of one time are frames of their own. Cut into micro-batches anyhow,
    the result is that of ``shots.detect_shots``, scores included, as sums are taken in its order."""
    columns = ["t", "width", "height", "n", "luma_sum", "hist", "sampled"]

    def score(p: tuple, q: tuple) -> tuple[np.float32, str]:
        _, w, h, n, luma, hist, sampled = q
        if (w, h) != p[1:3]:
            return np.float32(1), "dimension"
        moved = int(np.abs(np.cumsum(np.asarray(hist, np.int64) - np.asarray(p[5], np.int64))[:-1]).sum()) / (n * (config.bins - 1))
        a, b = (np.frombuffer(x, np.uint8).reshape(-1, 4).astype(float) for x in (p[6], sampled))
        colours = np.abs(b[:, :3] - a[:, :3] - (luma - p[4]) / float(n))
        change = colours[:, 0] + colours[:, 1] + colours[:, 2] + np.abs(b[:, 3] - a[:, 3])
        # a running sum adds one by one
        pixels = min(1.0, max(0.0, float(np.cumsum(change)[-1]) / (n * 4.0 * 255)))
        mixed = (config.histogram_weight * moved + config.pixel_weight * pixels) / (config.histogram_weight + config.pixel_weight)
        return np.float32(min(1.0, max(0.0, mixed))), "visual"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, *before = state.get if state.exists else (None,)
        last = tuple(before) or None
        rows = pd.concat(list(parts)).sort_values("arrival", kind="stable")
        kept = []
        for now in rows[columns].itertuples(index=False, name=None):
            if last is None:
                since = now[0]
            elif now[0] < last[0]:
                raise ValueError(f"frame at {now[0]} after {last[0]}")
            else:
                value, kind = score(last, now)
                if value >= np.float32(config.threshold) and now[0] - since >= config.minimum_seconds:
                    kept.append((key[0], now[0], last[0], value, kind))
                    since = now[0]
            last = now
        t, w, h, n, luma, hist, sampled = last
        state.update((float(since), float(t), int(w), int(h), int(n), int(luma), [int(x) for x in hist], bytes(sampled)))
        yield pd.DataFrame(kept, columns=["media_id", "t", "previous_t", "score", "kind"])

    feats = frame_features(frames, config, arrival)
    kind = feats.schema["media_id"].dataType.simpleString()
    kept = "since double, t double, width int, height int, n long, luma_sum long, hist array<long>, sampled binary"
    return feats.groupBy("media_id").applyInPandasWithState(step, f"media_id {kind}, t double, previous_t double, score float, kind string", kept, "append", GroupStateTimeout.NoTimeout)


def latest(requests: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key's requests the last by ``order``: what a preview still has to draw when many have piled up."""
    return requests.groupBy(*keys).agg(F.max_by(F.struct(*requests.columns), F.col(order)).alias("_r")).select("_r.*")


def coalesced(requests: DataFrame, keys: list[str], order: str, sink, checkpoint: str, edits: Column | None = None):
    """A writer of a stream of requests that hands each micro-batch's latest requests to ``sink`` (a function of a DataFrame
    and the batch's number). Rows for which ``edits`` holds are never dropped: they come along, all of them."""

    def each(batch: DataFrame, number: int) -> None:
        keep = F.lit(False) if edits is None else F.coalesce(edits, F.lit(False))
        plain = latest(batch.where(~keep), keys, order)
        sink(plain if edits is None else plain.unionByName(batch.where(keep)), number)

    return requests.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
