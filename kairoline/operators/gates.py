"""Greedy gates over events of any density: of a key's events, in order, those a least distance after the last one kept.

What is kept depends on all that came before, so a plain fold needs a key's events in one place. Here each key's time is cut
into cells of ``SPAN`` distances. A cell is a map from the last event kept before it to the last one kept in it, and only
events up to the first one a whole distance after the cell's first can be entered: a row for each of them. At the top the
last events kept are chained through the maps of a key's cells, and each cell then keeps its own events. So a task holds
one cell's events, or a key's maps: of a thousand million events with ten to a distance, 100,000 cells of some twenty rows. For keys beyond
that, ``levels`` join the maps of ``FAN`` neighbours to those of a larger cell before, and hand down what was kept after.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 1024
_FAN_BITS = 6
FAN = 1 << _FAN_BITS


def _tools(least: float) -> tuple[Callable, Callable]:
    """Functions that go to workers by value, which needn't have this package."""

    def due(at: np.ndarray, since: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first index from low up to high whose time is the distance after ``since``, else high; by halving."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high) // 2, 0)
            with np.errstate(invalid="ignore"):  # rows without anything left to look at may subtract infinities
                hit = at[mid] - since >= least
            high = np.where(open_ & hit, mid, high)
            low = np.where(open_ & ~hit, mid + 1, low)
        return high

    def bounds(*numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the first row of its run of equal numbers, and the row after its last."""
        first = np.ones(len(numbers[0]), bool)
        first[1:] = np.any([n[1:] != n[:-1] for n in numbers], axis=0)
        starts = np.flatnonzero(first)
        run = np.cumsum(first) - 1
        return starts[run], np.append(starts[1:], len(first))[run]

    return due, bounds


def _by_group(df: DataFrame, groups: list[str], order: list[str | Column], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work`` on rows sorted by groups and order: whole groups, many at once, with a number for each row's group."""

    def codes(rows: pa.Table) -> np.ndarray:
        changed = np.zeros(rows.num_rows, bool)
        for g in groups:
            own = rows.column(g).combine_chunks().dictionary_encode(null_encoding="encode")
            own = own.combine_chunks() if isinstance(own, pa.ChunkedArray) else own
            own = own.indices.to_numpy(zero_copy_only=False)
            changed[1:] |= own[1:] != own[:-1]
        return np.cumsum(changed)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # rows of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            ahead = [held[-1].slice(held[-1].num_rows - 1)] if held else []
            own = codes(pa.concat_tables([*ahead, rows]))
            cut = max(int(np.searchsorted(own, own[-1])) - len(ahead), 0)
            if own[-1] != own[0]:
                done = pa.concat_tables([*held, rows.slice(0, cut)]).combine_chunks()
                yield from work(done, codes(done)).to_batches()
                held = []
            held.append(rows.slice(cut))
        if held:
            done = pa.concat_tables(held).combine_chunks()
            yield from work(done, np.zeros(done.num_rows, np.int64)).to_batches()

    return df.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(scan, schema)


def greedy_gate(events: DataFrame, key: str, at: str, least: float, value: str, levels: int = 0) -> DataFrame:
    """Of each key's events, in order, those at least ``least`` after the last one kept: key, at (a double) and value.

    Of events at one time only the one with the smallest value can be kept (a null value stands behind all others); a
    distance of 0 or less keeps all. Events whose time is null, NaN or infinite are never kept. A null key is a key.
    ``levels`` (of ``FAN`` cells each) changes no row, only how many cells of a key meet at the top."""
    timed = events.select(F.col(key).alias("k"), F.col(at).cast("double").alias("at"), F.col(value).alias("value"))
    timed = timed.where("at > double('-infinity') AND at < double('infinity')")
    back = lambda df: df.select(F.col("k").alias(key), F.col("at").alias(at), F.col("value").alias(value))
    if not least > 0:
        return back(timed)
    once = timed.groupBy("k", "at").agg(F.min("value").alias("value"))
    cells = once.withColumn("cell", F.floor(F.col("at") / (least * SPAN)).cast("long"))
    kind, worth = cells.schema["k"].dataType.simpleString(), cells.schema["value"].dataType
    due, bounds = _tools(least)

    def numbers(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).to_numpy()

    def maps_of(rows: pa.Table, cell: str, which: np.ndarray, exits: np.ndarray) -> pa.Table:
        own = rows.select(["k", cell, "at"]).rename_columns(["k", "cell", "at"]).take(which)
        return own.append_column("exit", pa.array(exits, pa.float64()))

    def enterable(times: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Rows up to the first one the distance after their group's first."""
        return np.flatnonzero(np.arange(len(times)) <= due(times, times[start], start, end))

    def base(rows: pa.Table, codes: np.ndarray) -> pa.Table:
        start, end = bounds(codes)
        times = numbers(rows, "at")
        here = np.arange(len(times))
        then = due(times, times, here + 1, end)
        then = np.where(then < end, then, here)
        while ((further := then[then]) != then).any():
            then = further
        some = enterable(times, start, end)
        return maps_of(rows, "cell", some, times[then[some]])

    def merge(rows: pa.Table, codes: np.ndarray) -> pa.Table:
        start, end = bounds(codes)
        times, exits = numbers(rows, "at"), numbers(rows, "exit")
        _, child_end = bounds(codes, numbers(rows, "cell"))
        some = enterable(times, start, end)
        last, place, stop = exits[some], child_end[some], end[some]
        while (on := place < stop).any():
            upto = np.where(on, child_end[np.where(on, place, 0)], place)
            hit = due(times, last, place, upto)
            entered = hit < upto
            last = np.where(entered, exits[np.where(entered, hit, 0)], last)
            place = upto
        return maps_of(rows, "up", some, last)

    def entries(rows: pa.Table, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of groups with an entry row, which comes first: the row after it, the row after the last, and the entry's time."""
        start, end = bounds(codes)
        begin = np.flatnonzero((start == np.arange(len(start))) & numbers(rows, "entry"))
        return begin + 1, end[begin], numbers(rows, "at")[begin]

    def hand_down(rows: pa.Table, codes: np.ndarray) -> pa.Table:
        place, stop, last = entries(rows, codes)
        times, exits = numbers(rows, "at"), numbers(rows, "exit")
        _, child_end = bounds(codes, numbers(rows, "cell"))
        which, since = [place[:0]], [last[:0]]
        while (on := place < stop).any():
            place, stop, last = place[on], stop[on], last[on]
            upto = child_end[place]
            hit = due(times, last, place, upto)
            entered = hit < upto
            which.append(place[entered])
            since.append(last[entered])
            last = np.where(entered, exits[np.where(entered, hit, 0)], last)
            place = upto
        return rows.select(["k", "cell"]).take(np.concatenate(which)).append_column("at", pa.array(np.concatenate(since), pa.float64()))

    def keep(rows: pa.Table, codes: np.ndarray) -> pa.Table:
        place, stop, last = entries(rows, codes)
        times = numbers(rows, "at")
        # the row after each by the gate, then a walk along those: a step for each event kept
        then = due(times, times, np.arange(1, len(times) + 1), bounds(codes)[1]).tolist()
        kept = []
        for row, end in zip(due(times, last, place, stop).tolist(), stop.tolist(), strict=True):
            while row < end:
                kept.append(row)
                row = then[row]
        return rows.select(["k", "at", "value"]).take(pa.array(kept, pa.int64()))

    map_schema = f"k {kind}, cell long, at double, exit double"
    maps = [_by_group(cells.select("k", "cell", "at"), ["k", "cell"], ["at"], base, map_schema)]
    for _ in range(levels):
        maps.append(_by_group(maps[-1].withColumn("up", F.shiftright("cell", _FAN_BITS)), ["k", "up"], ["cell", "at"], merge, map_schema))
    # at the top all of a key's cells are one group, with nothing kept before
    entry = maps[-1].select("k").distinct().select("k", F.lit(0).cast("long").alias("up"), F.lit(float("-inf")).alias("at"))
    for level, own in enumerate(reversed(maps)):
        up = F.lit(0).cast("long") if level == 0 else F.shiftright("cell", _FAN_BITS)
        rows = own.select("k", up.alias("up"), "cell", "at", "exit", F.lit(False).alias("entry"))
        first = entry.select("k", "up", F.lit(-1).cast("long").alias("cell"), "at", F.lit(0.0).alias("exit"), F.lit(True).alias("entry"))
        down = _by_group(rows.unionByName(first), ["k", "up"], [F.desc("entry"), "cell", "at"], hand_down, f"k {kind}, cell long, at double")
        entry = down.withColumnRenamed("cell", "up")
    rows = cells.withColumn("entry", F.lit(False))
    first = entry.select("k", F.col("up").alias("cell"), "at", F.lit(None).cast(worth).alias("value"), F.lit(True).alias("entry"))
    return back(_by_group(rows.unionByName(first), ["k", "cell"], [F.desc("entry"), "at"], keep, f"k {kind}, at double, value {worth.simpleString()}"))
