"""Exact time arithmetic as column expressions. Products are DECIMAL(38, 0), so 64-bit ticks never overflow."""

from __future__ import annotations

import math
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

AUDIO_RATE = 48_000


def _d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("decimal(38,0)")


def truncated(n: Column, d: Column) -> Column:
    """Quotient of two decimals toward zero, as a long."""
    return F.when(d != 0, F.call_function("div", n, d)).cast("long")


def contains(start: Column, dur: Column, t: Column) -> Column:
    return (t >= start) & (t < start + dur)


def overlaps(s1: Column, d1: Column, s2: Column, d2: Column) -> Column:
    """Half-open; an empty range overlaps nothing."""
    return (d1 > 0) & (d2 > 0) & (s1 < s2 + d2) & (s2 < s1 + d1)


def intersection(s1: Column, d1: Column, s2: Column, d2: Column) -> Column:
    """Struct of start and dur, null where the ranges don't overlap."""
    start = F.greatest(s1, s2)
    return F.when(overlaps(s1, d1, s2, d2), F.struct(start.alias("start"), (F.least(s1 + d1, s2 + d2) - start).alias("dur")))


def compare(v1, n1, d1, v2, n2, d2) -> Column:
    """-1, 0 or 1: value v at rate n/d, by cross multiplication."""
    a, b = _d(v1) * _d(d1) * _d(n2), _d(v2) * _d(d2) * _d(n1)
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def resample(v, n1, d1, n2, d2) -> Column:
    """Ticks at rate n1/d1 as ticks at n2/d2, rounded half away from zero."""
    num, den = _d(v) * _d(d1) * _d(n2), _d(n1) * _d(d2)
    size = truncated(F.abs(num) + truncated(F.abs(den), _d(2)).cast("decimal(38,0)"), F.abs(den))
    return F.when(num * F.signum(den).cast("decimal(1,0)") < 0, -size).otherwise(size)


def seconds(v: Column, n: Column, d: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(v.cast("double") * d / n)


def seconds_to_ticks(s: Column, n: Column, d: Column) -> Column:
    """Null where seconds aren't finite or ticks are beyond 2**53."""
    ticks = F.round(s * n / d)
    return F.when(~F.isnan(ticks) & (F.abs(ticks) <= 2.0**53), ticks.cast("long"))


def gcd(a: Column, b: Column, steps: int = 92) -> Column:
    """Euclid by a fold; 92 steps do for all longs, as the worst case are neighbours in Fibonacci's sequence."""
    first = F.struct(F.abs(a.cast("long")).alias("x"), F.abs(b.cast("long")).alias("y"))
    step = lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(s["x"] % F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)["x"]


def reduced(n: Column, d: Column) -> Column:
    g = F.greatest(gcd(n, d), F.lit(1).cast("long"))
    return F.struct(F.call_function("div", n, g).alias("num"), F.call_function("div", d, g).alias("den"))


def reduced_products(n: Column, d: Column) -> Column:
    """The same of decimals(38, 0), such as products of longs. A part that stays beyond longs in lowest terms raises."""

    def lowest(n: pa.Array, d: pa.Array) -> pa.Array:
        parts = []
        for a, b in zip(n.to_pylist(), d.to_pylist(), strict=True):
            if a is None or b is None:
                parts.append((None, None))
                continue
            a, b = int(a), int(b)
            g = math.gcd(a, b) or 1
            parts.append((a // g, b // g))
        return pa.StructArray.from_arrays([pa.array([p[k] for p in parts], pa.int64()) for k in (0, 1)], ["num", "den"])

    return F.arrow_udf(lowest, "num long, den long")(_d(n), _d(d))


def rational_speed(speed: Column) -> Column:
    """A speed on the grid of hundredths as a reduced fraction; null outside 0.05 to 100."""
    hundredths = F.round(speed * 100).cast("long")
    return F.when(speed.between(0.05, 100.0) & ~F.isnan(speed), reduced(hundredths, F.lit(100).cast("long")))


def scale_by_speed(ticks: Column, num: Column, den: Column) -> Column:
    return truncated(_d(ticks) * _d(num), _d(den))


def unscale_by_speed(ticks: Column, num: Column, den: Column) -> Column:
    return truncated(_d(ticks) * _d(den), _d(num))


def pitch_factor(num: Column, den: Column, average: Column, preserve: Column) -> Column:
    """By how much sound is sped up where its pitch isn't preserved: the speed times the speed curve's average."""
    return F.when(preserve, 1.0).otherwise(num / den * average)


def animation_tick(t: Column, start: Column, dur: Column) -> Column:
    return F.greatest(F.lit(0), F.least(t - start, F.greatest(dur - 1, F.lit(0))))


def retimed_duration(source: Column, num: Column, den: Column, average: Column | None = None) -> Column:
    """Timeline ticks that a source takes at a speed, at least 1; rounded where a speed curve averages otherwise."""
    if average is None:
        return F.greatest(unscale_by_speed(source, num, den), F.lit(1).cast("long"))
    return F.greatest(F.round(source * den / (num * average)).cast("long"), F.lit(1).cast("long"))


def ticks_to_samples(v: Column, n, d, rate: int = AUDIO_RATE) -> Column:
    """Sample frames at the export rate, toward zero; 0 for rates that aren't positive."""
    n, d = (x if isinstance(x, Column) else F.lit(x) for x in (n, d))
    return F.when((n <= 0) | (d <= 0), F.lit(0).cast("long")).otherwise(truncated(_d(v) * _d(d) * rate, _d(n)))


def source_tick(t: Column, start: Column, dur: Column, src_start: Column, src_dur: Column, num: Column, den: Column, reverse: Column, freeze: Column) -> Column:
    """Source tick shown at timeline tick t at constant speed, at one rate; null outside the clip."""
    offset = scale_by_speed(t - start, num, den)
    last = src_start + F.greatest(src_dur - 1, F.lit(0))
    tick = F.when(reverse, last - offset).otherwise(src_start + offset)
    return F.when(contains(start, dur, t), F.when(freeze, src_start).otherwise(F.greatest(src_start, F.least(tick, last))))


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def _joined(parts: list[Column], signs: list[str]) -> Column:
    return reduce(lambda a, b: F.concat(a, F.lit(b[0]), b[1]), zip(signs, map(_two, parts[1:]), strict=True), _two(parts[0]))


def timecode(frame: Column, n: int, d: int, drop: bool = False) -> Column:
    """HH:MM:SS:FF labels of the nominal rate; a drop-frame label skips 2 (near 60: 4) numbers in every minute but each
    tenth, and has a semicolon before the frames."""
    fps = -(-n // d)
    if drop:
        skip = int(n / d * 0.066666 + 0.5)
        minute, ten = fps * 60 - skip, fps * 600 - skip * 9
        tens, rest = F.floor(frame / ten), frame % ten
        frame = frame + skip * 9 * tens + F.when(rest > skip, skip * F.floor((rest - skip) / minute)).otherwise(0)
    total = F.floor(frame / fps).cast("long")
    return _joined([F.floor(total / 3600).cast("long"), F.floor(total / 60).cast("long") % 60, total % 60, (frame % fps).cast("long")], [":", ":", ";" if drop else ":"])
