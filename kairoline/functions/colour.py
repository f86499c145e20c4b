"""Colour arithmetic on column expressions: channels from 0 to 1 unless said otherwise."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = tuple[Column, Column, Column]

#: What each named filter sets at full intensity.
FILTERS = {
    "vivid": {"saturation": 0.45, "contrast": 0.15},
    "warm": {"temperature": 0.4, "brightness": 0.05},
    "cool": {"temperature": -0.4},
    "mono": {"saturation": -1.0, "contrast": 0.1},
    "fade": {"contrast": -0.3, "brightness": 0.1, "saturation": -0.2},
    "chrome": {"contrast": 0.25, "saturation": 0.1, "brightness": 0.05},
    "noir": {"saturation": -1.0, "contrast": 0.35, "brightness": -0.05},
    "sunset": {"temperature": 0.5, "tint": 0.1, "saturation": 0.15},
    "forest": {"tint": -0.25, "saturation": 0.2, "brightness": 0.03},
    "berry": {"tint": 0.35, "temperature": -0.1, "saturation": 0.25},
}
#: The blend modes, in the order of their numbers.
BLENDS = ("normal", "darken", "multiply", "color_burn", "lighten", "screen", "color_dodge", "add", "overlay", "soft_light", "hard_light", "difference", "exclusion")
#: Luma weights (of red and of blue) of the two video matrices.
MATRICES = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722)}


@dataclass(frozen=True)
class Grade:
    brightness: float = 0.0
    contrast: float = 0.0
    saturation: float = 0.0
    exposure: float = 0.0
    temperature: float = 0.0
    tint: float = 0.0
    hue: float = 0.0
    highlights: float = 0.0
    shadows: float = 0.0


def effective_grade(name: str | None, intensity: float, adjust: Grade) -> Grade:
    """A filter's recipe times its intensity, plus the sliders; each clamped to -1..1."""
    recipe = FILTERS.get(name or "", {})
    return Grade(**{f.name: max(-1.0, min(1.0, recipe.get(f.name, 0.0) * intensity + getattr(adjust, f.name))) for f in fields(Grade)})


def effective_grades(name: Column, intensity: Column, adjust: dict[str, Column]) -> Column:
    """The same by row, as a struct of the sliders."""
    out = []
    for f in fields(Grade):
        recipe = F.lit(0.0)
        for k, own in FILTERS.items():
            if f.name in own:
                recipe = F.when(name == k, own[f.name]).otherwise(recipe)
        out.append(clamp(recipe * intensity + adjust.get(f.name, F.lit(0.0)), -1.0, 1.0).alias(f.name))
    return F.struct(*out)


def is_identity(grade: Column) -> Column:
    """Whether a grade changes nothing and can be left out."""
    return sum((F.abs(grade[f.name]) for f in fields(Grade)), F.lit(0.0)) == 0


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(x, F.lit(high)))


def mean_luma(c: RGB) -> Column:
    return 0.2126 * c[0] + 0.7152 * c[1] + 0.0722 * c[2]


def smoothstep(a: float, b: float, x: Column) -> Column:
    t = clamp((x - a) / (b - a))
    return t * t * (3.0 - 2.0 * t)


def grade_pixels(df: DataFrame, g: Grade, channels: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """Exposure, white balance, brightness and contrast, saturation, hue, then highlights and shadows. Each step is a
    projection of its own, so that what the next one uses several times is computed once."""
    gain = 2.0 ** (2.0 * g.exposure)
    shift = (0.25 * g.temperature, 0.25 * g.tint, -0.25 * g.temperature)
    own = lambda d: tuple(d[c] for c in channels)
    put = lambda d, c: d.withColumns(dict(zip(channels, c, strict=True)))
    df = put(df, [(x * gain + s + 0.25 * g.brightness - 0.5) * (1.0 + g.contrast) + 0.5 for x, s in zip(own(df), shift, strict=True)])
    if g.saturation:
        df = df.withColumn("_grey", mean_luma(own(df)))
        df = put(df, [df["_grey"] + (x - df["_grey"]) * (1.0 + g.saturation) for x in own(df)]).drop("_grey")
    if g.hue:
        df = put(df, _hue(own(df), g.hue))
    if g.highlights or g.shadows:
        df = df.withColumn("_level", mean_luma(own(df)))
        high, low = smoothstep(0.5, 1.0, df["_level"]), 1.0 - smoothstep(0.0, 0.5, df["_level"])
        df = df.withColumns({"_high": high, "_low": low})
        for amount, weight in ((g.highlights, "_high"), (g.shadows, "_low")):
            df = put(df, [x + amount * df[weight] * 0.35 * ((1.0 - x) if amount >= 0 else x) for x in own(df)])
        df = df.drop("_level", "_high", "_low")
    return put(df, [clamp(x) for x in own(df)])


def _hue(c: RGB, amount: float) -> RGB:
    """A turn of the chroma plane by up to 30 degrees either way, in YIQ."""
    r, g, b = c
    y, i, q = 0.299 * r + 0.587 * g + 0.114 * b, 0.596 * r - 0.274 * g - 0.322 * b, 0.211 * r - 0.523 * g + 0.312 * b
    sin, cos = math.sin(-amount * math.pi / 6), math.cos(-amount * math.pi / 6)
    i, q = i * cos - q * sin, i * sin + q * cos
    return y + 0.956 * i + 0.621 * q, y - 0.272 * i - 0.647 * q, y - 1.106 * i + 1.703 * q


def blend(mode: str, b: Column, s: Column) -> Column:
    """A channel of backdrop and source blended, both opaque."""
    one = F.lit(1.0)
    hard = lambda x, y: F.when(y <= 0.5, 2 * x * y).otherwise(x + (2 * y - 1) - x * (2 * y - 1))
    root = F.when(b <= 0.25, ((16 * b - 12) * b + 4) * b).otherwise(F.sqrt(b))
    table = {
        "darken": lambda: F.least(b, s),
        "multiply": lambda: b * s,
        "color_burn": lambda: F.when(b == 1, 1.0).when(s == 0, 0.0).otherwise(1 - F.least(one, (1 - b) / s)),
        "lighten": lambda: F.greatest(b, s),
        "screen": lambda: b + s - b * s,
        "color_dodge": lambda: F.when(b == 0, 0.0).when(s == 1, 1.0).otherwise(F.least(one, b / (1 - s))),
        "add": lambda: F.least(one, b + s),
        "overlay": lambda: hard(s, b),
        "soft_light": lambda: F.when(s <= 0.5, b - (1 - 2 * s) * b * (1 - b)).otherwise(b + (2 * s - 1) * (root - b)),
        "hard_light": lambda: hard(b, s),
        "difference": lambda: F.abs(b - s),
        "exclusion": lambda: b + s - 2 * b * s,
    }
    return table.get(mode, lambda: s)()


def composite(mode: str, b: Column, ab: Column, s: Column, as_: Column) -> tuple[Column, Column]:
    """Premultiplied colour and alpha of a source over a backdrop, both given unpremultiplied."""
    mixed = (1 - ab) * s + ab * blend(mode, b, s)
    return mixed * as_ + b * ab * (1 - as_), as_ + ab * (1 - as_)


def yuv_to_rgb(y: Column, u: Column, v: Column, matrix: str = "bt709", full: bool = False) -> RGB:
    """Bytes to channels."""
    kr, kb = MATRICES[matrix]
    kg = 1 - kr - kb
    if full:
        y, u, v = y / 255.0, (u - 128) / 255.0, (v - 128) / 255.0
    else:
        y, u, v = (y - 16) / 219.0, (u - 128) / 224.0, (v - 128) / 224.0
    return clamp(y + 2 * (1 - kr) * v), clamp(y - 2 * (1 - kr) * kr / kg * v - 2 * (1 - kb) * kb / kg * u), clamp(y + 2 * (1 - kb) * u)


def chroma_alpha(c: RGB, key: tuple[float, float, float], strength: float, shadow: float = 0.0) -> Column:
    """0 where a colour is keyed out, 1 where it is kept; dark colours are spared by ``shadow``."""
    distance = F.sqrt(sum(((x - k) * (x - k) for x, k in zip(c, key, strict=True)), F.lit(0.0)))
    near = max(strength * 0.35, 1e-4)
    keyed = 1.0 - smoothstep(near, near + 0.08, distance)
    return 1.0 - keyed * (1.0 - shadow * (1.0 - mean_luma(c)))


def vignette(c: RGB, u: Column, v: Column, amount: float) -> RGB:
    """Darker away from the middle; u and v run from 0 to 1, a corner is at distance 1."""
    d = F.sqrt((u - 0.5) * (u - 0.5) + (v - 0.5) * (v - 0.5)) * 1.41421356
    shade = 1.0 - amount * smoothstep(0.35, 1.0, d)
    return tuple(x * shade for x in c)


def pixelate(x: Column, size: Column, cell: float) -> Column:
    """The coordinate whose pixel stands for all of its cell."""
    return F.least(F.floor(F.floor(x / cell) * cell + cell * 0.5), size - 1)


def overlay_colour(c: RGB, colour: tuple[float, float, float, float], amount: float) -> RGB:
    t = max(0.0, min(1.0, amount * colour[3]))
    return tuple(x + (k - x) * t for x, k in zip(c, colour, strict=False))


def duotone(c: RGB, shadow: tuple[float, float, float], highlight: tuple[float, float, float], intensity: float) -> RGB:
    grey = clamp(0.299 * c[0] + 0.587 * c[1] + 0.114 * c[2])
    return tuple(x + (a + (b - a) * grey - x) * intensity for x, a, b in zip(c, shadow, highlight, strict=True))


def sharpen(x: Column, neighbours: Column, amount: float) -> Column:
    """Away from the mean of the four neighbours."""
    return clamp(x + amount * 1.5 * (x - neighbours))


def crossfade(a: RGB, b: RGB, progress: Column) -> RGB:
    return tuple(x + (y - x) * progress for x, y in zip(a, b, strict=True))


def wipe(a: RGB, b: RGB, u: Column, progress: Column) -> RGB:
    """The new picture up to the progress, the old one beyond."""
    return tuple(F.when(u <= progress, y).otherwise(x) for x, y in zip(a, b, strict=True))


#: Integer weights, over 256, of luma and of the two chroma planes, for studio range.
I420 = {"bt601": ((66, 129, 25), (-38, -74, 112), (112, -94, -18)), "bt709": ((47, 157, 16), (-26, -87, 113), (112, -102, -10))}


def rgb_to_luma(c: RGB, matrix: str = "bt709") -> Column:
    """Of bytes, as a byte."""
    w = I420[matrix][0]
    return clamp(F.shiftright(w[0] * c[0] + w[1] * c[1] + w[2] * c[2] + 128, 8) + 16, 0, 255)


def rgb_to_chroma(c: RGB, plane: int, matrix: str = "bt709") -> Column:
    """Of the whole means of 2 x 2 bytes; plane 0 is U, 1 is V."""
    w = I420[matrix][1 + plane]
    return clamp(F.shiftright(w[0] * c[0] + w[1] * c[1] + w[2] * c[2] + 128, 8) + 128, 0, 255)


def lut_sample(pixels: DataFrame, table: DataFrame, size: int, channels: tuple[str, str, str] = ("r", "g", "b")) -> DataFrame:
    """pixels with their channels looked up in a colour table (i, r, g, b), between its eight nearest entries.

    The table has size ** 3 rows, size at most 65, so it is broadcast; a pixel meets it eight times and stays one row."""
    if not 2 <= size <= 65:
        raise ValueError("a table has from 2 to 65 steps")
    at = [clamp(F.col(c)) * (size - 1) for c in channels]
    base = [F.least(F.floor(x), F.lit(size - 2)) for x in at]
    df = pixels.withColumns({f"_base{n}": b for n, b in enumerate(base)}).withColumns({f"_part{n}": x - F.floor(F.least(x, F.lit(float(size - 2)))) for n, x in enumerate(at)})
    total = [F.lit(0.0)] * 3
    for k in range(8):
        bits = (k & 1, k >> 1 & 1, k >> 2 & 1)
        weight = F.lit(1.0)
        for n, bit in enumerate(bits):
            weight = weight * (F.col(f"_part{n}") if bit else 1.0 - F.col(f"_part{n}"))
        index = ((F.col("_base2") + bits[2]) * size + F.col("_base1") + bits[1]) * size + F.col("_base0") + bits[0]
        corner = table.select(F.col("i").alias(f"_i{k}"), *(F.col(c).alias(f"_{c}{k}") for c in "rgb"))
        df = df.join(F.broadcast(corner), index.cast("int") == F.col(f"_i{k}"), "left")
        total = [t + weight * F.col(f"_{c}{k}") for t, c in zip(total, "rgb", strict=True)]
    new = dict(zip(channels, total, strict=True))
    return df.select(*(new[c].alias(c) if c in new else pixels[c] for c in pixels.columns))


def packed_parameters(kinds: list[str], values: list[Column]) -> Column:
    """The same by row, as an array of doubles; points and colours are arrays."""
    part = {"scalar": lambda v: F.array(v.cast("double")), "vec2": lambda v: v.cast("array<double>"), "colour": lambda v: F.transform(v, lambda x: x / 255.0)}
    return F.concat(*(part[k](v) for k, v in zip(kinds, values, strict=True)))


def pack_parameters(kinds: list[str], values: list) -> list[float]:
    """Effect parameters as floats: numbers as they are, points as two, colours (bytes) as four parts of 255."""
    out: list[float] = []
    for kind, value in zip(kinds, values, strict=True):
        out.extend([value] if kind == "scalar" else value if kind == "vec2" else [x / 255 for x in value])
    return out
