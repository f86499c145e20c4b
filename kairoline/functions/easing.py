"""Easing curves, their integrals and interpolation, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named cubic curves (x1, y1, x2, y2).
BEZIERS = {"snappy": (0.0, 0.0, 0.2, 1.0), "overshoot": (0.34, 1.56, 0.64, 1.0), "anticipate": (0.36, 0.0, 0.66, -0.56)}

#: Waypoints (time, value, easing from there) of easings made of several pieces.
PIECES = {
    "bounce_out": ((0.0, 0.0, "ease_in"), (0.3636, 1.0, "ease_out"), (0.5454, 0.75, "ease_in"), (0.7272, 1.0, "ease_out"), (0.8181, 0.9375, "ease_in"), (0.9090, 1.0, "ease_out"), (0.9545, 0.984375, "ease_in"), (1.0, 1.0, "linear")),
    "elastic_out": ((0.0, 0.0, "ease_in_out"), (0.3, 1.25, "ease_in_out"), (0.55, 0.875, "ease_in_out"), (0.75, 1.0625, "ease_in_out"), (0.9, 0.96875, "ease_in_out"), (1.0, 1.0, "linear")),
    "back_out": ((0.0, 0.0, "ease_out"), (0.6, 1.1, "ease_in_out"), (1.0, 1.0, "linear")),
}
MIN_PIECE_TICKS = 8
#: Easings from one keyframe to the next.
KINDS = ("linear", "ease_in", "ease_out", "ease_in_out", "hold", *BEZIERS)


def cubic(t: Column, a: float, b: float) -> Column:
    """A coordinate of the curve from 0 to 1 with control values a and b."""
    return 3 * (1 - t) * (1 - t) * t * a + 3 * (1 - t) * t * t * b + t * t * t


def bezier(x: Column, x1: float, y1: float, x2: float, y2: float, steps: int = 30) -> Column:
    """y at x: the parameter is bisected in a fold, as x grows with it."""
    span = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    mid = lambda s: (s["lo"] + s["hi"]) / 2
    low = lambda s: cubic(mid(s), x1, x2) < x
    step = lambda s, _: F.struct(F.when(low(s), mid(s)).otherwise(s["lo"]).alias("lo"), F.when(low(s), s["hi"]).otherwise(mid(s)).alias("hi"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), span, step)
    at = (found["lo"] + found["hi"]) / 2
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(cubic(at, y1, y2))


def ease(kind: Column, t: Column) -> Column:
    out = F.when(kind == "ease_in", t * t).when(kind == "ease_out", t * (2.0 - t)).when(kind == "ease_in_out", t * t * (3.0 - 2.0 * t)).when(kind == "hold", F.when(t < 1, 0.0).otherwise(1.0))
    for name, points in BEZIERS.items():
        out = out.when(kind == name, bezier(t, *points))
    return out.otherwise(t)


def integral(kind: Column, t: Column) -> Column:
    """From 0 to t, of the easings with a closed form."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.when(kind == "ease_in", t * t * t / 3.0).when(kind == "ease_out", t * t - t * t * t / 3.0).when(kind == "ease_in_out", t * t * t - 0.5 * t * t * t * t).when(kind == "hold", 0.0).otherwise(0.5 * t * t)


def bezier_integral(t: Column, points: tuple[float, float, float, float], steps: int = 32) -> Column:
    """Simpson's rule from 0 to t."""
    h = t / steps
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 0, 2.0).otherwise(4.0)
    return F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * bezier(h * i, *points)) * h / 3.0


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def lerp_colour(a: Column, b: Column, t: Column) -> Column:
    """Of arrays of bytes."""
    return F.zip_with(a, b, lambda x, y: F.greatest(F.lit(0), F.least(F.lit(255), F.round(x + (y - x) * t).cast("int"))))


def arc_table(p0: Column, c0: Column, c1: Column, p1: Column, samples: int = 17) -> Column:
    """Lengths along a plane cubic curve (points are arrays of two) at equal steps of its parameter, from 0."""
    n = samples - 1
    # an array of one value names it, so that it is worked out once
    once = lambda value, then: F.transform(F.array(value), then)[0]
    corners = F.struct(*(p[k].alias(f"{name}{k}") for name, p in (("a", p0), ("b", c0), ("c", c1), ("d", p1)) for k in (0, 1)))

    def point(c: Column, t: Column) -> Column:
        u = 1 - t
        return F.struct(*((u * u * u * c[f"a{k}"] + 3 * u * u * t * c[f"b{k}"] + 3 * u * t * t * c[f"c{k}"] + t * t * t * c[f"d{k}"]).alias(f"p{k}") for k in (0, 1)))

    def step(s, p):
        x, y = p["p0"] - s["last"]["p0"], p["p1"] - s["last"]["p1"]
        length = F.sqrt(once(x, lambda x: x * x) + once(y, lambda y: y * y))
        return F.struct(F.concat(s["at"], F.array(F.element_at(s["at"], -1) + length)).alias("at"), p.alias("last"))

    points = lambda c: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: once(i / n, lambda t: point(c, t)))
    lengths = lambda p: F.aggregate(F.slice(p, 2, n), F.struct(F.array(F.lit(0.0)).alias("at"), p[0].alias("last")), step)["at"]
    return once(corners, lambda c: once(points(c), lengths))


# Control points (x1, y1, x2, y2) of the cubic curves that equal the polynomial easings.
_AS_BEZIER = {"linear": (1 / 3, 1 / 3, 2 / 3, 2 / 3), "ease_in": (1 / 3, 0.0, 2 / 3, 1 / 3), "ease_out": (1 / 3, 2 / 3, 2 / 3, 1.0), "ease_in_out": (1 / 3, 0.0, 2 / 3, 1.0)}


def control_points(kind: str, points: tuple[float, float, float, float] | None = None) -> tuple[float, float, float, float]:
    return points or BEZIERS.get(kind) or _AS_BEZIER[kind]


def value_at(kind: str, t: float, points: tuple[float, float, float, float] | None = None) -> float:
    """The eased value of one number."""
    if kind == "hold":
        return 0.0 if t < 1 else 1.0
    if kind == "linear" and not points:
        return min(max(t, 0.0), 1.0)
    x1, y1, x2, y2 = control_points(kind, points)
    u = _parameter(t, x1, x2)
    return 3 * (1 - u) ** 2 * u * y1 + 3 * (1 - u) * u * u * y2 + u**3


def _parameter(x: float, x1: float, x2: float) -> float:
    low, high = 0.0, 1.0
    if x <= 0 or x >= 1:
        return min(max(x, 0.0), 1.0)
    for _ in range(60):
        u = (low + high) / 2
        if 3 * (1 - u) ** 2 * u * x1 + 3 * (1 - u) * u * u * x2 + u**3 < x:
            low = u
        else:
            high = u
    return (low + high) / 2


def _left_part(p: list[tuple[float, float]], u: float) -> list[tuple[float, float]]:
    """Control points of a curve from its start to a parameter: the first points of ever shorter chains of means."""
    out = [p[0]]
    while len(p) > 1:
        p = [((1 - u) * a[0] + u * b[0], (1 - u) * a[1] + u * b[1]) for a, b in zip(p, p[1:], strict=False)]
        out.append(p[0])
    return out


def subsegment(kind: str, start: float, end: float, points: tuple[float, float, float, float] | None = None) -> tuple[str, tuple[float, float, float, float] | None]:
    """The part of an easing between two times as an easing of its own, from 0 to 1: its kind and, for a cubic curve, its
    control points. A part that ends where it began without being flat can't be one, and raises."""
    if not 0 <= start < end <= 1:
        raise ValueError("a part needs 0 <= start < end <= 1")
    if (start, end) == (0.0, 1.0) or kind in ("linear", "hold") and not points:
        return kind, points
    x1, y1, x2, y2 = control_points(kind, points)
    whole = [(0.0, 0.0), (x1, y1), (x2, y2), (1.0, 1.0)]
    a, b = _parameter(start, x1, x2), _parameter(end, x1, x2)
    upto = _left_part(whole, b)
    part = _left_part(upto[::-1], 1 - a / b)[::-1]
    (xa, ya), (xb, yb) = part[0], part[3]
    if abs(yb - ya) < 1e-9:
        if max(abs(y - ya) for _, y in part) < 1e-9:
            return "linear", None
        raise ValueError("this part of the curve ends at the value where it began")
    inner = [((x - xa) / (xb - xa), (y - ya) / (yb - ya)) for x, y in part[1:3]]
    return "bezier", (*inner[0], *inner[1])
