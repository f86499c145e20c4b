"""Signed distances of shapes around the origin (negative inside, y down), their coverage, and masks made of them."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def coverage(distance: Column, half_width: float = 1.0) -> Column:
    """1 inside, 0 outside, and a ramp of twice the half width across the edge."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 - distance / (2 * half_width)))


def stroke_over_fill(distance: Column, stroke: float) -> tuple[Column, Column]:
    """Coverage of a stroke centred on the edge, and of the fill that it leaves."""
    line = coverage(F.abs(distance) - stroke / 2)
    return line, coverage(distance) * (1 - line)


def round_box(x: Column, y: Column, half: tuple[float, float], radius: float = 0.0) -> Column:
    zero = F.lit(0.0)
    qx, qy = F.abs(x) - half[0] + radius, F.abs(y) - half[1] + radius
    return _length(F.greatest(qx, zero), F.greatest(qy, zero)) + F.least(F.greatest(qx, qy), zero) - radius


def ellipse(x: Column, y: Column, half: tuple[float, float]) -> Column:
    """First-order distance: the level of the scaled circle over its slope."""
    a, b = (max(h, 1e-3) for h in half)
    level, slope = _length(x / a, y / b), _length(x / (a * a), y / (b * b))
    return F.when(level < 1e-6, -min(a, b)).otherwise(F.try_divide(level * (level - 1.0), slope))


def capsule(x: Column, y: Column, half: tuple[float, float]) -> Column:
    r = min(half)
    return _length(F.greatest(F.abs(x) - max(half[0] - r, 0.0), F.lit(0.0)), y) - r


def polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Distance to the nearest edge; inside where a ray to the right crosses an odd number of edges."""
    squares, crossings = [], F.lit(0)
    for (ax, ay), (bx, by) in zip(points, [*points[1:], points[0]], strict=True):
        ex, ey = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * ex + (y - ay) * ey) / max(ex * ex + ey * ey, 1e-12)))
        dx, dy = x - ax - t * ex, y - ay - t * ey
        squares.append(dx * dx + dy * dy)
        if ay != by:
            crosses = ((y >= ay) != (y >= by)) & (x < ax + (y - ay) * (ex / ey))
            crossings = crossings + crosses.cast("int")
    distance = F.sqrt(reduce(F.least, squares))
    return F.when(crossings % 2 == 1, -distance).otherwise(distance)


def star_points(half: tuple[float, float], points: int = 5, inner: float = 0.5) -> list[tuple[float, float]]:
    """Corners from the top on, every other one drawn in."""
    at = [(-math.pi / 2 + math.pi / points * k, inner if k % 2 else 1.0) for k in range(2 * points)]
    return [(math.cos(a) * r * half[0], math.sin(a) * r * half[1]) for a, r in at]


def arrow_points(half: tuple[float, float]) -> list[tuple[float, float]]:
    """An arrow to the right: its head is as long as half its height, at most half its width; the shaft takes two fifths of
    the height."""
    x, y = half
    neck, shaft = x - min(x, y), 0.4 * y
    upper = [(neck, -y), (neck, -shaft), (-x, -shaft)]
    return [(x, 0.0), *upper, *((a, -b) for a, b in reversed(upper))]


def polygon_points(half: tuple[float, float], sides: int) -> list[tuple[float, float]]:
    return [(math.cos(-math.pi / 2 + 2 * math.pi / sides * k) * half[0], math.sin(-math.pi / 2 + 2 * math.pi / sides * k) * half[1]) for k in range(sides)]


def heart(x: Column, y: Column, half: tuple[float, float]) -> Column:
    """Two lobes over a square on its corner, fitted into a box."""
    lobe = math.sqrt(2) / 4
    sx, sy = half[0] / (0.25 + lobe), half[1] * 2 / (0.75 + lobe)
    u, v = F.abs(x / sx), (half[1] - y) / sy
    top = _length(u - 0.25, v - 0.75) - lobe
    m = F.greatest(0.5 * (u + v), F.lit(0.0))
    low = F.sqrt(F.least(u * u + (v - 1.0) * (v - 1.0), (u - m) * (u - m) + (v - m) * (v - m)))
    return F.when(u + v > 1.0, top).otherwise(F.when(u < v, -low).otherwise(low)) * min(sx, sy)


def mask_alpha(kind: str, x: Column, y: Column, half: tuple[float, float], feather: float = 0.0, invert: bool = False, roundness: float = 0.0, base: float = 1.0) -> Column:
    """How much of a layer shows at a point from its middle: right half, left half, ellipse, box, heart or star."""
    shapes = {
        "linear": lambda: -x,
        "mirror": lambda: x,
        "circle": lambda: ellipse(x, y, half),
        "rectangle": lambda: round_box(x, y, half, roundness * 0.5 * min(half)),
        "heart": lambda: heart(x, y, half),
        "star": lambda: polygon(x, y, star_points(half)),
    }
    alpha = coverage(shapes[kind](), base + feather * min(half))
    return 1.0 - alpha if invert else alpha
