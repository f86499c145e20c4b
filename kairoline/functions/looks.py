"""Animations of layers and of a text's characters: changes of place, scale, turn and opacity at a progress from 0 to 1."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SLIDE = 0.18  # of the canvas' height


@dataclass
class Delta:
    x: Column
    y: Column
    scale: Column
    turn: Column
    opacity: Column


def delta(x=0.0, y=0.0, scale=1.0, turn=0.0, opacity=1.0) -> Delta:
    return Delta(*(c if isinstance(c, Column) else F.lit(float(c)) for c in (x, y, scale, turn, opacity)))


def bounce(t: Column) -> Column:
    """Four parabolas, each a rebound lower than the one before."""
    out, edges = None, ((1.0, 0.0, 0.0), (2.0, 1.5, 0.75), (2.5, 2.25, 0.9375))
    for until, middle, floor in edges:
        value = 7.5625 * (t - middle / 2.75) * (t - middle / 2.75) + floor
        out = F.when(t < until / 2.75, value) if out is None else out.when(t < until / 2.75, value)
    return out.otherwise(7.5625 * (t - 2.625 / 2.75) * (t - 2.625 / 2.75) + 0.984375)


def entrance(name: str, t: Column) -> Delta:
    left = 1.0 - t
    return {
        "fade_in": lambda: delta(opacity=t),
        "slide_up": lambda: delta(y=left * SLIDE, opacity=t),
        "zoom_in": lambda: delta(scale=0.25 + 0.75 * t, opacity=t),
        "spin_in": lambda: delta(turn=left * -360.0, scale=0.5 + 0.5 * t, opacity=t),
        "bounce": lambda: delta(y=left * SLIDE * 0.35, scale=bounce(t), opacity=t),
    }.get(name, delta)()


def exit_(name: str, t: Column) -> Delta:
    left = 1.0 - t
    return {
        "fade_out": lambda: delta(opacity=left),
        "slide_down": lambda: delta(y=t * SLIDE, opacity=left),
        "zoom_out": lambda: delta(scale=1.0 - 0.75 * t, opacity=left),
        "spin_out": lambda: delta(turn=t * 360.0, scale=1.0 - 0.5 * t, opacity=left),
        "drop": lambda: delta(y=t * SLIDE * 1.4, scale=1.0 - 0.35 * t, opacity=left),
    }.get(name, delta)()


def combo(name: str, phase: Column) -> Delta:
    p = phase - F.floor(phase)
    wave, half = F.sin(p * (2 * math.pi)), F.sin(p * math.pi)
    return {
        "pulse": lambda: delta(scale=1.0 + 0.08 * wave),
        "rock": lambda: delta(turn=6.0 * wave),
        "swing": lambda: delta(turn=12.0 * half),
        "flicker": lambda: delta(opacity=F.when(p * 8.0 - F.floor(p * 8.0) < 0.5, 1.0).otherwise(0.35)),
        "breathe": lambda: delta(scale=1.0 + 0.05 * wave, opacity=0.85 + 0.15 * (half + 1.0) * 0.5),
    }.get(name, delta)()


def with_intensity(d: Delta, intensity: float) -> Delta:
    i = max(0.0, min(2.0, intensity))
    return Delta(d.x * i, d.y * i, 1.0 + (d.scale - 1.0) * i, d.turn * i, 1.0 + (d.opacity - 1.0) * i)


def compose(deltas: list[Delta], x: Column, y: Column, scale: Column, turn: Column, opacity: Column) -> Delta:
    """Places and turns add, scales and opacities multiply; opacity stays from 0 to 1."""
    for d in deltas:
        x, y, turn, scale = x + d.x, y + d.y, turn + d.turn, scale * d.scale
        opacity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), opacity * d.opacity))
    return Delta(x, y, scale, turn, opacity)


def window_ticks(duration: Column, num: int, den: int, speed: float = 1.0) -> Column:
    """Ticks that an entrance or exit takes: half a second, at most half the clip, at least one; divided by the speed."""
    base = F.greatest(F.lit(1), F.least(F.lit(math.ceil(0.5 * num / den)), F.floor(duration / 2)))
    return F.greatest(F.lit(1), F.round(base / max(0.25, speed))).cast("long")


def stagger(t: Column, index: Column, n: Column, window: float) -> Column:
    """Progress of one of n characters, the first ones earlier."""
    window = max(0.05, min(0.95, window))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (t - index / n * (1.0 - window)) / window))


def character_entrance(name: str, local: Column) -> Delta:
    left = 1.0 - local
    return {
        "char_typewriter": lambda: delta(opacity=F.when(local > 0, 1.0).otherwise(0.0)),
        "char_fade_in": lambda: delta(opacity=local),
        "char_bounce_in": lambda: delta(y=left * 18.0, scale=0.4 + 0.6 * bounce(local), opacity=local),
        "char_slide_in": lambda: delta(x=left * 24.0, opacity=local),
        "char_pop_in": lambda: delta(scale=0.2 + 0.8 * local, opacity=local),
    }.get(name, delta)()


def character_exit(name: str, local: Column) -> Delta:
    left = 1.0 - local
    return {
        "char_fade_out": lambda: delta(opacity=left),
        "char_fall_away": lambda: delta(y=local * 28.0, scale=1.0 - 0.35 * local, opacity=left),
        "char_typewriter_out": lambda: delta(opacity=F.when(local < 1, 1.0).otherwise(0.0)),
    }.get(name, delta)()


def character_combo(name: str, phase: Column, share: Column, index: Column, window: float = 0.55) -> Delta:
    """share: the character's place from 0 to 1."""
    p = phase - F.floor(phase)
    wave = F.sin((p + share) * (2 * math.pi))
    fraction = lambda x: x - F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x))

    def typed() -> Delta:
        narrow = max(0.05, min(0.95, window * 0.4 / 0.55))
        shown = (F.least(p / 0.85, F.lit(1.0)) - share * (1.0 - narrow)) / narrow
        return delta(opacity=F.when(shown > 0, 1.0).otherwise(0.0))

    def jitter() -> Delta:
        seed = F.sin(index * 12.9898 + F.floor(p * 12.0) * 78.233) * 43758.547
        nx, ny = fraction(seed) * 2.0 - 1.0, fraction(seed * 1.37) * 2.0 - 1.0
        return delta(x=nx * 2.5, y=ny * 2.5, turn=nx * 0.05)

    return {
        "typewriter": typed,
        "text_fade": lambda: delta(opacity=0.55 + 0.45 * (F.sin(p * math.pi + share * 2.0) * 0.5 + 0.5)),
        "text_bounce": lambda: delta(y=F.abs(wave) * 6.0, scale=1.0 + 0.08 * F.abs(wave)),
        "text_slide": lambda: delta(x=wave * 5.0),
        "pop": lambda: delta(scale=1.0 + 0.18 * F.greatest(F.sin((p + share) * math.pi), F.lit(0.0))),
        "wave": lambda: delta(y=wave * 8.0, turn=wave * 0.12),
        "char_jitter": jitter,
        "char_pulse": lambda: delta(scale=1.0 + 0.12 * F.sin(p * (2 * math.pi) + share * 3.0)),
    }.get(name, delta)()
