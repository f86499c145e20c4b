"""Layer styles: their lengths are given for a canvas 1080 high and are scaled to the canvas in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which fields of each style are lengths; the others (colours, a glow's intensity) stay as they are.
LENGTHS = {"shadow": ("offset_x", "offset_y", "blur"), "glow": ("radius",), "outline": ("width",), "background": ("padding", "radius")}
REFERENCE_HEIGHT = 1080


def scaled(styles: Column, present: dict[str, tuple[str, ...]], height: Column) -> Column:
    """styles, a struct of style structs that may be null, with lengths in the canvas' pixels; null if every style is.

    present: the fields of each style that the struct has."""
    px = height / float(REFERENCE_HEIGHT)
    out = []
    for style, names in present.items():
        own = styles[style]
        fields = [(own[n] * px if n in LENGTHS[style] else own[n]).alias(n) for n in names]
        out.append(F.when(own.isNotNull(), F.struct(*fields)).alias(style))
    some = [styles[style].isNotNull() for style in present]
    return F.when(F.array_contains(F.array(*some), True), F.struct(*out))
