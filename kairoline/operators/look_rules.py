"""Bounds of a clip's look, as it is kept: a name and a JSON value each.

``reason`` says what is wrong with a value, null if nothing; ``violations`` does so for a whole table of clips. A field that a
value hasn't got has its default and is fine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.colour import BLENDS, FILTERS
from .catalogs import ANIMATIONS, MASKS

_MANY = 1e308
_UNIT = (0.0, 1.0)
# The least and the greatest of each numeric field.
BOUNDS = {
    "adjustments": {**dict.fromkeys(("brightness", "contrast", "saturation", "exposure", "temperature", "tint", "hue", "highlights", "shadows"), (-1.0, 1.0)), "sharpness": _UNIT, "vignette": _UNIT},
    "mask": {"feather": _UNIT, "roundness": _UNIT, "rotation": (-3600.0, 3600.0), "center[0]": (-10.0, 10.0), "center[1]": (-10.0, 10.0)},
    "chroma": {"strength": _UNIT, "shadow": _UNIT},
    "motion_blur": {"shutter_deg": (0.0, 720.0), "samples": (2.0, 32.0)},
    "filter": {"intensity": _UNIT},
    "lut": {"intensity": _UNIT},
    "crop": {"x": _UNIT, "y": _UNIT, "w": (0.01, 1.0), "h": (0.01, 1.0)},
    "styles": {"shadow.blur": (0.0, _MANY), "glow.radius": (0.0, _MANY), "glow.intensity": (0.0, 4.0), "outline.width": (0.0, _MANY), "background.padding": (0.0, _MANY), "background.radius": (0.0, _MANY)},
    "transform": {"opacity": _UNIT},
}
# Fields that must be greater than zero.
POSITIVE = {"mask": ("size[0]", "size[1]"), "transform": ("scale_x", "scale_y")}
# Fields (or the value itself, under "") that are one of a list.
CHOICES = {
    "mask": {"kind": MASKS},
    "filter": {"id": tuple(FILTERS)},
    "blend": {"": tuple(BLENDS)},
    "stabilize": {"": ("recommended", "smooth", "max_smooth")},
    "animation_in": {"": ANIMATIONS["in"] + ANIMATIONS["text_in"]},
    "animation_out": {"": ANIMATIONS["out"] + ANIMATIONS["text_out"]},
    "animation_combo": {"": ANIMATIONS["combo"] + ANIMATIONS["text_combo"]},
    "audio_role": {"": ("music", "sfx", "voiceover")},
    "preserve_pitch": {"": ("true", "false")},
    "denoise": {"": ("true", "false")},
}
#: Sums that must not exceed one: the kept part of a picture lies inside it.
_WITHIN = {"crop": (("x", "w"), ("y", "h"))}
NAMES = tuple(dict.fromkeys((*BOUNDS, *POSITIVE, *CHOICES)))


def _paths(name: str) -> list[str]:
    """The fields of a value that rules of its name look at."""
    return list(dict.fromkeys(p for p in (*BOUNDS.get(name, {}), *POSITIVE.get(name, ()), *CHOICES.get(name, {})) if p))


def _shape(paths: list[str]) -> str:
    """The fields as a struct of strings; of ``a[1]`` and ``a.b`` a is an array or a struct itself."""
    inner: dict[str, list[str] | None] = {}
    for path in paths:
        head, _, rest = path.partition(".")
        inner.setdefault(head.partition("[")[0], []).append(rest or path[len(head.partition("[")[0]) :])
    kind = lambda rests: "string" if rests == [""] else "array<string>" if rests[0].startswith("[") else f"struct<{_shape(rests)}>"
    return ", ".join(f"{head}: {kind(rests)}" for head, rests in inner.items())


def _field(parsed: Column, path: str) -> Column:
    if path.endswith("]"):
        head, _, place = path[:-1].partition("[")
        return F.get(parsed[head], F.lit(int(place)))
    for part in path.split("."):
        parsed = parsed[part]
    return parsed


def reason(name: str, value: Column, parsed: Column | None = None) -> Column:
    """Why a value of that name is refused; null if it isn't, or is null itself. parsed: an object's fields as a struct, so
    that it isn't parsed for each of them."""
    if parsed is None:
        get = lambda path: F.get_json_object(value, f"$.{path}" if path else "$")
        found = [F.when(get("").isNull() & value.isNotNull(), f"{name}: not JSON")]
    else:
        get = lambda path: _field(parsed, path) if path else value
        found = []
    number = lambda path: get(path).try_cast("double")
    for path, (low, high) in BOUNDS.get(name, {}).items():
        found.append(F.when(get(path).isNotNull() & ~F.coalesce(number(path).between(low, high), F.lit(False)), f"{name}.{path}: out of bounds"))
    for path in POSITIVE.get(name, ()):
        found.append(F.when(get(path).isNotNull() & ~F.coalesce((number(path) > 0) & (number(path) < _MANY), F.lit(False)), f"{name}.{path}: not positive"))
    for path, names in CHOICES.get(name, {}).items():
        found.append(F.when(get(path).isNotNull() & ~get(path).isin(*names), f"{name}{'.' if path else ''}{path}: unknown"))
    for a, b in _WITHIN.get(name, ()):
        found.append(F.when(number(a) + number(b) > 1.0, f"{name}.{a}: beyond the picture"))
    return F.coalesce(*found)


def _reason_once(name: str, value: Column) -> Column:
    """``reason``, with a whole object parsed once; any other value is read field by field."""
    slow = reason(name, value)
    paths = _paths(name)
    if not paths:
        return slow
    options = {"allowNonNumericNumbers": "false", "columnNameOfCorruptRecord": "_bad"}
    fast = F.transform(F.array(F.from_json(value, f"struct<{_shape(paths)}, _bad: string>", options)), lambda p: F.when(p.isNotNull() & p["_bad"].isNull(), reason(name, value, p)).otherwise(slow))[0]
    return F.when(value.startswith("{"), fast).otherwise(slow)


def violations(clips: DataFrame) -> DataFrame:
    """clip_id, name and reason of every value (look: map of name to JSON) that is refused; names that aren't known too.

    The rules are worked out over arrays, as one generated method of all of them is too long to be compiled to machine code."""

    def judged(name: Column, value: Column) -> Column:
        cases = F.when(~name.isin(*NAMES), "unknown name")
        for n in NAMES:
            cases = cases.when(name == n, _reason_once(n, value))
        return F.struct(name.alias("name"), cases.alias("reason"))

    refused = F.filter(F.transform(F.map_entries("look"), lambda e: judged(e["key"], e["value"])), lambda r: r["reason"].isNotNull())
    return clips.select("clip_id", F.explode(refused).alias("r")).select("clip_id", "r.name", "r.reason")
