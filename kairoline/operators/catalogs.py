"""Dimension tables of named things, for broadcast joins. All are fixed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.colour import BLENDS, FILTERS
from ..functions.easing import BEZIERS, PIECES

# Effects with their parameters' defaults, least and most; and those that change pixels.
EFFECTS = {
    "gaussian_blur": {"radius": (4, 0, 64)},
    "vignette": {"amount": (0.6, 0, 1)},
    "sharpen": {"amount": (0.5, 0, 3)},
    "pixelate": {"size": (8, 1, 256)},
    "glitch": {"amount": (0.5, 0, 1), "seed": (0, 0, 1000)},
    "chromatic_aberration": {"amount": (0.4, 0, 1)},
    "grain": {"amount": (0.3, 0, 1), "seed": (0, 0, 1000)},
    "glow": {"threshold": (0.7, 0, 1), "intensity": (0.8, 0, 4)},
    "zoom_blur": {"amount": (0.5, 0, 1)},
    "mirror": {"mode": (0, 0, 3)},
    "color_overlay": {"amount": (0.5, 0, 1)},
    "duotone": {"intensity": (1, 0, 1)},
}
RENDERED_EFFECTS = ("gaussian_blur", "vignette", "pixelate", "color_overlay", "duotone")
TRANSITIONS = ("crossfade", "dip_to_black", "dip_to_white", "wipe_left", "wipe_right", "wipe_up", "wipe_down", "slide")
RENDERED_TRANSITIONS = ("crossfade", "wipe_left")
TRANSITION_TICKS = 24
ANIMATIONS = {
    "in": ("fade_in", "slide_up", "zoom_in", "spin_in", "bounce"),
    "out": ("fade_out", "slide_down", "zoom_out", "spin_out", "drop"),
    "combo": ("pulse", "rock", "swing", "flicker", "breathe"),
    "text_in": ("char_typewriter", "char_fade_in", "char_bounce_in", "char_slide_in", "char_pop_in"),
    "text_out": ("char_fade_out", "char_fall_away", "char_typewriter_out"),
    "text_combo": ("typewriter", "text_fade", "text_bounce", "text_slide", "pop", "wave", "char_jitter", "char_pulse"),
}
# Speed curves as place, speed and easing from there.
SPEED_PRESETS = {
    "ramp_up": ((0.0, 0.4, "ease_in"), (1.0, 2.5, "linear")),
    "ramp_down": ((0.0, 2.5, "ease_out"), (1.0, 0.4, "linear")),
    "montage": ((0.0, 2.0, "ease_in_out"), (0.5, 0.5, "ease_in_out"), (1.0, 2.0, "ease_in_out")),
    "hero": ((0.0, 1.5, "ease_in_out"), (0.5, 0.3, "ease_in_out"), (1.0, 1.5, "ease_in_out")),
    "bullet": ((0.0, 3.0, "ease_in_out"), (0.4, 0.25, "ease_in_out"), (0.6, 0.25, "ease_in_out"), (1.0, 3.0, "ease_in_out")),
    "jump_cut": ((0.0, 1.0, "linear"), (0.25, 3.0, "linear"), (0.5, 1.0, "linear"), (0.75, 3.0, "linear"), (1.0, 1.0, "linear")),
    "flash_in": ((0.0, 3.0, "ease_out"), (0.3, 1.0, "linear"), (1.0, 1.0, "linear")),
    "flash_out": ((0.0, 1.0, "linear"), (0.7, 1.0, "ease_in"), (1.0, 3.0, "linear")),
}
MASKS = ("linear", "mirror", "circle", "rectangle", "heart", "star")
STICKERS = ("heart", "star", "smiley", "bolt", "bubble", "flower", "star_spin", "heart_beat")
TEXT_EFFECTS = ("neon", "shadow", "outline", "glow", "retro", "chrome")
ASPECTS = {"16:9": (16, 9), "9:16": (9, 16), "1:1": (1, 1), "4:5": (4, 5), "21:9": (21, 9)}
MOMENT_KINDS = ("shot_boundary", "silence", "beat", "transcript_segment", "transcript_word", "vision_moment")
CACHES = ("preview_frames", "library_thumbnails", "timeline_filmstrips", "timeline_waveforms", "proxies", "analysis", "ai_models", "download", "catalog", "luts", "lottie", "templates")


def _all() -> list[tuple[str, str, int, bool]]:
    named = {
        "effect": [(n, n in RENDERED_EFFECTS) for n in EFFECTS],
        "transition": [(n, n in RENDERED_TRANSITIONS) for n in TRANSITIONS],
        "filter": [(n, True) for n in FILTERS],
        "blend": [(n, True) for n in BLENDS],
        "mask": [(n, True) for n in MASKS],
        "sticker": [(n, True) for n in STICKERS],
        "text_effect": [(n, True) for n in TEXT_EFFECTS],
        "speed": [(n, True) for n in SPEED_PRESETS],
        "bezier": [(n, True) for n in BEZIERS],
        "piecewise": [(n, True) for n in PIECES],
        "aspect": [(n, True) for n in ASPECTS],
        "moment": [(n, True) for n in MOMENT_KINDS],
        "cache": [(n, True) for n in CACHES],
    } | {f"animation_{slot}": [(n, True) for n in names] for slot, names in ANIMATIONS.items()}
    return [(kind, name, i, shown) for kind, names in named.items() for i, (name, shown) in enumerate(names)]


def catalog(spark: SparkSession) -> DataFrame:
    """kind, id, position and rendered (whether it changes pixels; other transitions are crossfades)."""
    return spark.createDataFrame(_all(), "kind string, id string, position int, rendered boolean")


def effect_parameters(spark: SparkSession) -> DataFrame:
    rows = [(e, p, float(d), float(a), float(b)) for e, own in EFFECTS.items() for p, (d, a, b) in own.items()]
    return spark.createDataFrame(rows, "effect string, param string, default double, least double, most double")


def speed_curves(spark: SparkSession) -> DataFrame:
    """Presets as keyframes: param_id is the preset, ticks are thousandths."""
    rows = [(name, round(q * 1000), v, e) for name, own in SPEED_PRESETS.items() for q, v, e in own]
    return spark.createDataFrame(rows, "param_id string, tick long, value double, easing string")
