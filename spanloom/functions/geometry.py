"""Boxes and crops. Column functions, all in the JVM. A box is an array of x0, y0, x1, y1 in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _clamp(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def ordered_box(box: Column) -> Column:
    """A box clamped to [0, 1], its corners in order, as struct x0, y0, x1, y1."""
    x0, y0, x1, y1 = (_clamp(F.get(box, F.lit(i))) for i in range(4))
    return F.struct(F.least(x0, x1).alias("x0"), F.least(y0, y1).alias("y0"), F.greatest(x0, x1).alias("x1"), F.greatest(y0, y1).alias("y1"))


def area(box: Column) -> Column:
    return (box["x1"] - box["x0"]) * (box["y1"] - box["y0"])


def pixel_box(box: Column, width: Column, height: Column) -> Column:
    """An ordered box in pixels, rounded half to even, at least one pixel wide and high, inside the image."""
    at = lambda v, side: F.rint(v * side).cast("int")
    x0, y0 = F.least(at(box["x0"], width), width - 1), F.least(at(box["y0"], height), height - 1)
    x1, y1 = F.least(width, F.greatest(x0 + 1, at(box["x1"], width))), F.least(height, F.greatest(y0 + 1, at(box["y1"], height)))
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def is_sliver(pixels: Column) -> Column:
    w, h = pixels["x1"] - pixels["x0"], pixels["y1"] - pixels["y0"]
    return (F.least(w, h) <= 0) | (F.greatest(w, h) >= config.MAX_ASPECT * F.least(w, h))


def fit_side(side: Column, width: Column, height: Column, min_pixels: Column, max_pixels: Column, factor: int = config.PATCH_FACTOR) -> Column:
    """A side scaled so that the image's pixels lie within the limits, as a positive multiple of the factor.

    Both sides are rounded half to even to multiples; an area out of limits is
    brought in by one scale, rounding down when shrinking and up when growing.
    """
    near = lambda x: F.greatest(F.rint(x / factor) * factor, F.lit(float(factor)))
    pixels = near(width) * near(height)
    true_pixels = width.cast("double") * height
    down = F.greatest(F.floor(side / F.sqrt(true_pixels / max_pixels) / factor) * factor, F.lit(factor))
    up = F.ceil(side * F.sqrt(min_pixels / true_pixels) / factor) * factor
    return F.when(pixels > max_pixels, down).when(pixels < min_pixels, up).otherwise(near(side)).cast("bigint")


def merged_tokens(width: Column, height: Column, frames: int = 1) -> Column:
    """Merged patches of an image whose sides are multiples of the factor."""
    return (width.cast("bigint") * height * frames / config.PATCH_FACTOR**2).cast("bigint")


def grid_tokens(t: Column, h: Column, w: Column) -> Column:
    """Merged tokens of a patch grid."""
    return F.floor(t * h * w / config.MERGE**2).cast("bigint")


def crop_tokens(box: Column, width: Column, height: Column, min_pixels: int, max_pixels: int, threshold: float = 1.0) -> Column:
    """Merged tokens of a box's crop; 0 where the box is empty, too large or a sliver. The box is kept either way."""
    ordered = ordered_box(box)
    pixels = pixel_box(ordered, width, height)
    w, h = pixels["x1"] - pixels["x0"], pixels["y1"] - pixels["y0"]
    low, high = F.lit(min_pixels), F.lit(max_pixels)
    tokens = merged_tokens(fit_side(w, w, h, low, high), fit_side(h, w, h, low, high))
    return F.when((area(ordered) <= 0) | (area(ordered) >= threshold) | is_sliver(pixels), F.lit(0).cast("bigint")).otherwise(tokens)
