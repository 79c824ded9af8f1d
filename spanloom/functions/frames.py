"""Frame sampling. Column functions, all in the JVM. Rounding is half to even throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config


def _linspace(lo: Column, hi: Column, n: Column) -> Column:
    """n numbers from lo to hi, rounded; only lo where n is 1."""
    step = F.when(n > 1, (hi - lo).cast("double") / (n - 1)).otherwise(F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.rint(lo + i * step).cast("bigint"))


def frame_ranges(intervals: Column, fps: Column, total: Column) -> Column:
    """First and last frame of each interval of seconds, clamped to the clip."""
    last = total - 1
    at = lambda s: F.greatest(F.least(F.rint(s * fps).cast("bigint"), last), F.lit(0).cast("bigint"))
    return F.transform(intervals, lambda p: F.struct(at(F.least(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("lo"), at(F.greatest(F.get(p, F.lit(0)), F.get(p, F.lit(1)))).alias("hi")))


def clue_frames(ranges: Column, n: int = 3) -> Column:
    """At most n frames of the ranges, apportioned by duration; [0] where there is no range."""
    span = F.aggregate(ranges, F.lit(0).cast("bigint"), lambda a, r: a + r["hi"] - r["lo"])
    span = F.when(span == 0, F.lit(1).cast("bigint")).otherwise(span)
    share = lambda r: F.greatest(F.rint(n * (r["hi"] - r["lo"]) / span), F.lit(1.0)).cast("int")
    frames = F.array_sort(F.array_distinct(F.flatten(F.transform(ranges, lambda r: _linspace(r["lo"], r["hi"], share(r))))))
    picked = F.transform(_linspace(F.lit(0), F.size(frames) - 1, F.lit(n)), lambda i: F.get(frames, i.cast("int")))
    return F.when(F.coalesce(F.size(ranges), F.lit(0)) <= 0, F.array(F.lit(0).cast("bigint"))).when(F.size(frames) > n, picked).otherwise(frames)


def train_frame_count(total: Column, fps: Column, target: float, max_frames: int) -> Column:
    """Frames of a training clip: at the target rate, bounded, to a multiple of two, no more than there are."""
    wanted = total / F.greatest(fps, F.lit(1e-6)) * target
    bounded = F.least(F.greatest(wanted, F.lit(float(config.LEAST_FRAMES))), F.lit(float(max_frames)), total.cast("double"))
    even = F.greatest(F.rint(bounded / config.FRAME_STEP).cast("bigint") * config.FRAME_STEP, F.lit(config.FRAME_STEP))
    return F.least(even, total.cast("bigint"))


def uniform_frames(total: Column, n: Column) -> Column:
    return F.when(n > 0, _linspace(F.lit(0), total - 1, n)).otherwise(F.array().cast("array<bigint>"))


def frame_pixels(n: Column, min_pixels: int, max_pixels: int, sequence_tokens: int, factor: int = config.PATCH_FACTOR) -> Column:
    """Pixel budget of each of n frames."""
    cap = float(config.FRAME_TOKENS * factor * factor)
    pool = sequence_tokens * factor * factor * 0.9
    share = F.least(F.lit(cap), F.lit(pool) / n * config.FRAME_STEP)
    return F.least(F.lit(float(max_pixels)), F.greatest(share, F.lit(float(int(min_pixels * 1.05)))))


def eval_frame_count(total: Column, fps: Column, target: float, max_frames: int) -> Column:
    """Frames of an evaluated clip, rounded down to even; max_frames where the clip can't be read (total is null)."""
    n = F.least(F.rint(total / F.greatest(F.coalesce(F.nullif(fps, F.lit(0.0)), F.lit(target)), F.lit(1e-6)) * target), F.lit(float(max_frames)), total.cast("double")).cast("bigint")
    even = F.when(n >= 2, n - n % 2).otherwise(n)
    return F.coalesce(F.greatest(even, F.lit(1).cast("bigint")), F.lit(max_frames).cast("bigint"))


def seconds_per_grid(seconds: Column, grids: Column) -> Column:
    """The seconds given, or one for each grid."""
    return F.coalesce(seconds, F.array_repeat(F.lit(1.0), F.size(grids)))
