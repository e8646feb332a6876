"""Box arithmetic. Roundings are half-to-even (`bround`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(x: Column) -> Column:
    return F.bround(x, 0).cast("int")


def detection_scale(width: Column, height: Column, max_side: int = 1024) -> Column:
    """Struct(scale, width, height) of the copy a detector looks at; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest(width, height))
    return F.struct(
        scale.alias("scale"),
        F.greatest(F.lit(1), _whole(width * scale)).alias("width"),
        F.greatest(F.lit(1), _whole(height * scale)).alias("height"),
    )


def square_crop(
    x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, margin: float = 0.3
) -> Column:
    """Struct(left, top, side, clamped): square around a box, shifted or shrunk to stay inside."""
    box_w, box_h = x2 - x1, y2 - y1
    wanted = F.greatest(F.lit(1), _whole(F.greatest(box_w, box_h) * (1.0 + margin)))
    side = F.least(wanted, width, height).cast("int")
    free_left = _whole((x1 + x2) / 2 - side / 2)
    free_top = _whole((y1 + y2) / 2 - side / 2)
    left = F.least(F.greatest(free_left, F.lit(0)), width - side).cast("int")
    top = F.least(F.greatest(free_top, F.lit(0)), height - side).cast("int")
    bad = (box_w <= 0) | (box_h <= 0) | (width <= 0) | (height <= 0)
    checked_side = F.when(bad, F.raise_error(F.lit("degenerate box or image size")).cast("int")).otherwise(side)
    return F.struct(
        left.alias("left"),
        top.alias("top"),
        checked_side.alias("side"),
        ((wanted != side) | (left != free_left) | (top != free_top)).alias("clamped"),
    )


def scaled_crop(
    x1: Column,
    y1: Column,
    x2: Column,
    y2: Column,
    scale: Column,
    width: Column,
    height: Column,
    margin: float = 0.3,
) -> Column:
    """Crop on a rescaled image from a box known in the original's pixels."""
    return square_crop(x1 * scale, y1 * scale, x2 * scale, y2 * scale, width, height, margin)
