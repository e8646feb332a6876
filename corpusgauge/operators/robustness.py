"""Degradation grid: which settings every sampled item is scored at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default grid of families and levels.
DEFAULT_GRID = {
    "jpeg_quality": (100, 90, 80, 70, 60, 50, 40, 30),
    "downscale": (1.0, 0.75, 0.5, 0.35, 0.25),
    "blur_sigma": (0.5, 1.0, 1.5, 2.0, 3.0),
}
SCREENSHOT_SEEDS = (1, 2, 3)


def grid_steps(
    grid: Mapping[str, Sequence[float]] = DEFAULT_GRID, screenshot_seeds: Sequence[int] = SCREENSHOT_SEEDS
) -> list[tuple[str, float]]:
    """The clean step, then every family and level in the caller's order, own families included, then the screenshot seeds."""
    taken = sorted({"none", "screenshot"} & set(grid))
    if taken:
        raise ValueError(f"reserved perturbation families: {taken}")
    steps = [("none", 0.0)]
    steps += [(family, float(level)) for family, levels in grid.items() for level in levels]
    return steps + [("screenshot", float(seed)) for seed in screenshot_seeds]


def expand_grid(
    df: DataFrame,
    grid: Mapping[str, Sequence[float]] = DEFAULT_GRID,
    screenshot_seeds: Sequence[int] = SCREENSHOT_SEEDS,
) -> DataFrame:
    """Every row at every grid point: adds `step`, `family`, `level`. An explode, not a join."""
    points = F.array(
        *[
            F.struct(F.lit(i).alias("step"), F.lit(family).alias("family"), F.lit(level).alias("level"))
            for i, (family, level) in enumerate(grid_steps(grid, screenshot_seeds))
        ]
    )
    return df.select("*", F.inline(points))
