"""Class activation maps as joins and sums over (item, channel, y, x) rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _weight(weights: Sequence[float]) -> Column:
    """Head weight of a row's channel: the head is a short literal array."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("c") + 1)


def gradcam_map(maps: DataFrame, weights: Sequence[float], target: str = "fake", relu: bool = True) -> DataFrame:
    """Sum over channels of weight x activation per position; evidence for `target` only."""
    return _weighted_map(maps.withColumn("g", _weight(weights)), target, relu)


def _weighted_map(rows: DataFrame, target: str, relu: bool) -> DataFrame:
    if target not in ("fake", "real"):
        raise ValueError(f"target must be fake or real, got {target!r}")
    sign = 1.0 if target == "fake" else -1.0
    summed = rows.groupBy("item_id", "y", "x").agg((F.sum(F.col("g") * F.col("a")) * sign).alias("value"))
    return summed.withColumn("value", F.greatest("value", F.lit(0.0))) if relu else summed


def layernorm_gradient(maps: DataFrame, weights: Sequence[float], gamma: Sequence[float], eps: float = 1e-6) -> DataFrame:
    """Gradient of a normalised linear head by the pooled channels, per (item, c). Windows span one item."""
    pooled = maps.groupBy("item_id", "c").agg(F.avg("a").alias("m"))
    item = Window.partitionBy("item_id")
    centred = pooled.withColumn("d", F.col("m") - F.avg("m").over(item))
    scaled = centred.withColumn("s", F.sqrt(F.avg(F.col("d") * F.col("d")).over(item) + eps))
    rows = scaled.withColumns({"h": F.col("d") / F.col("s"), "v": _weight(weights) * _weight(gamma)})
    mean_v, mean_vh = F.avg("v").over(item), F.avg(F.col("v") * F.col("h")).over(item)
    return rows.select("item_id", "c", ((F.col("v") - mean_v - F.col("h") * mean_vh) / F.col("s")).alias("g"))


def gradcam_map_normed(
    maps: DataFrame, weights: Sequence[float], gamma: Sequence[float], eps: float = 1e-6, target: str = "fake", relu: bool = True
) -> DataFrame:
    gradient = layernorm_gradient(maps, weights, gamma, eps)
    return _weighted_map(maps.join(gradient, ["item_id", "c"]), target, relu)


def minmax_map(cam: DataFrame) -> DataFrame:
    """Per item to [0, 1]; a flat map becomes zeros."""
    item = Window.partitionBy("item_id")
    low, span = F.min("value").over(item), F.max("value").over(item) - F.min("value").over(item)
    return cam.withColumn("value", F.when(span < 1e-12, 0.0).otherwise(F.try_divide(F.col("value") - low, span)))


def spearman_by_item(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rank correlation of two maps per item, average ranks on ties; null where a map is flat."""
    both = a.select("item_id", "y", "x", F.col("value").alias("u")).join(
        b.select("item_id", "y", "x", F.col("value").alias("v")), ["item_id", "y", "x"]
    )

    def average_rank(c: str) -> Column:
        first = F.rank().over(Window.partitionBy("item_id").orderBy(c))
        same = F.count(F.lit(1)).over(Window.partitionBy("item_id", c))
        return first + (same - 1) / 2

    ranks = both.withColumns({"ru": average_rank("u"), "rv": average_rank("v")})
    flat = (F.stddev_pop("ru") == 0) | (F.stddev_pop("rv") == 0)
    corr = F.covar_pop("ru", "rv") / F.nullif(F.stddev_pop("ru") * F.stddev_pop("rv"), F.lit(0.0))
    return ranks.groupBy("item_id").agg(F.when(~flat, corr).alias("spearman"))


def mean_spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    return spearman_by_item(a, b).agg(F.avg("spearman").alias("mean_spearman"), F.count("spearman").alias("n"))
