"""Shortcut audit: do file properties alone give the label away?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.formats import flag
from corpusgauge.operators.ordering import exact_quantiles

FLAG_FEATURES = ("is_jpeg", "is_png", "is_webp", "has_exif", "has_icc", "has_xmp", "jpeg_quality_missing")
SIZE_FEATURES = ("file_size_kb", "bytes_per_pixel")
QUANTILES = {"p5": 0.05, "p50": 0.5, "p95": 0.95}


def metadata_feature_columns() -> dict[str, Column]:
    """The 14 file-level features; a missing JPEG quality is -1 and flagged."""
    w, h, size = F.col("width").cast("double"), F.col("height").cast("double"), F.col("file_size").cast("double")
    quality = F.col("jpeg_quality_est").cast("string").try_cast("double")
    return {
        "width": w,
        "height": h,
        "aspect": F.try_divide(w, h),
        "megapixels": w * h / 1e6,
        "file_size_kb": size / 1024,
        "bytes_per_pixel": F.try_divide(size, w * h),
        "jpeg_quality_est": F.coalesce(quality, F.lit(-1.0)),
        "jpeg_quality_missing": quality.isNull().cast("int"),
        **{f"is_{f}": F.coalesce((F.col("format") == f).cast("int"), F.lit(0)) for f in ("jpeg", "png", "webp")},
        **{f: flag(F.col(f)) for f in ("has_exif", "has_icc", "has_xmp")},
    }


METADATA_FEATURES = (
    "width", "height", "aspect", "megapixels", "file_size_kb", "bytes_per_pixel", "jpeg_quality_est",
    "jpeg_quality_missing", "is_jpeg", "is_png", "is_webp", "has_exif", "has_icc", "has_xmp",
)


def metadata_features(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, *[c.alias(name) for name, c in metadata_feature_columns().items()])


def group_quantiles(df: DataFrame, group: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, group, columns, QUANTILES)


def flag_rates(df: DataFrame, group: Sequence[str], columns: Sequence[str] = FLAG_FEATURES) -> DataFrame:
    return df.groupBy(*group).agg(*[F.avg(c).alias(c) for c in columns])


def complete_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a missing feature (null or NaN)."""
    return df.dropna(subset=list(columns))


def constant_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Features with at most one distinct value, as rows (feature). One pass of min and max."""
    ends = df.agg(*[F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns])
    return ends.unpivot([], list(columns), "feature", "constant").filter("constant").select("feature")


def clipped_histogram(df: DataFrame, group: Sequence[str], columns: Sequence[str], bins: int = 40) -> DataFrame:
    """Density per group over equal bins between the overall 0.5% and 99.5% quantiles.

    Values outside are clipped into the end bins; bins are right-open, the last one closed. The
    quantiles of each column (two numbers) go through the driver.
    """
    limits = exact_quantiles(df, [], columns, {"low": 0.005, "high": 0.995})
    ends = {r["feature"]: (r["low"], r["high"]) for r in limits.collect()}  # one row per column
    cells = []
    for c, (low, high) in ends.items():
        top = high if high > low else low + 1.0
        value = F.least(F.greatest(F.col(c).cast("double"), F.lit(low)), F.lit(high))
        at = F.least(F.floor((value - low) / (top - low) * bins), F.lit(bins - 1)).cast("int")
        usable = F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        cells.append(
            F.struct(F.lit(c).alias("feature"), F.when(usable, at).alias("bin"), F.lit((top - low) / bins).alias("width"))
        )
    long = df.select(*group, F.inline(F.array(*cells))).filter(F.col("bin").isNotNull())
    counted = long.groupBy(*group, "feature", "width", "bin").agg(F.count(F.lit(1)).alias("count"))
    totals = counted.groupBy(*group, "feature", "width").agg(F.sum("count").alias("n"))
    layout = totals.select(*group, "feature", "width", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = layout.join(counted.drop("width"), [*group, "feature", "bin"], "left")
    count = F.coalesce("count", F.lit(0))
    return filled.select(*group, "feature", "bin", count.alias("count"), (count / (F.col("n") * F.col("width"))).alias("density"))


def degenerate_filter(df: DataFrame, pixels: str, min_std: float = 3.0) -> DataFrame:
    """Items whose grey values (an array column) barely vary, or are not finite."""
    values = F.transform(pixels, lambda v: v.cast("double"))
    n = F.size(pixels)
    mean = F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / n

    def spread(mu: Column) -> Column:
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + (v - mu) * (v - mu)) / n

    # a one-element transform binds the mean once, instead of once per pixel
    std = F.sqrt(F.transform(F.array(mean), spread)[0])
    finite = ~F.isnan("grey_std") & (F.col("grey_std") < float("inf"))
    return df.withColumn("grey_std", std).filter(~F.coalesce(finite, F.lit(False)) | (F.col("grey_std") < min_std))
