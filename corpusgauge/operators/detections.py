"""Ranking detector boxes per image."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable_detections(df: DataFrame, prob_threshold: float = 0.9, min_face: float = 40.0) -> DataFrame:
    """Sure enough and large enough boxes, rescaled to the original image's pixels, with a score."""
    boxes = {c: F.col(c) / F.col("scale") for c in ("x1", "y1", "x2", "y2")}
    sized = df.filter(F.col("prob") >= prob_threshold).withColumns(boxes)
    width, height = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return sized.filter((width >= min_face) & (height >= min_face)).withColumn("score", F.col("prob") * width * height)


def rank_detections(
    df: DataFrame, image: Sequence[str] = ("image_id",), max_faces: int = 10, ties: Sequence[str] = ("pos",), **limits: float
) -> DataFrame:
    """The best `max_faces` boxes of an image, `face_rank` from 1."""
    w = Window.partitionBy(*image).orderBy(F.col("score").desc(), *ties)
    usable = usable_detections(df, **limits)
    return usable.withColumn("face_rank", F.row_number().over(w)).filter(F.col("face_rank") <= max_faces)


def top_face(df: DataFrame, image: Sequence[str] = ("image_id",), ties: Sequence[str] = ("pos",), **limits: float) -> DataFrame:
    """The best box of an image and how many usable ones it has, at most 10. One partial aggregation."""
    usable = usable_detections(df, **limits)
    rest = [c for c in usable.columns if c not in (*image, *ties, "score")]
    order = F.struct((-F.col("score")).alias("_below"), *ties, *rest)
    folded = usable.groupBy(*image).agg(F.min(order).alias("_best"), F.least(F.count(F.lit(1)), F.lit(10)).alias("num_faces"))
    return folded.select(*image, (-F.col("_best._below")).alias("score"), *[f"_best.{c}" for c in (*ties, *rest)], "num_faces")


def result_faces(ranked: DataFrame, image: Sequence[str] = ("image_id",)) -> DataFrame:
    """One row per image: its faces as a sorted array of structs, rounded for output.

    The array is bounded by the ranking's max_faces.
    """
    face = F.struct(
        (F.col("face_rank") - 1).alias("face_index"),
        F.array(*[F.bround(F.col(c), 0).cast("int") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"),
        F.bround("prob", 4).alias("detection_score"),
    )
    return ranked.groupBy(*image).agg(F.sort_array(F.collect_list(face)).alias("faces"))
