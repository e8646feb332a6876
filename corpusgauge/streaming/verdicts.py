"""Stateless scoring of an upload stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.decision import apply_calibration, verdict
from corpusgauge.functions.formats import upload_error, upload_status


def score_uploads(
    uploads: DataFrame, temperature: float, threshold: float, delta: float, max_bytes: int = 10 * 1024 * 1024
) -> DataFrame:
    """Per upload: first failing rule and status, else calibrated probability and verdict.

    Works on streams and tables alike. Input: file_size, format, width, height, num_faces, logit.
    """
    error = upload_error(F.col("file_size"), F.col("format"), F.col("width"), F.col("height"), F.col("num_faces"), max_bytes)
    checked = uploads.withColumn("error", error).withColumn("status", upload_status(F.col("error")))
    fine = F.col("error").isNull()
    prob = F.when(fine, apply_calibration(F.col("logit"), temperature))
    return checked.withColumn("prob", prob).withColumn("verdict", F.when(fine, verdict(F.col("prob"), threshold, delta)))
