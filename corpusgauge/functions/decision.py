"""From logit to verdict. Positive class (1) is fake; flagging a real item is a false positive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    clipped = F.greatest(F.least(x, F.lit(50.0)), F.lit(-50.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clipped))


def apply_calibration(logit: Column, temperature: float | Column) -> Column:
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    return sigmoid(logit / t)


def logit_nll(logit: Column, y: Column, temperature: float | Column = 1.0) -> Column:
    """Binary cross-entropy of a logit in the overflow-free form."""
    t = F.lit(float(temperature)) if isinstance(temperature, (int, float)) else temperature
    z = logit / t
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def verdict(prob: Column, threshold: float | Column, delta: float | Column) -> Column:
    """REAL / AI_GENERATED, or UNCERTAIN closer than delta to the threshold (open band)."""
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    d = F.lit(float(delta)) if isinstance(delta, (int, float)) else delta
    unsure = (d > 0) & (F.abs(prob - t) < d)
    return F.when(unsure, "UNCERTAIN").when(prob >= t, "AI_GENERATED").otherwise("REAL")


def label_to_int(label: Column) -> Column:
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("null"))))
    return F.when(label == "fake", 1).when(label == "real", 0).otherwise(unknown.cast("int"))


def outcome(label: Column, prob: Column, threshold: float | Column) -> Column:
    flagged = prob >= threshold
    fake = label == "fake"
    return F.when(fake & flagged, "TP").when(~fake & ~flagged, "TN").when(~fake & flagged, "FP").otherwise("FN")


def group_label(source: Column, label: Column) -> Column:
    return F.concat(source, F.lit(" ("), label, F.lit(")"))


def probe_logit(x: Column, weights: Column, bias: Column | float) -> Column:
    """w . x + b over array columns of equal length."""
    b = F.lit(float(bias)) if isinstance(bias, (int, float)) else bias
    products = F.zip_with(x, weights, lambda a, w: a.cast("double") * w)
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v) + b
