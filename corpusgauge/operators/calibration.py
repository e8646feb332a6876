"""Temperature, thresholds and the uncertainty band, fitted on one split."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from corpusgauge.caching import keep
from corpusgauge.functions.decision import apply_calibration, sigmoid
from corpusgauge.operators.metrics import confusion, curve, ece, nll_aggregate, score_counts

LOG_T_BOUND = 3.0
BAND_STEPS = 50


def fit_temperature(logit_counts: DataFrame, tolerance: float = 1e-9, max_rounds: int = 200) -> float:
    """T minimising the mean cross-entropy of logit / T, with log T in [-3, 3].

    The loss is convex in b = 1/T: Newton steps on b, halving the bracket where a step leaves it.
    Each round is one aggregation to a single row; `logit_counts` are score counts over logits.
    """
    low, high, b = math.exp(-LOG_T_BOUND), math.exp(LOG_T_BOUND), 1.0
    z, n = F.col("score"), F.col("pos") + F.col("neg")

    def slope(at: float) -> Column:
        return F.sum(z * (n * sigmoid(z * at) - F.col("pos")))

    counts = logit_counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = counts.agg(slope(low).alias("low"), slope(high).alias("high")).first()
        if ends["low"] is None:
            raise ValueError("no rows to fit a temperature on")
        if ends["low"] >= 0 or ends["high"] <= 0:  # the minimum lies at a bound
            return 1.0 / (low if ends["low"] >= 0 else high)
        for _ in range(max_rounds):
            p = sigmoid(z * b)
            row = counts.agg(slope(b).alias("slope"), F.sum(n * z * z * p * (1.0 - p)).alias("bend")).first()
            if row["slope"] > 0:
                high = b
            else:
                low = b
            step = b - row["slope"] / row["bend"] if row["bend"] else -1.0
            new = step if low < step < high else math.sqrt(low * high)
            if abs(math.log(new / b)) < tolerance:
                return 1.0 / new
            b = new
        raise RuntimeError(f"the temperature has not settled after {max_rounds} rounds")
    finally:
        counts.unpersist()


def fit_temperatures(logit_counts: DataFrame, keys: Sequence[str], tolerance: float = 1e-9, max_rounds: int = 200) -> DataFrame:
    """(keys, temperature) of every group, as fit_temperature gives them; null where a group has no rows.

    One aggregation per round serves all groups. A group's bracket and step, one small row each, go through the driver; groups
    that have settled leave the rounds. Null keys are groups too.
    """
    spark, names = logit_counts.sparkSession, list(keys)
    z, n = F.col("score"), F.col("pos") + F.col("neg")
    bounds = (math.exp(-LOG_T_BOUND), math.exp(LOG_T_BOUND))

    def slope(at: Column) -> Column:
        return F.sum(z * (n * sigmoid(z * at) - F.col("pos")))

    schema = StructType([*[logit_counts.schema[k] for k in names], StructField("b", DoubleType())])
    counts = logit_counts.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ends = counts.groupBy(*names).agg(slope(F.lit(bounds[0])).alias("low"), slope(F.lit(bounds[1])).alias("high")).collect()
        done: dict[tuple, float | None] = {}
        open_: dict[tuple, tuple[float, float, float]] = {}
        for r in ends:
            group = tuple(r[k] for k in names)
            if r["low"] is None:
                done[group] = None
            elif r["low"] >= 0 or r["high"] <= 0:  # the minimum lies at a bound
                done[group] = 1.0 / bounds[0 if r["low"] >= 0 else 1]
            else:
                open_[group] = (*bounds, 1.0)
        for _ in range(max_rounds):
            if not open_:
                break
            state = spark.createDataFrame([(*g, s[2]) for g, s in open_.items()], schema)
            at = state.select(*[F.col(k).alias(f"_at_{k}") for k in names], "b")
            met = counts.join(at, [F.col(k).eqNullSafe(F.col(f"_at_{k}")) for k in names])
            p = sigmoid(z * F.col("b"))
            for r in met.groupBy(*names).agg(slope(F.col("b")).alias("slope"), F.sum(n * z * z * p * (1.0 - p)).alias("bend")).collect():
                group = tuple(r[k] for k in names)
                low, high, b = open_[group]
                low, high = (low, b) if r["slope"] > 0 else (b, high)
                step = b - r["slope"] / r["bend"] if r["bend"] else -1.0
                new = step if low < step < high else math.sqrt(low * high)
                if abs(math.log(new / b)) < tolerance:
                    done[group] = 1.0 / new
                    del open_[group]
                else:
                    open_[group] = (low, high, new)
        if open_:
            raise RuntimeError(f"{len(open_)} temperatures have not settled after {max_rounds} rounds")
        fitted = StructType([*schema.fields[:-1], StructField("temperature", DoubleType())])
        return spark.createDataFrame([(*g, t) for g, t in done.items()], fitted)
    finally:
        counts.unpersist()


def next_up(x: Column) -> Column:
    """The next larger double of a positive normal number: adding this fraction rounds up by one step."""
    return x + x * F.lit(2.0**-53 * (1.0 + 2.0**-52))


def threshold_for_fpr(points: DataFrame, keys: Sequence[str], target_fpr: float) -> DataFrame:
    """Smallest threshold flagging at most floor(target * reals) real rows; 0 where all may be."""
    allowed = F.floor(F.lit(float(target_fpr)) * F.col("neg_total"))
    at = (F.col("neg_before") <= allowed) & (allowed < F.col("fp"))
    found = points.groupBy(*keys).agg(
        F.max(F.when(at, F.col("score"))).alias("value"), F.max("neg_total").alias("n_real")
    )
    none = F.raise_error(F.lit("no real rows to set a threshold on")).cast("double")
    threshold = F.when(F.col("n_real") == 0, none).otherwise(F.coalesce(next_up(F.col("value")), F.lit(0.0)))
    return found.select(*keys, threshold.alias("threshold"), "n_real")


def youden_threshold(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold of the largest TPR - FPR, the highest one on a tie, in [0, 1]."""
    gain = F.col("tp") / F.col("pos_total") - F.col("fp") / F.col("neg_total")
    best = points.groupBy(*keys).agg(F.max(F.struct(gain.alias("gain"), F.col("score"))).alias("best"))
    at = F.when(F.col("best.gain") > 0, F.greatest(F.least(F.col("best.score"), F.lit(1.0)), F.lit(0.0)))
    return best.select(*keys, at.otherwise(1.0).alias("threshold"))


def uncertainty_band(
    counts: DataFrame,
    keys: Sequence[str],
    threshold: float | Column,
    max_abstention: float = 0.15,
    target_error_capture: float = 0.5,
) -> DataFrame:
    """Smallest half-width in hundredths whose band holds the wanted share of errors.

    Only widths abstaining on at most `max_abstention` count; if none reaches the share, the widest
    of them. One pass: each score falls into the narrowest band that covers it.
    """
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    distance = F.abs(F.col("score") - t)
    first = reduce(lambda acc, k: acc + (distance >= k / 100).cast("int"), range(BAND_STEPS + 1), F.lit(0))
    wrong = F.when(F.col("score") >= t, F.col("neg")).otherwise(F.col("pos"))
    per_width = counts.groupBy(*keys, first.alias("k")).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum(wrong).alias("errors")
    )
    # at most 52 entries per group from here on
    cells = per_width.groupBy(*keys).agg(
        F.collect_list(F.struct("k", "n", "errors")).alias("cells"),
        F.sum("n").alias("n_all"),
        F.sum("errors").alias("errors_all"),
    )
    zero = F.lit(0).cast("bigint")
    steps = cells.select(*keys, "cells", "n_all", "errors_all", F.explode(F.sequence(F.lit(0), F.lit(BAND_STEPS))).alias("k"))

    def inside(field: str) -> Column:
        return F.aggregate("cells", zero, lambda acc, c: acc + F.when(c["k"] <= F.col("k"), c[field]).otherwise(0))

    widths = steps.select(
        *keys,
        (F.col("k") / 100).alias("delta"),
        (inside("n") / F.col("n_all")).alias("abstention"),
        F.when(F.col("errors_all") > 0, inside("errors") / F.greatest("errors_all", F.lit(1))).otherwise(1.0).alias("capture"),
    ).filter(F.col("abstention") <= max_abstention)
    full = F.struct("delta", "abstention", "capture")
    best = widths.groupBy(*keys).agg(
        F.min(F.when(F.col("capture") >= target_error_capture, full)).alias("reached"), F.max(full).alias("widest")
    )
    return best.select(*keys, F.coalesce("reached", "widest").alias("band")).select(*keys, "band.*")


def _values(*tables: DataFrame) -> dict[str, float]:
    """Numbers of several one-row tables by column, in one trip."""
    long = [t.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in t.columns]), F.array(*[F.col(c).cast("double") for c in t.columns]))).alias("name", "value")) for t in tables]
    return {r["name"]: r["value"] for r in reduce(DataFrame.unionByName, long).collect()}


@dataclass(frozen=True)
class Calibration:
    temperature: float
    threshold: float
    target_fpr: float
    achieved_fpr: float
    achieved_tpr: float
    youden_threshold: float
    uncertainty_delta: float
    abstention_rate: float
    errors_captured: float
    ece_before: float
    ece_after: float
    nll_before: float
    nll_after: float
    n: int


def calibrate(
    df: DataFrame,
    target_fpr: float = 0.05,
    max_abstention: float = 0.15,
    target_error_capture: float = 0.5,
) -> Calibration:
    """Fit everything on rows (`label`, `logit`) of one split.

    Besides the rounds of the temperature there are three trips to the driver, each for a few numbers: the sizes, what the curve
    gives (threshold and Youden's), and what follows from the threshold.
    """
    logits = score_counts(df, [], "logit").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        sizes = logits.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        if not sizes["pos"] or not sizes["neg"]:
            raise ValueError("calibration needs both classes")
        temperature = fit_temperature(logits)
        raw = logits.withColumn("score", sigmoid(F.col("score")))
        fitted = logits.withColumn("score", apply_calibration(F.col("score"), temperature))
        merged = fitted.groupBy("score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        points = keep(curve(merged, []))
        cuts = _values(threshold_for_fpr(points, [], target_fpr).select("threshold"), youden_threshold(points, []).select(F.col("threshold").alias("youden")))
        threshold = cuts["threshold"]
        found = _values(
            confusion(merged, [], threshold).select(F.col("tp").cast("double"), F.col("fp").cast("double")),
            uncertainty_band(merged, [], threshold, max_abstention, target_error_capture),
            logits.agg(nll_aggregate(1.0).alias("nll_before"), nll_aggregate(temperature).alias("nll_after")),
            ece(raw, []).select(F.col("ece").alias("ece_before")),
            ece(merged, []).select(F.col("ece").alias("ece_after")),
        )
        return Calibration(
            temperature=temperature,
            threshold=threshold,
            target_fpr=target_fpr,
            achieved_fpr=found["fp"] / sizes["neg"],
            achieved_tpr=found["tp"] / sizes["pos"],
            youden_threshold=cuts["youden"],
            uncertainty_delta=found["delta"],
            abstention_rate=found["abstention"],
            errors_captured=found["capture"],
            ece_before=found["ece_before"],
            ece_after=found["ece_after"],
            nll_before=found["nll_before"],
            nll_after=found["nll_after"],
            n=sizes["pos"] + sizes["neg"],
        )
    finally:
        logits.unpersist()
