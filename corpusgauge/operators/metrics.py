"""Metrics of scored binary predictions, per group, from counts per distinct score.

All of them start from `score_counts`: rows (keys, score, pos, neg). Counting happens map-side, so a
set holding most of the rows, or one score shared by many rows, costs no more than its distinct
scores.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.caching import keep
from corpusgauge.functions.decision import logit_nll
from corpusgauge.operators.ordering import running_totals, with_value_blocks

ECE_BINS = 15


def bin_edges(n_bins: int = ECE_BINS) -> list[float]:
    """Evenly spaced edges over [0, 1], first and last exact."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def score_counts(df: DataFrame, keys: Sequence[str], score: str = "prob", n: Column | None = None) -> DataFrame:
    weight = F.lit(1).cast("bigint") if n is None else n
    fake = F.col("label") == "fake"
    return df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(F.when(fake, weight).otherwise(0)).alias("pos"), F.sum(F.when(fake, 0).otherwise(weight)).alias("neg")
    )


def threshold_aggregates(threshold: Column | float) -> list[Column]:
    """tp, fp, fn, tn over score counts."""
    flagged = F.col("score") >= threshold
    return [
        F.sum(F.when(flagged, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(flagged, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(flagged, 0).otherwise(F.col("pos"))).alias("fn"),
        F.sum(F.when(flagged, 0).otherwise(F.col("neg"))).alias("tn"),
    ]


def _ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where undefined."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def rates(prefix: str = "") -> dict[str, Column]:
    """Derived metrics from the four counts (columns prefix + tp/fp/fn/tn)."""
    tp, fp, fn, tn = (F.col(prefix + c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return {
        prefix + "accuracy": _ratio(tp + tn, tp + fp + fn + tn),
        prefix + "balanced_accuracy": 0.5 * (recall + _ratio(tn, tn + fp)),
        prefix + "precision": precision,
        prefix + "recall_tpr": recall,
        prefix + "f1": _ratio(2 * precision * recall, precision + recall),
        prefix + "fpr": _ratio(fp, fp + tn),
    }


def confusion(counts: DataFrame, keys: Sequence[str], threshold: Column | float) -> DataFrame:
    return counts.groupBy(*keys).agg(*threshold_aggregates(threshold))


def threshold_metrics(counts: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    at = confusion(counts, keys, threshold)
    return at.withColumns({"threshold": F.lit(float(threshold)), **rates()})


def curve(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score counts with running totals from the highest score down.

    `tp`/`fp` are the rows at or above the score, `pos_total`/`neg_total` the group's classes.
    """
    turned = with_value_blocks(keep(counts).withColumn("_down", -F.col("score")), {"_down": "_at"})
    sums = {"pos": F.col("pos"), "neg": F.col("neg")}
    done = running_totals(turned, keys, ["_down"], sums, F.col("_at")).drop("_down", "_at")
    return done.withColumns({"tp": F.col("pos_before") + F.col("pos"), "fp": F.col("neg_before") + F.col("neg")})


def roc_curve(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, and the origin at threshold infinity."""
    rows = points.select(
        *keys,
        F.col("score").alias("threshold"),
        _ratio(F.col("fp"), F.col("neg_total")).alias("fpr"),
        _ratio(F.col("tp"), F.col("pos_total")).alias("tpr"),
    )
    origin = points.groupBy(*keys).agg(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return rows.unionByName(origin)


def ranking_aggregates(target_fpr: float = 0.05) -> list[Column]:
    """ROC-AUC (ties count half), average precision (step sum), TPR at a capped FPR; null for one class."""
    pos, neg = F.col("pos"), F.col("neg")
    p, n = F.max("pos_total"), F.max("neg_total")
    both = (p > 0) & (n > 0)
    wins = F.sum(neg.cast("double") * (F.col("pos_before") + pos / 2.0))
    precision = F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double"))
    allowed = _ratio(F.col("fp"), F.col("neg_total")) <= target_fpr
    hits = F.coalesce(F.max(F.when(allowed, F.col("tp"))), F.lit(0))
    return [
        F.when(both, F.try_divide(F.try_divide(wins, p.cast("double")), n.cast("double"))).alias("roc_auc"),
        F.when(both, F.try_divide(F.sum(pos * precision), p.cast("double"))).alias("pr_auc"),
        F.when(both, F.try_divide(hits.cast("double"), p.cast("double"))).alias("tpr_at_fpr"),
    ]


def ranking_metrics(points: DataFrame, keys: Sequence[str], target_fpr: float = 0.05) -> DataFrame:
    return points.groupBy(*keys).agg(*ranking_aggregates(target_fpr))


def bin_index(prob: Column, n_bins: int = ECE_BINS) -> Column:
    """Right-closed bins (low, high]; the first also holds 0."""
    inner = bin_edges(n_bins)[1:-1]
    return reduce(lambda acc, e: acc + (prob > e).cast("int"), inner, F.lit(0))


def _binned(counts: DataFrame, keys: Sequence[str], n_bins: int) -> DataFrame:
    n = F.col("pos") + F.col("neg")
    return counts.groupBy(*keys, bin_index(F.col("score"), n_bins).alias("bin")).agg(
        F.sum(n).alias("count"), F.sum(n * F.col("score")).alias("score_sum"), F.sum("pos").alias("pos_sum")
    )


def ece(counts: DataFrame, keys: Sequence[str], n_bins: int = ECE_BINS) -> DataFrame:
    """Expected calibration error: count-weighted |positive share - mean score| over the bins."""
    gap = F.sum(F.abs(F.col("pos_sum") - F.col("score_sum"))) / F.sum("count")
    return _binned(counts, keys, n_bins).groupBy(*keys).agg(gap.alias("ece"))


def reliability_bins(counts: DataFrame, keys: Sequence[str], n_bins: int = ECE_BINS) -> DataFrame:
    """One row per bin and group, empty bins included with null means."""
    edges = bin_edges(n_bins)
    layout = F.array(
        *[
            F.struct(F.lit(b).alias("bin"), F.lit(edges[b]).alias("bin_low"), F.lit(edges[b + 1]).alias("bin_high"))
            for b in range(n_bins)
        ]
    )
    filled = _binned(counts, keys, n_bins)
    every = filled.select(*keys).distinct().select(*keys, F.inline(layout))
    joined = every.join(filled, [*keys, "bin"], "left")
    return joined.select(
        *keys,
        "bin",
        "bin_low",
        "bin_high",
        F.coalesce("count", F.lit(0)).alias("count"),
        (F.col("score_sum") / F.col("count")).alias("mean_prob"),
        (F.col("pos_sum") / F.col("count")).alias("frac_positive"),
    )


def brier_aggregate() -> Column:
    s = F.col("score")
    total = F.sum(F.col("pos") * (s - 1.0) * (s - 1.0) + F.col("neg") * s * s)
    return (total / F.sum(F.col("pos") + F.col("neg"))).alias("brier")


def nll_aggregate(temperature: float | Column = 1.0) -> Column:
    """Mean cross-entropy; the counts must be over logits."""
    z = F.col("score")
    total = F.sum(
        F.col("pos") * logit_nll(z, F.lit(1.0), temperature) + F.col("neg") * logit_nll(z, F.lit(0.0), temperature)
    )
    return (total / F.sum(F.col("pos") + F.col("neg"))).alias("nll")


def full_report(counts: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Sizes, ranking metrics, Brier, ECE, and threshold metrics at the tuned value and at 0.5."""
    points = curve(counts, keys)

    def at(prefix: str, t: float) -> list[Column]:
        names = ("tp", "fp", "fn", "tn")
        # the curve's own tp/fp columns are running totals: count from pos/neg here
        flagged = F.col("score") >= t
        parts = ((flagged, "pos"), (flagged, "neg"), (~flagged, "pos"), (~flagged, "neg"))
        return [F.sum(F.when(c, F.col(v)).otherwise(0)).alias(prefix + k) for k, (c, v) in zip(names, parts, strict=True)]

    main = points.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("neg").alias("n_real"),
        F.sum("pos").alias("n_fake"),
        *ranking_aggregates(),
        brier_aggregate(),
        *at("tuned_", threshold),
        *at("half_", 0.5),
    )
    return main.withColumns({**rates("tuned_"), **rates("half_")}).join(ece(counts, keys), list(keys))


def robustness_metrics(df: DataFrame, keys: Sequence[str], threshold: float) -> DataFrame:
    """Metrics per group and grid point of a long prediction table."""
    groups = [*keys, "family", "level"]
    points = curve(score_counts(df, groups), groups)
    flagged = F.col("score") >= threshold
    cells = {"tp": (flagged, "pos"), "fp": (flagged, "neg"), "fn": (~flagged, "pos"), "tn": (~flagged, "neg")}
    sums = [F.sum(F.when(c, F.col(v)).otherwise(0)).alias(f"at_{k}") for k, (c, v) in cells.items()]
    table = points.groupBy(*groups).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), ranking_aggregates()[0], *sums
    )
    r = rates("at_")
    return table.select(
        *groups,
        "n",
        "roc_auc",
        r["at_balanced_accuracy"].alias("balanced_accuracy"),
        r["at_accuracy"].alias("accuracy"),
        r["at_fpr"].alias("fpr"),
        r["at_recall_tpr"].alias("tpr"),
    )
