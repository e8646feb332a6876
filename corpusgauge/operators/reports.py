"""Reports as tables of text, and as JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from corpusgauge.functions.formats import finite_or_null

PENDING = "TBD"
FIXED_SETS = ("id_test", "crossgen_full", "own")
ROBUSTNESS_PICKS = (("none", 0.0), ("jpeg_quality", 50.0), ("jpeg_quality", 30.0), ("downscale", 0.5), ("blur_sigma", 2.0))


def fixed_text(value: Column, digits: int = 3) -> Column:
    """Fixed-point text, rounding the exact binary value half to even (as C and Python print it).

    Spark's own formatting rounds the shortest decimal form half up. Twice the scaled value is an odd
    integer only near a tie; there the exact rounding error of the product (a split multiplication)
    decides the side.
    """
    scale = float(2 * 10**digits)
    product = value * scale
    high = value * 134217729.0 - (value * 134217729.0 - value)
    error = (high * scale - product) + (value - high) * scale
    near_tie = (product == F.floor(product)) & (F.pmod(product, F.lit(2.0)) == 1.0)
    down, up = (product - 1) / 2, (product + 1) / 2
    even = F.when(F.pmod(down, F.lit(2.0)) == 0.0, down).otherwise(up)
    tie = F.when(error > 0, up).when(error < 0, down).otherwise(even)
    whole = F.when(near_tie, tie).otherwise(F.floor(up))
    return F.format_string(f"%.{digits}f", whole / float(10**digits))


def cell(value: Column, digits: int = 3) -> Column:
    return F.when(value.isNotNull(), fixed_text(value, digits)).otherwise(PENDING)


def interval_cell(low: Column, high: Column) -> Column:
    both = low.isNotNull() & high.isNotNull()
    text = F.concat(F.lit("["), fixed_text(low), F.lit(", "), fixed_text(high), F.lit("]"))
    return F.when(both, text).otherwise(PENDING)


def _line(cells: Sequence[str]) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def metrics_document(report: DataFrame, models: Sequence[str]) -> DataFrame:
    """One text row per (model, test set): the model's own sets, the fixed sets for a model without results.

    `report` has model, test_set, n, roc_auc, ci_low, ci_high, balanced_accuracy, precision,
    recall_tpr, f1, fpr, ece.
    """
    grid = F.explode(F.array(*[F.lit(m) for m in models])).alias("model")
    wanted = report.sparkSession.range(1).select(grid)
    seen = report.select("model").distinct()
    fixed = F.explode(F.array(*[F.lit(s) for s in FIXED_SETS])).alias("test_set")
    empty = wanted.join(seen, "model", "left_anti").select("model", fixed)
    have = report.filter(F.col("model").isin(list(models)))
    rows = have.select("model", "test_set").unionByName(empty).join(have, ["model", "test_set"], "left")
    texts = {
        "n_text": F.coalesce(F.col("n").cast("string"), F.lit(PENDING)),
        "auc_text": cell(F.col("roc_auc")),
        "ci_text": interval_cell(F.col("ci_low"), F.col("ci_high")),
        **{f"{c}_text": cell(F.col(c)) for c in ("balanced_accuracy", "precision", "recall_tpr", "f1", "fpr", "ece")},
    }
    return rows.withColumns(texts).select("model", "test_set", _line(["test_set", *texts]).alias("line"))


def robustness_document(table: DataFrame, models: Sequence[str]) -> DataFrame:
    """Balanced accuracy at five fixed settings, one row per model."""
    spec = F.concat_ws("=", "family", F.format_string("%.1f", F.col("level")))
    names = [f"{family}={level:.1f}" for family, level in ROBUSTNESS_PICKS]
    wide = table.withColumn("setting", spec).groupBy("model").pivot("setting", names).agg(F.max("balanced_accuracy"))
    grid = table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    filled = grid.join(wide, "model", "left")
    texts = {f"t{i}": cell(F.col(f"`{name}`")) for i, name in enumerate(names)}
    return filled.withColumns(texts).select("model", _line(["model", *texts]).alias("line"))


def selection_document(selected: DataFrame) -> DataFrame:
    texts = {
        "t0": cell(F.col("id_auc")),
        "t1": cell(F.col("crossgen_mean_auc")),
        "t2": cell(F.col("own_auc")),
        "t3": cell(F.col("p95_latency_ms"), 0),
    }
    return selected.withColumns(texts).select("model", _line(["model", *texts]).alias("line"), "winner")


def audit_document(long: DataFrame) -> DataFrame:
    """Feature sets as rows: both AUCs and the three strongest features."""
    auc = (F.col("measure") == "auc_mean") & F.col("value").isNotNull()
    top = F.when(F.col("measure") == "importance", F.struct((-F.col("value")).alias("drop"), "name"))
    grouped = long.groupBy("feature_set").agg(
        F.max(F.when(auc & (F.col("name") == "logistic_regression"), F.col("value"))).alias("linear"),
        F.max(F.when(auc & (F.col("name") == "gradient_boosting"), F.col("value"))).alias("boosted"),
        F.slice(F.array_sort(F.collect_list(top)), 1, 3).alias("top"),
    )
    names = F.when(F.size("top") > 0, F.concat_ws(", ", F.transform("top", lambda t: t["name"]))).otherwise(PENDING)
    texts = {"t0": cell(F.col("linear")), "t1": cell(F.col("boosted")), "t2": names}
    return grouped.withColumns(texts).select("feature_set", _line(["feature_set", *texts]).alias("line"))


def report_json(df: DataFrame, name: str = "json") -> DataFrame:
    """One JSON object per row, nulls written out, NaN and infinities as null."""
    clean = [
        (finite_or_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name))
        for f in df.schema.fields
    ]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias(name))


def write_report(df: DataFrame, path: str) -> None:
    report_json(df, "value").write.mode("overwrite").text(path)
