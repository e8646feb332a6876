"""Evaluation sets cut from one table of predictions.

Besides the whole in-distribution, cross-generator and own sets there are swap sets: the known
reals with one new generator's fakes, or one new source's reals with the known fakes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.caching import keep

ID_DATASET = "140k"
CROSS_DATASET = "crossgen"
OWN_DATASET = "own"
MEMBER_COLUMNS = ("dataset", "split", "source", "label")


def compact_scores(df: DataFrame, score: str = "prob", extra: Sequence[str] = ()) -> DataFrame:
    """Count rows per membership column and score; every metric can start from these counts."""
    return df.groupBy(*extra, *MEMBER_COLUMNS, score).agg(F.count(F.lit(1)).alias("n"))


def _names(prefix: str, label: str, df: DataFrame) -> Column:
    """Swap set names, one per source of a label in the cross-generator data (a scalar array)."""
    sources = df.filter((F.col("dataset") == CROSS_DATASET) & (F.col("label") == label))
    named = F.transform(F.collect_set("source"), lambda s: F.concat(F.lit(prefix), s))
    return sources.agg(F.array_sort(named)).scalar()


def _memberships(df: DataFrame) -> Column:
    none = F.array().cast("array<string>")
    id_test = (F.col("dataset") == ID_DATASET) & (F.col("split") == "test")
    cross, own = F.col("dataset") == CROSS_DATASET, F.col("dataset") == OWN_DATASET
    real, fake = F.col("label") == "real", F.col("label") == "fake"
    swap = F.concat(F.col("label"), F.lit("_swap_"), F.col("source"))
    return F.concat(
        F.when(id_test, F.array(F.lit("id_test"))).otherwise(none),
        F.when(cross, F.array(F.lit("crossgen_full"), swap)).otherwise(none),
        F.when(own, F.array(F.lit("own"))).otherwise(none),
        F.when(id_test & real, _names("fake_swap_", "fake", df)).otherwise(none),
        F.when(id_test & fake, _names("real_swap_", "real", df)).otherwise(none),
    )


def build_test_sets(df: DataFrame) -> DataFrame:
    """One row per (row, set it belongs to), as column `test_set`; one-class sets are left out.

    Works on raw predictions and, far cheaper, on `compact_scores`.
    """
    kinds = keep(df.select(*MEMBER_COLUMNS).distinct())
    labels = kinds.select("label", F.explode(_memberships(kinds)).alias("test_set")).groupBy("test_set")
    complete = labels.agg(F.countDistinct("label").alias("n")).filter(F.col("n") == 2)
    usable = complete.agg(F.collect_set("test_set")).scalar()
    members = df.select("*", F.explode(_memberships(kinds)).alias("test_set"))
    return members.withColumn("_keep", usable).filter(F.array_contains("_keep", F.col("test_set"))).drop("_keep")


def per_source_rates(df: DataFrame, threshold: float, keys: Sequence[str] = ("test_set",), n: str = "n") -> DataFrame:
    """Share flagged per source and label: the FPR of a real source, the TPR of a fake one."""
    flagged = F.sum(F.when(F.col("prob") >= threshold, F.col(n)).otherwise(0))
    grouped = df.groupBy(*keys, "source", "label").agg(F.sum(n).alias("n"), flagged.alias("flagged"))
    return grouped.withColumn("rate", F.col("flagged") / F.col("n")).drop("flagged")
