"""Choosing: a model by a fixed rule, an epoch by patience, examples worth looking at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.operators.ordering import first_per_group, running_max, with_value_blocks


def summarize_models(report: DataFrame, intervals: DataFrame, latency: DataFrame, prefix: str = "fake_swap_") -> DataFrame:
    """Per model: AUC in distribution, mean AUC and lowest interval bound over the swap sets, latency.

    `report` (model, test_set, roc_auc), `intervals` (model, test_set, low), `latency` (model, p95).
    """
    rows = report.select("model", "test_set", "roc_auc").join(intervals.select("model", "test_set", "low"), ["model", "test_set"], "left")
    swap = F.col("test_set").startswith(prefix) & F.col("roc_auc").isNotNull()

    def only(name: str) -> Column:
        return F.max(F.when(F.col("test_set") == name, F.col("roc_auc")))

    grouped = rows.groupBy("model").agg(
        only("id_test").alias("id_auc"),
        F.avg(F.when(swap, F.col("roc_auc"))).alias("crossgen_mean_auc"),
        F.min(F.when(swap, F.col("low"))).alias("crossgen_min_auc_ci_low"),
        only("crossgen_full").alias("crossgen_full_auc"),
        only("own").alias("own_auc"),
    )
    return join_latency(grouped, latency)


def join_latency(models: DataFrame, latency: DataFrame) -> DataFrame:
    """Left join on the model name; models without a measurement keep a null."""
    return models.join(latency.select("model", F.col("p95").alias("p95_latency_ms")), "model", "left")


def select_model(models: DataFrame, margin: float = 0.03, budget_ms: float = 500.0) -> DataFrame:
    """One row per model with `excluded` (reason or null), `tied` and `winner`.

    Eligible: AUC in distribution within the margin of the best, latency known and within budget.
    The largest mean swap AUC leads; if others reach the leader's lowest interval bound, the fastest
    of them all wins. Without swap results the best in-distribution AUC wins. Equal values go by name.
    The table has one row per candidate model.
    """
    everyone = Window.partitionBy(F.lit(0))
    auc, ms, mean = F.col("id_auc"), F.col("p95_latency_ms"), F.col("crossgen_mean_auc")
    best = F.max("id_auc").over(everyone)
    excluded = (
        F.when(auc.isNull(), "no in-distribution AUC")
        .when(auc < best - margin, "AUC below margin")
        .when(ms.isNull(), "no latency measurement")
        .when(ms > budget_ms, "latency above budget")
    )
    judged = models.withColumn("excluded", excluded).withColumn("eligible", F.col("excluded").isNull())

    with_cross = F.col("eligible") & mean.isNotNull()
    lead_order = everyone.orderBy(F.when(with_cross, mean).desc_nulls_last(), F.when(F.col("eligible"), auc).desc_nulls_last(), "model")
    ranked = judged.withColumn("_place", F.row_number().over(lead_order)).withColumn("_cross", with_cross)
    any_cross = F.max("_cross").over(everyone)
    bound = F.max(F.when((F.col("_place") == 1) & F.col("_cross"), F.col("crossgen_min_auc_ci_low"))).over(everyone)
    contender = F.col("_cross") & ((F.col("_place") == 1) | F.coalesce(mean >= bound, F.lit(False)))
    tied = ranked.withColumn("_any", any_cross).withColumn("_contender", contender)

    fastest = everyone.orderBy(F.when(F.col("_contender"), ms).asc_nulls_last(), F.col("_place"))
    first = F.row_number().over(fastest) == 1
    winner = F.when(F.col("_any"), F.col("_contender") & first).otherwise(F.col("eligible") & (F.col("_place") == 1))
    n_contenders = F.count(F.when(F.col("_contender"), 1)).over(everyone)
    done = tied.withColumns({"winner": winner, "tied": F.col("_contender") & (n_contenders > 1)})
    return done.select(*models.columns, "excluded", "tied", "winner")


def early_stop(epochs: DataFrame, patience: int, run: str = "run", epoch: str = "epoch", auc: str = "val_auc") -> DataFrame:
    """Per run: best epoch and AUC, epochs run, and whether patience ended it.

    Epochs count from 1. Only a strictly better AUC resets patience, so the latest reset is the
    earliest epoch holding the running maximum.
    """
    rows = with_value_blocks(epochs.select(run, epoch, auc), {epoch: "_at"})
    here = F.struct(F.col(auc).alias("auc"), (-F.col(epoch)).alias("back"))
    seen = running_max(rows, [run], [epoch], {"best": here}, F.col("_at"))
    so_far = seen.select(run, epoch, F.greatest(F.col("best_before"), here).alias("best"))
    state = F.struct(F.col(epoch).alias("epochs_run"), F.col("best.auc").alias("best_auc"), (-F.col("best.back")).alias("best_epoch"))
    over = F.col(epoch) + F.col("best.back") >= patience
    ends = so_far.groupBy(run).agg(F.min(F.when(over, state)).alias("stop"), F.max(state).alias("last"))
    return ends.select(run, F.coalesce("stop", "last").alias("s"), F.col("stop").isNotNull().alias("stopped")).select(
        run, "s.best_epoch", "s.best_auc", "s.epochs_run", "stopped"
    )


def worst_errors(df: DataFrame, n: int, keys: Sequence[str] = ("test_set",), name: str = "rel_path") -> DataFrame:
    """Per set, the n/2 false positives with the highest and n/2 false negatives with the lowest scores."""
    errors = df.filter(F.col("outcome").isin("FP", "FN"))
    sure = F.when(F.col("outcome") == "FP", -F.col("prob")).otherwise(F.col("prob"))
    return first_per_group(errors.withColumn("_sure", sure), [*keys, "outcome"], ["_sure", name], n // 2).drop("_sure")


def outcome_counts(df: DataFrame, keys: Sequence[str] = ("test_set",)) -> DataFrame:
    return df.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("n"))
