"""Bootstrap intervals: resampling within each class, sizes kept.

Drawing n rows out of n with replacement is one multinomial draw of row counts, and rows with equal
scores can be drawn together. So the work happens on distinct scores: they are cut into blocks of
bounded size along the score, each replicate's draws are first dealt to the blocks and then, inside
a block's task, to its scores. A replicate is a pure function of (seed, group, block, replicate), and
what leaves a task is one row of partial sums per replicate, never a resampled table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.caching import keep
from corpusgauge.operators.ordering import ranked, with_value_blocks

SCORES_PER_BLOCK = 20_000
REPLICATES_PER_TASK = 125


def _deal(seed: int, group: str, replicate: int, totals: np.ndarray) -> np.ndarray:
    """How many of a class's draws fall into each block: the same answer in every task."""
    n = int(totals.sum())
    rng = np.random.default_rng([seed, zlib.crc32(group.encode()), replicate])
    return rng.multinomial(n, totals / n) if n else totals


def _draw(seed: int, group: str, block: int, replicate: int, cls: int, n: int, counts: np.ndarray) -> np.ndarray:
    total = counts.sum()
    if not total or not n:
        return np.zeros(len(counts), dtype=np.int64)
    rng = np.random.default_rng([seed, zlib.crc32(group.encode()), replicate, block + 1, cls + 1])
    return rng.multinomial(n, counts / total)


def _prepared(counts: DataFrame, keys: Sequence[str], n_boot: int) -> tuple[DataFrame, dict[str, list]]:
    """Scores with `_group`, `_block` and `_part` (a share of the replicates), and block totals by group."""
    group = F.concat_ws("|", F.lit(""), *[F.col(k).cast("string") for k in keys])
    named = keep(counts.withColumn("_group", group))
    n_scores = named.count()
    size = SCORES_PER_BLOCK  # the same for every group, whatever stands beside it
    if n_scores <= size:
        placed = named.withColumn("_block", F.lit(0))
    else:
        # exact ranks, so that a block is the same set of scores in every run
        turned = with_value_blocks(named, {"score": "_at"})
        in_order = ranked(turned, ["_group"], ["score"], F.col("_at"))
        placed = keep(in_order.withColumn("_block", F.floor((F.col("rank") - 1) / size).cast("int")).drop("rank", "rank_total", "_at"))
    sums = placed.groupBy("_group", "_block").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals: dict[str, list] = {}
    for r in sums.orderBy("_group", "_block").collect():  # one row per (group, block)
        totals.setdefault(r["_group"], []).append((r["_block"], r["pos"], r["neg"]))
    parts = F.sequence(F.lit(0), F.lit((n_boot - 1) // REPLICATES_PER_TASK))
    return placed.withColumn("_part", F.explode(parts)), totals


def _weights(pdf: pd.DataFrame, totals: dict[str, list], n_boot: int, seed: int) -> Iterator[tuple]:
    """(replicate, positive draws, negative draws) over the rows of one (group, block, part).

    `pdf` must be in score order: draws go to rows by position.
    """
    group, block, part = pdf["_group"].iat[0], int(pdf["_block"].iat[0]), int(pdf["_part"].iat[0])
    listed = totals[group]
    at = [b for b, _, _ in listed].index(block)
    shares = [np.array([row[c] for row in listed], dtype=np.float64) for c in (1, 2)]
    counts = [pdf[c].to_numpy(dtype=np.float64) for c in ("pos", "neg")]
    for r in range(part * REPLICATES_PER_TASK, min(n_boot, (part + 1) * REPLICATES_PER_TASK)):
        drawn = []
        for cls in (0, 1):
            n = int(_deal(seed + cls, group, r, shares[cls])[at])
            drawn.append(_draw(seed, group, block, r, cls, n, counts[cls]))
        yield r, drawn[0], drawn[1]


def replicate_weights(counts: DataFrame, keys: Sequence[str], n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Every replicate's counts per score: keys, score, replicate, pos, neg. The hook for own metrics.

    Group it by (keys, replicate) and aggregate as the metric needs, then take `interval`.
    """
    ready, totals = _prepared(counts, keys, n_boot)
    types = dict(counts.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "score double", "replicate int", "pos bigint", "neg bigint"])

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score")
        out = [
            pdf[[*keys, "score"]].assign(replicate=np.int32(r), pos=p, neg=n)[(p > 0) | (n > 0)]
            for r, p, n in _weights(pdf, totals, n_boot, seed)
        ]
        return pd.concat(out)

    return ready.groupBy("_group", "_block", "_part").applyInPandas(task, schema)


def bootstrap_replicates(
    counts: DataFrame, keys: Sequence[str], threshold: float, n_boot: int = 1000, seed: int = 42
) -> DataFrame:
    """ROC-AUC and balanced accuracy of every replicate; groups lacking a class give none.

    A block adds its own wins and, through the totals of the blocks below, the wins against them.
    """
    ready, totals = _prepared(counts, keys, n_boot)
    usable = {g: rows for g, rows in totals.items() if sum(r[1] for r in rows) and sum(r[2] for r in rows)}
    types = dict(counts.dtypes)
    names = [*keys]
    schema = ", ".join(
        [*[f"`{k}` {types[k]}" for k in names], "_block int, replicate int, pos double, neg double, wins double, hit double, passed double"]
    )

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        pdf = pdf.sort_values("score")
        if pdf["_group"].iat[0] in usable:
            over = pdf["score"].to_numpy() >= threshold
            for r, p, n in _weights(pdf, totals, n_boot, seed):
                below = np.cumsum(n) - n
                rows.append((r, p.sum(), n.sum(), (p * (below + n / 2.0)).sum(), p[over].sum(), n[~over].sum()))
        out = pd.DataFrame(rows, columns=["replicate", "pos", "neg", "wins", "hit", "passed"])
        out.insert(0, "_block", int(pdf["_block"].iat[0]))
        for k in reversed(names):
            out.insert(0, k, pdf[k].iat[0])
        return out.astype({c: "float64" for c in ("pos", "neg", "wins", "hit", "passed")} | {"replicate": "int32", "_block": "int32"})

    partial = ready.groupBy("_group", "_block", "_part").applyInPandas(task, schema)
    lower = Window.partitionBy(*names, "replicate").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("wins") + F.col("pos") * F.coalesce(F.sum("neg").over(lower), F.lit(0.0))
    whole = partial.withColumn("wins", wins).groupBy(*names, "replicate").agg(
        *[F.sum(c).alias(c) for c in ("pos", "neg", "wins", "hit", "passed")]
    )
    return whole.select(
        *names,
        "replicate",
        (F.col("wins") / F.col("pos") / F.col("neg")).alias("roc_auc"),
        (0.5 * (F.col("hit") / F.col("pos") + F.col("passed") / F.col("neg"))).alias("balanced_accuracy"),
    )


def interval(replicates: DataFrame, keys: Sequence[str], metrics: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Percentile interval per metric, long form; a group has one value per replicate."""
    long = replicates.unpivot([*keys, "replicate"], list(metrics), "metric", "value")
    ends = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return long.groupBy(*keys, "metric").agg(ends.alias("ends")).select(
        *keys, "metric", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high")
    )


def report_with_intervals(
    report: DataFrame, counts: DataFrame, keys: Sequence[str], threshold: float, n_boot: int = 1000, seed: int = 42, alpha: float = 0.05
) -> DataFrame:
    """A report with the percentile intervals of its ROC-AUC and balanced accuracy as columns <metric>_low and <metric>_high; null for one class.

    The replicates of a group become its four numbers in one aggregation, joined as columns; null keys meet too.
    """
    ends = F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))
    names = ["roc_auc", "balanced_accuracy"]
    found = bootstrap_replicates(counts, keys, threshold, n_boot, seed).groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[F.percentile(m, ends).alias(f"_{m}") for m in names])
    joined = report.join(found, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    sides = [F.col(f"_{m}")[i].alias(f"{m}_{side}") for m in names for i, side in enumerate(("low", "high"))]
    return joined.select(*report.columns, *sides)


def bootstrap_ci(
    counts: DataFrame, keys: Sequence[str], threshold: float, n_boot: int = 1000, seed: int = 42, alpha: float = 0.05
) -> DataFrame:
    """Intervals of ROC-AUC and balanced accuracy per group of score counts."""
    values = bootstrap_replicates(counts, keys, threshold, n_boot, seed)
    return interval(values, keys, ["roc_auc", "balanced_accuracy"], alpha)
