"""Small classifiers: the shortcut test on features and the linear probe on embeddings."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Model
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.caching import keep, written
from corpusgauge.functions.decision import label_to_int, probe_logit
from corpusgauge.functions.hashing import stable_hex
from corpusgauge.operators.boosting import Fit, Line, Rows, bin_cuts, boost, raw_scores, raw_tree, regress, sigmoid, with_bins
from corpusgauge.operators.metrics import curve, ranking_metrics, score_counts
from corpusgauge.operators.ordering import hash_block, ranked

#: Cells of a task in the many passes of a fit: its rows, times the features of all fits.
CELLS_PER_TASK = 2_400_000
REPORT = "feature_set string, measure string, name string, value double"


@dataclass
class ClassifierReport:
    feature_set: str
    n_samples: int
    features: list[str]
    constant: list[str]
    auc: dict[str, dict[str, float]] = field(default_factory=dict)
    top_features: list[tuple[str, float]] = field(default_factory=list)
    all_constant: bool = False

    def rows(self) -> list[tuple[str, str, str, float]]:
        """Long rows (feature_set, measure, name, value)."""
        out = [("n_samples", "", float(self.n_samples)), *[("constant", c, 1.0) for c in self.constant]]
        out += [(f"auc_{part}", model, v) for model, parts in self.auc.items() for part, v in parts.items()]
        out += [("importance", name, drop) for name, drop in self.top_features]
        return [(self.feature_set, *r) for r in out]

    def to_df(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(self.rows(), REPORT)


def auc_of(df: DataFrame, score: Column) -> float:
    """ROC-AUC of a scored table with a `label` column."""
    counts = score_counts(df.select("label", score.alias("prob")), [])
    return ranking_metrics(curve(counts, []), []).first()["roc_auc"]


def population_scale(train: DataFrame, vector: str) -> tuple[list[float], list[float]]:
    """Mean and population standard deviation per dimension; 1 where nothing varies."""
    s = train.select(Summarizer.metrics("mean", "variance", "count").summary(F.col(vector)).alias("s")).first()["s"]
    shrink = (s["count"] - 1) / s["count"]
    return [float(m) for m in s["mean"]], [float((v * shrink) ** 0.5) or 1.0 for v in s["variance"]]


def _standardised(df: DataFrame, x: str, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    centre, scale = (F.array(*[F.lit(v) for v in values]) for values in (mean, std))
    moved = F.zip_with(F.zip_with(x, centre, lambda a, m: a - m), scale, lambda a, s: a / s)
    return df.withColumn("scaled", array_to_vector(moved))


def _logistic(train: DataFrame, c: float, n: int) -> Model:
    """Ridge-penalised logistic regression with inverse strength c on standardised features."""
    lr = LogisticRegression(
        featuresCol="scaled", labelCol="y", regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-6
    )
    return lr.fit(train)


@dataclass
class _Table:
    """Prepared rows of some feature sets: x, bins, y, fold, quarter, complete (per set), rank."""

    rows: DataFrame
    names: list[str]
    sets: dict[str, list[int]]
    reports: list[ClassifierReport]
    key: str


def _prepared(df: DataFrame, sets: Mapping[str, Sequence[str]], key: str, folds: int, seed: int) -> _Table:
    """One table for all sets. Folds and the held-out quarter come from hash ranks per label over all rows, so they don't depend on row order."""
    names = list(dict.fromkeys(c for columns in sets.values() for c in columns))
    plain = keep(df.select(F.col(key).alias("key"), "label", *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(names)]))
    sizes = {r["label"]: r["n"] for r in plain.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(3).collect()}
    if min(sizes.get("real", 0), sizes.get("fake", 0)) < folds:
        raise ValueError(f"need at least {folds} rows per class, got {sizes}")
    own = {name: [names.index(c) for c in columns] for name, columns in sets.items()}

    def whole(columns: Sequence[int]) -> Column:
        out = F.lit(True)
        for i in columns:
            out = out & F.col(f"f{i}").isNotNull() & ~F.isnan(f"f{i}")
        return F.coalesce(out, F.lit(False))

    # per set: rows, and which of its features vary among its rows
    asked = []
    for at, columns in enumerate(own.values()):
        asked.append(F.count_if(whole(columns)).alias(f"n{at}"))
        asked += [F.coalesce(F.min(F.when(whole(columns), F.col(f"f{i}"))) == F.max(F.when(whole(columns), F.col(f"f{i}"))), F.lit(True)).alias(f"c{at}_{i}") for i in columns]
    found = plain.agg(*asked).first()
    reports, used = [], {}
    for at, (name, columns) in enumerate(own.items()):
        used[name] = [i for i in columns if not found[f"c{at}_{i}"]]
        reports.append(ClassifierReport(name, found[f"n{at}"], [names[i] for i in used[name]], [names[i] for i in columns if found[f"c{at}_{i}"]]))

    cuts = bin_cuts(plain, [f"f{i}" for i in range(len(names))])
    hashed = plain.withColumn("_h", stable_hex(F.col("key"), seed))
    placed = ranked(hashed, ["label"], ["_h", "key"], hash_block(F.col("_h")))
    complete = [F.when(whole(columns), 1.0).otherwise(0.0) for columns in own.values()]
    rows = placed.select(
        "key",
        "label",
        "rank",
        F.array(*[F.coalesce(f"f{i}", F.lit(float("nan"))) for i in range(len(names))]).alias("x"),
        label_to_int(F.col("label")).cast("double").alias("y"),
        (F.col("rank") % folds).cast("int").alias("fold"),
        (F.col("rank") % 4 == 0).alias("quarter"),
        F.array(*complete).alias("complete"),
    )
    cells = sum(sizes.values()) * sum(len(columns) for columns in own.values()) * (folds + 1)
    kept = keep(written(with_bins(rows.repartition(max(1, -(-cells // CELLS_PER_TASK)), "key"), "x", cuts), "binned"))
    return _Table(kept, names, used, reports, key)


def _emitted(columns: dict[str, np.ndarray | list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def _held_out_scores(table: _Table, boosters: list[Fit], lines: list[Line]) -> DataFrame:
    """(of_set, model, fold, label, prob) of every row by the models that have not seen it."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, label = Rows.of(b), b.column(b.schema.get_field_index("label"))
            for fit, line in zip(boosters, lines, strict=True):
                at = np.flatnonzero(rows.complete[:, fit.of_set] & (rows.fold == fit.fold))
                found = {"gradient_boosting": sigmoid(fit.base + raw_scores(fit, rows.bins[at])), "logistic_regression": line.probabilities(rows.x[at])}
                for name, prob in found.items():
                    yield _emitted({"of_set": np.full(len(at), fit.of_set, np.int32), "model": [name] * len(at), "fold": np.full(len(at), fit.fold, np.int32), "label": label.take(pa.array(at)), "prob": prob})

    return table.rows.mapInArrow(go, "of_set int, model string, fold int, label string, prob double")


def _shuffled_scores(table: _Table, fits: list[Fit], seed: int, repeats: int) -> DataFrame:
    """(of_set, feature, repeat, label, prob) on the held-out quarter: one feature takes another row's value; feature -1: none does.

    Rows stand in hash order; repeat r pairs each with the row a hashed distance further on, so one join serves
    every feature of every set. A row whose partner lacks the feature keeps its own value.
    """
    quarter = table.rows.filter("quarter").select("key", "label", "bins", "complete").withColumn("_h", stable_hex(F.col("key"), seed + 1)).withColumn("_all", F.lit(1))
    placed = written(ranked(quarter, ["_all"], ["_h", "key"], hash_block(F.col("_h"))), "quarter")
    n = placed.count()
    steps = F.array(*[F.lit(1 + (n * (r + 1)) // (repeats + 1)).cast("bigint") for r in range(repeats)])
    moved = placed.select("label", "rank", "bins", "complete", F.posexplode(steps).alias("repeat", "step")).withColumn("_from", F.pmod(F.col("rank") + F.col("step"), F.lit(n)) + 1)
    donors = placed.select(F.col("rank").alias("_from"), F.col("bins").alias("other"), F.col("complete").alias("other_complete"))
    both = moved.join(donors, "_from").select("label", "repeat", "bins", "complete", "other", "other_complete")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            label, repeat = b.column(0), b.column(1).to_numpy()
            own, other = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(len(b), -1) for i in (2, 4))
            mine, theirs = (b.column(i).flatten().to_numpy().reshape(len(b), -1) > 0 for i in (3, 5))
            for fit in fits:
                at = np.flatnonzero(mine[:, fit.of_set])
                there, labels = theirs[at, fit.of_set], label.take(pa.array(at))
                columns = np.ascontiguousarray(own[at].T)
                plain = [raw_tree(fit, columns, t) for t in range(len(fit.feature))]
                for feature in (-1, *fit.columns):
                    score, moved_ = np.zeros(len(at)), columns
                    if feature >= 0:
                        moved_ = columns.copy()
                        moved_[feature] = np.where(there, other[at, feature], columns[feature])
                    for t, as_before in enumerate(plain):  # a tree without the feature gives what it gave
                        score += raw_tree(fit, moved_, t) if feature >= 0 and (fit.feature[t] == feature).any() else as_before
                    prob = sigmoid(fit.base + score)
                    yield _emitted({"of_set": np.full(len(at), fit.of_set, np.int32), "feature": np.full(len(at), feature, np.int32), "repeat": repeat[at].astype(np.int32), "label": labels, "prob": prob})

    return both.mapInArrow(go, "of_set int, feature int, repeat int, label string, prob double")


def _drops(scored: DataFrame, table: _Table) -> DataFrame:
    """(of_set, feature, auc_drop): mean loss of AUC over the repeats."""
    groups = ["of_set", "feature", "repeat"]
    found = ranking_metrics(curve(score_counts(scored, groups), groups), groups).select(*groups, "roc_auc")
    before = found.filter("feature = -1").select("of_set", "repeat", F.col("roc_auc").alias("before"))
    drops = found.filter("feature >= 0").join(before, ["of_set", "repeat"]).groupBy("of_set", "feature").agg(F.avg(F.col("before") - F.col("roc_auc")).alias("auc_drop"))
    names = F.array(*[F.lit(x) for x in table.names])
    return drops.select("of_set", F.element_at(names, F.col("feature") + 1).alias("feature"), "auc_drop")


def shortcut_tests(
    df: DataFrame, sets: Mapping[str, Sequence[str]], key: str, folds: int = 5, seed: int = 42, rounds: int = 100, importance: bool = True
) -> list[ClassifierReport]:
    """Can these features alone tell the label? Cross-validated AUC of a linear and a boosted model for every feature set.

    All folds of all sets, and the fits behind the importances, grow in the same passes over the table. A set leaves
    out its rows with a missing feature and its constant features (`key` identifies a row).
    """
    table = _prepared(df, sets, key, folds, seed)
    by_set = list(table.sets.items())
    crossed = [Fit(columns, at, k) for at, (_, columns) in enumerate(by_set) if columns for k in range(folds)]
    for report in table.reports:
        if not report.features:
            report.auc = {m: {"mean": 0.5, "std": 0.0} for m in ("logistic_regression", "gradient_boosting")}
            report.all_constant = True
    if not crossed:
        return table.reports
    quarters = [Fit(columns, at, None) for at, (_, columns) in enumerate(by_set) if columns] if importance else []
    lines = regress(table.rows, crossed)
    boost(table.rows, crossed + quarters, rounds)
    groups = ["of_set", "model", "fold"]
    counts = score_counts(_held_out_scores(table, crossed, lines), groups)
    per_fold = ranking_metrics(curve(counts, groups), groups)
    spread = per_fold.groupBy("of_set", "model").agg(F.avg("roc_auc").alias("mean"), F.stddev_pop("roc_auc").alias("std"))
    for r in spread.collect():  # two rows per set
        table.reports[r["of_set"]].auc[r["model"]] = {"mean": r["mean"], "std": r["std"]}
    if quarters:
        drops = _drops(_shuffled_scores(table, quarters, seed, 5), table).collect()  # a row per set and feature
        for at, report in enumerate(table.reports):
            own = sorted(((r["feature"], r["auc_drop"]) for r in drops if r["of_set"] == at), key=lambda x: (-x[1], x[0]))
            report.top_features = own[:5]
    return table.reports


def trivial_classifier(df: DataFrame, features: Sequence[str], key: str, feature_set: str = "features", **options: object) -> ClassifierReport:
    """The shortcut test on one feature set."""
    return shortcut_tests(df, {feature_set: features}, key, **options)[0]


def audit_compare(df: DataFrame, sets: Mapping[str, Sequence[str]], key: str, **options: object) -> DataFrame:
    """The shortcut test on several feature sets (metadata, pixels, without file size, raw and processed), one long table."""
    rows = [x for report in shortcut_tests(df, sets, key, **options) for x in report.rows()]
    return df.sparkSession.createDataFrame(rows, REPORT)


def permutation_importance(df: DataFrame, features: Sequence[str], key: str, seed: int = 42, rounds: int = 100, repeats: int = 5) -> DataFrame:
    """(feature, auc_drop) of a boosted model: how much AUC on the quarter it has not seen goes when a feature takes another row's value."""
    table = _prepared(df, {"features": features}, key, 1, seed)
    fits = [Fit(columns, 0, None) for columns in table.sets.values() if columns]
    if not fits:
        return df.sparkSession.createDataFrame([], "feature string, auc_drop double")
    boost(table.rows, fits, rounds)
    return _drops(_shuffled_scores(table, fits, seed, repeats), table).drop("of_set")


@dataclass(frozen=True)
class Probe:
    weights: list[float]
    bias: float
    best_c: float
    auc_by_c: dict[float, float]


def linear_probe(df: DataFrame, c_grid: Sequence[float] = (0.001, 0.01, 0.1, 1.0, 10.0)) -> Probe:
    """Logistic regression on embeddings (`x`, `label`, `split` train/val), strength by validation AUC.

    The scaling is folded into the weights, so the result scores raw vectors; the first best wins.
    """
    rows = df.withColumns({"y": label_to_int(F.col("label")).cast("double"), "vector": array_to_vector("x")})
    train, val = rows.filter(F.col("split") == "train"), rows.filter(F.col("split") == "val")
    mean, std = population_scale(train, "vector")
    scaled = _standardised(train, "x", mean, std).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = scaled.count()
        fitted = []
        for c in c_grid:
            model = _logistic(scaled, c, n)
            weights = [float(w) / s for w, s in zip(model.coefficients, std, strict=True)]
            bias = float(model.intercept) - sum(w * m for w, m in zip(weights, mean, strict=True))
            auc = auc_of(val, probe_logit(F.col("x"), F.array(*[F.lit(w) for w in weights]), bias))
            fitted.append((auc, weights, bias, c))
        # of equal AUCs the one that stands first in the grid
        top = max(range(len(fitted)), key=lambda i: (fitted[i][0], -i))
        _, weights, bias, c = fitted[top]
        return Probe(weights, bias, c, {x[3]: x[0] for x in fitted})
    finally:
        scaled.unpersist()


def probe_score(df: DataFrame, weights: Sequence[float], bias: float) -> DataFrame:
    return df.withColumn("logit", probe_logit(F.col("x"), F.array(*[F.lit(float(w)) for w in weights]), bias))
