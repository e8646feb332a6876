import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import bootstrap, calibration, metrics, test_sets
from corpusgauge.operators.robustness import expand_grid, grid_steps


def sample(n=400, seed=0, ties=True):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.4).astype(int)
    z = rng.normal(size=n) + 1.2 * y
    if ties:
        z = z.round(1)
    p = 1 / (1 + np.exp(-z))
    return pd.DataFrame({"label": np.where(y == 1, "fake", "real"), "y": y, "logit": z, "prob": p})


def auc(y, p):
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    return ((pos > neg) + 0.5 * (pos == neg)).mean()


def average_precision(y, p):
    total, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        hit = p >= t
        recall = (hit & (y == 1)).sum() / y.sum()
        total += (recall - last) * (hit & (y == 1)).sum() / hit.sum()
        last = recall
    return total


@pytest.fixture(scope="module")
def scored(spark):
    frames = [sample(seed=s).assign(g=f"g{s}") for s in range(3)]
    pdf = pd.concat(frames, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(6)


def test_ranking_metrics(scored):
    pdf, df = scored
    points = metrics.curve(metrics.score_counts(df, ["g"]), ["g"])
    for r in metrics.ranking_metrics(points, ["g"]).collect():
        part = pdf[pdf["g"] == r["g"]]
        y, p = part["y"].to_numpy(), part["prob"].to_numpy()
        assert r["roc_auc"] == pytest.approx(auc(y, p)) and r["pr_auc"] == pytest.approx(average_precision(y, p))
        best = max((p[y == 1] >= t).mean() for t in [*p, 2.0] if (p[y == 0] >= t).mean() <= 0.05)
        assert r["tpr_at_fpr"] == pytest.approx(best)
    origin = metrics.roc_curve(points, ["g"]).filter(F.col("threshold") == float("inf")).collect()
    assert [(r["fpr"], r["tpr"]) for r in origin] == [(0.0, 0.0)] * 3


def test_one_class_gives_nulls(spark):
    df = spark.createDataFrame([("real", 0.2), ("real", 0.7)], "label string, prob double")
    row = metrics.ranking_metrics(metrics.curve(metrics.score_counts(df, []), []), []).first()
    assert (row["roc_auc"], row["pr_auc"], row["tpr_at_fpr"]) == (None, None, None)
    at = metrics.threshold_metrics(metrics.score_counts(df, []), [], 0.5).first()
    assert (at["recall_tpr"], at["precision"], at["f1"], at["fpr"], at["accuracy"]) == (0.0, 0.0, 0.0, 0.5, 0.5)


def test_bins_are_right_closed(spark):
    edges = metrics.bin_edges()
    values = [0.0, 1.0, *edges[1:-1], *[np.nextafter(e, 2) for e in edges[1:-1]]]
    df = spark.createDataFrame([(float(v),) for v in values], "p double")
    got = [r["b"] for r in df.select(metrics.bin_index(F.col("p")).alias("b")).collect()]
    want = np.digitize(values, np.linspace(0, 1, 16)[1:-1], right=True)
    assert got == list(want)


def test_ece_and_reliability(scored):
    pdf, df = scored
    counts = metrics.score_counts(df, ["g"])
    got = {r["g"]: r["ece"] for r in metrics.ece(counts, ["g"]).collect()}
    inner = np.linspace(0, 1, 16)[1:-1]
    for g, part in pdf.groupby("g"):
        b = np.digitize(part["prob"], inner, right=True)
        want = sum((b == k).mean() * abs(part["y"][b == k].mean() - part["prob"][b == k].mean()) for k in set(b))
        assert got[g] == pytest.approx(want)
    table = metrics.reliability_bins(counts, ["g"]).toPandas()
    assert len(table) == 45 and table["count"].sum() == len(pdf) and table[table["count"] == 0]["mean_prob"].isna().all()


def test_threshold_flags_no_more_than_allowed(scored):
    pdf, df = scored
    points = metrics.curve(metrics.score_counts(df, ["g"]), ["g"])
    for target in (0.0, 0.05, 0.3):
        for r in calibration.threshold_for_fpr(points, ["g"], target).collect():
            real = np.sort(pdf[(pdf["g"] == r["g"]) & (pdf["y"] == 0)]["prob"])[::-1]
            k = math.floor(target * len(real))
            assert r["threshold"] == np.nextafter(real[k], np.inf)
            assert (real >= r["threshold"]).sum() <= k
    assert {r["threshold"] for r in calibration.threshold_for_fpr(points, ["g"], 1.0).collect()} == {0.0}
    with pytest.raises(Exception, match="no real rows"):
        fakes = metrics.curve(metrics.score_counts(df.filter("label = 'fake'"), []), [])
        calibration.threshold_for_fpr(fakes, [], 0.05).collect()


def test_next_up_is_nextafter(spark):
    values = [10.0 ** -k * m for k in range(1, 12) for m in (1.0, 1.7, 3.3, 9.99)] + [0.5, 0.25, 1.0, 2.0**-30]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for r in df.select("x", calibration.next_up(F.col("x")).alias("up")).collect():
        assert r["up"] == math.nextafter(r["x"], math.inf)


def band_by_hand(p, y, t, budget, target):
    wrong, best = (p >= t) != (y == 1), (0.0, 0.0, 0.0)
    for k in range(51):
        inside = np.abs(p - t) < k / 100
        if inside.mean() > budget:
            break
        capture = (inside & wrong).sum() / wrong.sum() if wrong.any() else 1.0
        best = (k / 100, inside.mean(), capture)
        if capture >= target:
            break
    return best


@pytest.mark.parametrize(("budget", "target"), [(0.15, 0.5), (0.3, 0.2), (1.0, 1.0), (0.0, 0.5)])
def test_uncertainty_band(scored, budget, target):
    pdf, df = scored
    counts = metrics.score_counts(df, ["g"])
    for r in calibration.uncertainty_band(counts, ["g"], 0.6, budget, target).collect():
        part = pdf[pdf["g"] == r["g"]]
        want = band_by_hand(part["prob"].to_numpy(), part["y"].to_numpy(), 0.6, budget, target)
        assert (r["delta"], r["abstention"], r["capture"]) == pytest.approx(want)


def test_band_without_errors(spark):
    df = spark.createDataFrame([("real", 0.1), ("fake", 0.9)], "label string, prob double")
    row = calibration.uncertainty_band(metrics.score_counts(df, []), [], 0.5).first()
    assert (row["delta"], row["abstention"], row["capture"]) == (0.0, 0.0, 1.0)


def nll(z, y, t):
    z = z / t
    return np.mean(np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))


@pytest.mark.parametrize("stretch", [0.3, 1.0, 4.0])
def test_temperature_minimises_nll(spark, stretch):
    pdf = sample(1500, 5, ties=False)
    pdf["logit"] *= stretch
    t = calibration.fit_temperature(metrics.score_counts(spark.createDataFrame(pdf), [], "logit"))
    grid = np.exp(np.linspace(-3, 3, 4001))
    best = grid[np.argmin([nll(pdf["logit"].to_numpy(), pdf["y"].to_numpy(), g) for g in grid])]
    assert t == pytest.approx(best, rel=2e-3)


def test_temperature_stops_at_its_bounds(spark):
    right = spark.createDataFrame([("fake", 1.0), ("real", -1.0)], "label string, logit double")
    wrong = spark.createDataFrame([("fake", -1.0), ("real", 1.0)], "label string, logit double")
    assert calibration.fit_temperature(metrics.score_counts(right, [], "logit")) == pytest.approx(math.exp(-3), rel=1e-3)
    assert calibration.fit_temperature(metrics.score_counts(wrong, [], "logit")) == pytest.approx(math.exp(3), rel=1e-3)


def test_calibrate(spark):
    pdf = sample(1200, 8)
    pdf["logit"] = pdf["logit"] * 3
    c = calibration.calibrate(spark.createDataFrame(pdf))
    p = 1 / (1 + np.exp(-pdf["logit"].to_numpy() / c.temperature))
    y = pdf["y"].to_numpy()
    assert c.n == 1200 and c.achieved_fpr <= 0.05 and c.nll_after <= c.nll_before
    assert c.achieved_fpr == pytest.approx((p[y == 0] >= c.threshold).mean())
    assert c.achieved_tpr == pytest.approx((p[y == 1] >= c.threshold).mean())
    gains = [((p[y == 1] >= t).mean() - (p[y == 0] >= t).mean(), t) for t in set(p)]
    assert c.youden_threshold == pytest.approx(max(gains)[1])
    with pytest.raises(ValueError, match="both classes"):
        calibration.calibrate(spark.createDataFrame(pdf[pdf["y"] == 0]))


def test_bootstrap_contains_estimate_and_narrows(spark):
    widths = []
    for n in (200, 3200):
        pdf = sample(n, 3)
        counts = metrics.score_counts(spark.createDataFrame(pdf), [])
        rows = {r["metric"]: r for r in bootstrap.bootstrap_ci(counts, [], 0.5, 300).collect()}
        assert rows["roc_auc"]["low"] < auc(pdf["y"].to_numpy(), pdf["prob"].to_numpy()) < rows["roc_auc"]["high"]
        widths.append(rows["roc_auc"]["high"] - rows["roc_auc"]["low"])
    assert 2.5 < widths[0] / widths[1] < 6.5


def test_bootstrap_replicates_agree_with_their_weights(spark, monkeypatch):
    """Also across several score blocks: the metric of the drawn table is the replicate's metric."""
    monkeypatch.setattr(bootstrap, "SCORES_PER_BLOCK", 40)
    pdf = pd.concat([sample(300, 1, ties=False).assign(g="a"), sample(300, 2, ties=False).assign(g="b")])
    counts = metrics.score_counts(spark.createDataFrame(pdf), ["g"])
    drawn = bootstrap.replicate_weights(counts, ["g"], 6).toPandas()
    got = bootstrap.bootstrap_replicates(counts, ["g"], 0.5, 6).toPandas().set_index(["g", "replicate"])
    for (g, r), part in drawn.groupby(["g", "replicate"]):
        real = pdf[pdf["g"] == g]
        assert part["pos"].sum() == (real["y"] == 1).sum() and part["neg"].sum() == (real["y"] == 0).sum()
        y = np.repeat([1, 0], [part["pos"].sum(), part["neg"].sum()])
        p = np.concatenate([np.repeat(part["score"], part["pos"]), np.repeat(part["score"], part["neg"])])
        assert got.loc[(g, r), "roc_auc"] == pytest.approx(auc(y, p))
        want = 0.5 * ((p[y == 1] >= 0.5).mean() + (p[y == 0] < 0.5).mean())
        assert got.loc[(g, r), "balanced_accuracy"] == pytest.approx(want)
    again = bootstrap.bootstrap_replicates(counts.repartition(3), ["g"], 0.5, 6).toPandas().set_index(["g", "replicate"])
    assert np.allclose(again.sort_index(), got.sort_index())
    assert len(got) == 12 and got["roc_auc"].nunique() > 6


def test_interval_does_not_depend_on_other_groups(spark, monkeypatch):
    """A small group alone and beside a large one, which is cut into blocks: the same replicates."""
    monkeypatch.setattr(bootstrap, "SCORES_PER_BLOCK", 200)
    small, large = sample(150, 4, ties=False).assign(g="s"), sample(1500, 5, ties=False).assign(g="t")
    alone = bootstrap.bootstrap_ci(metrics.score_counts(spark.createDataFrame(small), ["g"]), ["g"], 0.5, 60).collect()
    both = bootstrap.bootstrap_ci(metrics.score_counts(spark.createDataFrame(pd.concat([small, large])), ["g"]), ["g"], 0.5, 60).collect()
    assert sorted(map(tuple, alone)) == sorted(tuple(r) for r in both if r["g"] == "s") and len(both) == 4


def test_report_with_intervals(spark):
    """The intervals of bootstrap_ci as columns of the report; one class: none."""
    pdf = pd.concat([sample(300, 6).assign(g="a"), sample(200, 7).assign(g=None), sample(100, 8).assign(g="c", label="real", y=0)])
    counts = metrics.score_counts(spark.createDataFrame(pdf), ["g"])
    got = {r["g"]: r for r in bootstrap.report_with_intervals(metrics.full_report(counts.filter("g is not null"), ["g"], 0.5), counts, ["g"], 0.5, 80).collect()}
    want = {(r["g"], r["metric"]): r for r in bootstrap.bootstrap_ci(counts, ["g"], 0.5, 80).collect()}
    assert set(got) == {"a", "c"}
    for m in ("roc_auc", "balanced_accuracy"):
        assert (got["a"][f"{m}_low"], got["a"][f"{m}_high"]) == (want["a", m]["low"], want["a", m]["high"])
        assert got["c"][f"{m}_low"] is None
    assert got["a"]["roc_auc_low"] < got["a"]["roc_auc"] < got["a"]["roc_auc_high"]


def test_temperatures_of_groups(spark):
    """Each group's is what the single fit gives, also at a bound and for a null key."""
    pdf = pd.concat([sample(300, 6).assign(g="a"), sample(200, 7).assign(g=None)])
    pdf["logit"] = pdf["logit"] * np.where(pdf["g"].isna(), 4, 1)
    df = spark.createDataFrame(pdf[["g", "label", "logit"]].astype({"g": object}).where(pdf[["g", "label", "logit"]].notna(), None), "g string, label string, logit double")
    sure = spark.createDataFrame([("z", "fake", 1.0), ("z", "real", -1.0)], "g string, label string, logit double")
    counts = metrics.score_counts(df.unionByName(sure), ["g"], "logit")
    got = {r["g"]: r["temperature"] for r in calibration.fit_temperatures(counts, ["g"]).collect()}
    assert set(got) == {"a", None, "z"}
    for g, t in got.items():
        own = counts.filter(F.col("g").eqNullSafe(F.lit(g))).drop("g")
        assert t == pytest.approx(calibration.fit_temperature(own), rel=1e-9)


def test_bootstrap_skips_one_class_groups(spark):
    df = spark.createDataFrame([("a", "real", 0.1), ("b", "real", 0.2), ("b", "fake", 0.8)], "g string, label string, prob double")
    rows = bootstrap.bootstrap_ci(metrics.score_counts(df, ["g"]), ["g"], 0.5, 20).collect()
    assert {r["g"] for r in rows} == {"b"}


def test_membership(spark):
    rows = [
        ("140k", "test", "ffhq", "real"),
        ("140k", "test", "stylegan", "fake"),
        ("140k", "train", "ffhq", "real"),
        ("crossgen", "crossgen", "celeb", "real"),
        ("crossgen", "crossgen", "sdxl", "fake"),
        ("crossgen", "crossgen", "flux", "fake"),
        ("own", "own", "phone", "real"),
    ]
    df = spark.createDataFrame(rows, "dataset string, split string, source string, label string").withColumn("prob", F.lit(0.5))
    got = test_sets.build_test_sets(df).groupBy("test_set").agg(F.array_sort(F.collect_list("source")).alias("s")).collect()
    assert {r["test_set"]: r["s"] for r in got} == {
        "id_test": ["ffhq", "stylegan"],
        "crossgen_full": ["celeb", "flux", "sdxl"],
        "fake_swap_sdxl": ["ffhq", "sdxl"],
        "fake_swap_flux": ["ffhq", "flux"],
        "real_swap_celeb": ["celeb", "stylegan"],
    }


def test_grid(spark):
    assert len(grid_steps()) == 22
    assert expand_grid(spark.range(3)).count() == 66
    assert ("sepia", 1.0) in grid_steps({"sepia": [1]})
    with pytest.raises(ValueError, match="reserved perturbation"):
        grid_steps({"none": [1]})
