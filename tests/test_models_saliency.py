import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import audit, boosting, classifiers, saliency, selection


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    label = np.repeat(["real", "fake"], 200)
    pdf = pd.DataFrame(
        {"id": np.arange(400), "label": label, "width": np.where(label == "fake", 1024.0, 256.0), "noise": rng.normal(size=400), "noise2": rng.normal(size=400), "fixed": 1.0}
    )
    return spark.createDataFrame(pdf)


def test_shortcut_is_found(planted):
    report = classifiers.trivial_classifier(planted, ["width", "noise", "fixed"], "id", folds=2, rounds=2)
    assert report.constant == ["fixed"] and report.features == ["width", "noise"]
    assert all(a["mean"] > 0.99 for a in report.auc.values())
    assert report.top_features[0][0] == "width" and report.top_features[0][1] > 0.2


def test_noise_is_not(planted):
    report = classifiers.trivial_classifier(planted, ["noise", "noise2"], "id", folds=2, rounds=2, importance=False)
    assert all(abs(a["mean"] - 0.5) < 0.12 for a in report.auc.values())


def test_constants_and_one_class(planted):
    report = classifiers.trivial_classifier(planted, ["fixed"], "id", importance=False)
    assert report.all_constant and all(a == {"mean": 0.5, "std": 0.0} for a in report.auc.values())
    with pytest.raises(ValueError, match="rows per class"):
        classifiers.trivial_classifier(planted.filter("label = 'real'"), ["noise"], "id")


def logistic_by_hand(x, y, strength=1.0):
    """Penalised loss of scaled features, by many small steps of Newton's method."""
    mean, std = x.mean(axis=0), x.std(axis=0)
    z, w = np.column_stack([(x - mean) / std, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    penalty = np.append(np.full(x.shape[1], 1 / strength), 0)
    for _ in range(200):
        p = 1 / (1 + np.exp(-z @ w))
        w = w - 0.5 * np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
    return w[:-1] / std, w[-1] - (w[:-1] * mean / std).sum()


def boosted_by_hand(bins, y, rounds):
    """Scores of the training rows after so many trees, node by node and split by split."""
    share = y.mean()
    score = np.full(len(y), np.log(share / (1 - share)))

    def worth(g, h):
        return g * g / max(h, boosting.LEAST_CURVATURE)

    def grow(rows, g, h, level, out):
        best, split = 1e-10, None
        if level < boosting.DEPTH:
            for f in range(bins.shape[1]):
                for c in range(boosting.BINS - 1):
                    left, right = rows[bins[rows, f] <= c], rows[bins[rows, f] > c]
                    if min(len(left), len(right)) >= boosting.LEAF_ROWS:
                        gain = worth(g[left].sum(), h[left].sum()) + worth(g[right].sum(), h[right].sum()) - worth(g[rows].sum(), h[rows].sum())
                        if gain > best + 1e-12:
                            best, split = gain, (left, right)
        if split is None:
            out[rows] = -boosting.RATE * g[rows].sum() / max(h[rows].sum(), boosting.LEAST_CURVATURE)
        else:
            for side in split:
                grow(side, g, h, level + 1, out)

    for _ in range(rounds):
        p, out = 1 / (1 + np.exp(-score)), np.zeros(len(y))
        grow(np.arange(len(y)), p - y, p * (1 - p), 0, out)
        score += out
    return score


def test_fits_against_plain_ones(spark):
    """Several sets and folds at once, over several partitions: each fit equals the plain one on its own rows."""
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=(n, 3))
    x[:, 2] = np.round(x[:, 2])
    y = (x[:, 0] + x[:, 1] ** 2 + rng.normal(size=n) > 0.8).astype(float)
    missing = rng.random(n) < 0.1
    pdf = pd.DataFrame({"id": range(n), "label": np.where(y > 0, "fake", "real"), "a": x[:, 0], "b": np.where(missing, np.nan, x[:, 1]), "c": x[:, 2]})
    table = classifiers._prepared(spark.createDataFrame(pdf), {"ab": ["a", "b"], "ac": ["a", "c"]}, "id", 3, 1)
    got = table.rows.repartition(3).toPandas().sort_values("key")
    bins, fold = np.array([list(b) for b in got["bins"]]), got["fold"].to_numpy()
    complete = np.array(got["complete"].tolist()) > 0
    assert (complete[:, 0] == ~missing).all() and complete[:, 1].all()
    fits = [boosting.Fit(columns, s, k) for s, columns in enumerate(table.sets.values()) for k in (0, 2)] + [boosting.Fit(table.sets["ac"], 1, None)]
    spread = table.rows.repartition(3)
    lines = boosting.regress(spread, fits)
    boosting.boost(spread, fits, 7)
    for fit, line in zip(fits, lines, strict=True):
        use = np.flatnonzero(complete[:, fit.of_set] & ((fold != fit.fold) if fit.fold is not None else ~got["quarter"].to_numpy()))
        w, b = logistic_by_hand(x[use][:, fit.columns], y[use])
        assert np.allclose(line.weights, w, atol=1e-6) and line.bias == pytest.approx(b, abs=1e-6)
        want = boosted_by_hand(bins[use][:, fit.columns], y[use], 7)
        assert np.allclose(fit.base + boosting.raw_scores(fit, bins[use]), want, atol=1e-9)


def test_sets_together_and_alone(spark, planted):
    """A set's report does not depend on the sets beside it, and many partial tables are added up by tasks."""
    sets = {"both": ["width", "noise"], "noise": ["noise", "noise2"], "still": ["fixed"]}
    together = classifiers.shortcut_tests(planted, sets, "id", folds=2, rounds=2)
    alone = classifiers.trivial_classifier(planted, sets["noise"], "id", "noise", folds=2, rounds=2)
    assert together[1].auc == alone.auc and together[1].top_features == alone.top_features and together[2].all_constant
    rows = classifiers.audit_compare(planted, sets, "id", folds=2, rounds=1).collect()
    assert {r["feature_set"] for r in rows} == set(sets) and {r["measure"] for r in rows} >= {"auc_mean", "auc_std", "importance", "n_samples", "constant"}
    drops = {r["feature"]: r["auc_drop"] for r in classifiers.permutation_importance(planted, ["width", "noise"], "id", rounds=2).collect()}
    assert drops["width"] > 0.2 > abs(drops["noise"])


def test_sums_of_many_partials(spark, planted, monkeypatch):
    table = classifiers._prepared(planted, {"n": ["noise"]}, "id", 2, 1).rows.repartition(7)
    one = lambda rows: np.array([len(rows.y), rows.y.sum(), rows.x.sum()])
    plain = boosting._added(table, 7, one, 3)
    monkeypatch.setattr(boosting, "PARTIALS", 2)
    assert np.allclose(boosting._added(table, 7, one, 3), plain) and plain[0] == 400


def test_probe(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4)) * [1, 5, 0.2, 1] + [3, 0, 0, -2]
    y = (x[:, 0] - 3 + 8 * x[:, 2] + rng.normal(size=300) * 0.3 > 0)
    rows = [(list(map(float, r)), "fake" if t else "real", "val" if i % 4 == 0 else "train") for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "x array<double>, label string, split string")
    fitted = classifiers.linear_probe(df, (0.01, 1.0))
    assert set(fitted.auc_by_c) == {0.01, 1.0} and fitted.auc_by_c[fitted.best_c] == max(fitted.auc_by_c.values()) > 0.95
    logits = np.array([r["logit"] for r in classifiers.probe_score(df, fitted.weights, fitted.bias).collect()])
    assert np.allclose(logits, x @ fitted.weights + fitted.bias)


def test_metadata_features(spark):
    schema = "format string, width int, height int, file_size bigint, jpeg_quality_est int, has_exif string, has_icc string, has_xmp string"
    df = spark.createDataFrame([("png", 10, 20, 2048, None, "False", "0", None), ("jpeg", 30, 10, 300, 90, "True", "1", "no")], schema)
    a, b = audit.metadata_features(df, []).orderBy("width").collect()
    assert (a["aspect"], a["file_size_kb"], a["bytes_per_pixel"], a["jpeg_quality_est"], a["jpeg_quality_missing"]) == (0.5, 2.0, 10.24, -1.0, 1)
    assert (a["is_png"], a["has_exif"], a["has_icc"], a["has_xmp"]) == (1, 0, 0, 0)
    assert (b["is_jpeg"], b["has_exif"], b["has_icc"], b["has_xmp"], b["jpeg_quality_est"]) == (1, 1, 1, 0, 90.0)
    assert tuple(audit.metadata_feature_columns()) == audit.METADATA_FEATURES


def test_degenerate(spark):
    df = spark.createDataFrame([(1, [5.0, 5.0]), (2, [0.0, 100.0]), (3, [float("nan"), 1.0])], "id int, grey array<double>")
    assert {r["id"] for r in audit.degenerate_filter(df, "grey").collect()} == {1, 3}


def gradient(x, w, gamma, eps):
    """d (w . (gamma * norm(x))) / dx by central differences."""

    def f(v):
        return (w * gamma * (v - v.mean()) / np.sqrt(v.var() + eps)).sum()

    h = 1e-6
    return np.array([(f(x + h * e) - f(x - h * e)) / (2 * h) for e in np.eye(len(x))])


def test_maps_against_numpy(spark):
    rng = np.random.default_rng(1)
    maps, w, gamma = rng.normal(size=(2, 3, 4, 5)), [0.5, -1.0, 2.0], [1.0, 0.3, 1.7]
    rows = [(i, c, y, x, float(maps[i, c, y, x])) for i in range(2) for c in range(3) for y in range(4) for x in range(5)]
    df = spark.createDataFrame(rows, "item_id int, c int, y int, x int, a double").repartition(5)

    def table(frame):
        return {(r["item_id"], r["y"], r["x"]): r["value"] for r in frame.collect()}

    plain = np.tensordot(w, maps, axes=(0, 1))
    for target, sign in (("fake", 1), ("real", -1)):
        got = table(saliency.gradcam_map(df, w, target))
        assert all(got[k] == pytest.approx(max(sign * plain[k], 0.0)) for k in got)
    normed = table(saliency.gradcam_map_normed(df, w, gamma, 1e-3, relu=False))
    for i in range(2):
        g = gradient(maps[i].mean(axis=(1, 2)), np.array(w), np.array(gamma), 1e-3)
        want = np.tensordot(g, maps[i], axes=(0, 0))
        assert all(normed[(i, y, x)] == pytest.approx(want[y, x], abs=1e-6) for y in range(4) for x in range(5))
    scaled = table(saliency.minmax_map(saliency.gradcam_map(df, w)))
    assert min(scaled.values()) == 0.0 and max(scaled.values()) == 1.0
    flat = saliency.minmax_map(df.filter("c = 0").withColumn("value", F.lit(3.0)))
    assert {r["value"] for r in flat.collect()} == {0.0}
    raw = saliency.gradcam_map(df, w, relu=False)
    same, opposite = (saliency.mean_spearman(raw, other).first()["mean_spearman"] for other in (raw, saliency.gradcam_map(df, w, "real", relu=False)))
    assert same == pytest.approx(1.0) and opposite == pytest.approx(-1.0)
    with pytest.raises(ValueError):
        saliency.gradcam_map(df, w, "other")


MODEL = "model string, id_auc double, crossgen_mean_auc double, crossgen_min_auc_ci_low double, own_auc double, p95_latency_ms double"


def winner(spark, rows):
    chosen = selection.select_model(spark.createDataFrame(rows, MODEL)).collect()
    return [r["model"] for r in chosen if r["winner"]], {r["model"]: r["excluded"] for r in chosen if r["excluded"]}


def test_model_rule(spark):
    a, b, c = ("a", 0.99, 0.90, 0.85, 0.5, 400.0), ("b", 0.98, 0.86, 0.80, 0.5, 100.0), ("c", 0.95, 0.99, 0.9, 0.5, 50.0)
    d, e, f = ("d", 0.99, 0.99, 0.9, 0.5, None), ("e", 0.99, 0.99, 0.9, 0.5, 501.0), ("f", None, 0.99, 0.9, 0.5, 1.0)
    won, out = winner(spark, [a, b, c, d, e, f])
    assert won == ["b"]  # within the leader's interval, faster
    assert set(out) == {"c", "d", "e", "f"}
    assert winner(spark, [a, ("b", 0.98, 0.84, 0.80, 0.5, 100.0)])[0] == ["a"]
    assert winner(spark, [("a", 0.99, 0.90, None, 0.5, 400.0), b])[0] == ["a"]
    assert winner(spark, [("a", 0.98, None, None, 0.5, 1.0), ("b", 0.99, None, None, 0.5, 9.0)])[0] == ["b"]
    assert winner(spark, [d, e])[0] == []


def early_by_hand(aucs, patience):
    best, best_epoch, bad = -1.0, -1, 0
    for epoch, value in enumerate(aucs, 1):
        if value > best:
            best, best_epoch, bad = value, epoch, 0
        else:
            bad += 1
            if bad >= patience:
                return best_epoch, best, epoch, True
    return best_epoch, best, len(aucs), False


def test_early_stop(spark):
    rng = np.random.default_rng(0)
    runs = {f"r{i}": list(rng.integers(0, 10, rng.integers(1, 60)) / 10) for i in range(12)}
    rows = [(run, e, float(v)) for run, values in runs.items() for e, v in enumerate(values, 1)]
    df = spark.createDataFrame(rows, "run string, epoch bigint, val_auc double").repartition(4)
    for patience in (1, 3, 5):
        got = {r["run"]: (r["best_epoch"], r["best_auc"], r["epochs_run"], r["stopped"]) for r in selection.early_stop(df, patience).collect()}
        assert got == {run: early_by_hand(values, patience) for run, values in runs.items()}


def test_registered_fits_are_full(monkeypatch):
    """The named queries fit with the library's own rounds, folds and importance."""
    import inspect

    from corpusgauge.plans import queries

    seen = {}

    class Stop(Exception):
        pass

    def record(name):
        def call(*args, **options):
            seen[name] = options
            raise Stop

        return call

    monkeypatch.setattr(queries.v, "features", lambda *_: None)
    monkeypatch.setattr(queries.classifiers, "trivial_classifier", record("trivial"))
    with pytest.raises(Stop):
        queries.trivial_classifier(None, "")
    assert not {"rounds", "folds", "importance"} & set(seen["trivial"])
    for name, cut in (("audit_compare", "rounds="), ("audit_compare", "folds="), ("audit_compare", "importance="), ("permutation_importance", "maxIter=5")):
        assert cut not in inspect.getsource(getattr(queries, name))


def test_plans_of_a_long_fit_stay_short(spark, monkeypatch):
    """The driver remembers the plan of every pass, so no table of a later round may hold those of the rounds before it."""
    from corpusgauge.operators import boosting

    rng = np.random.default_rng(5)
    rows = [(i, "fake" if rng.random() < 0.5 else "real", float(x)) for i, x in enumerate(rng.random(200))]
    df = spark.createDataFrame(rows, "id long, label string, x double")
    table = classifiers._prepared(df, {"features": ["x"]}, "id", 1, 42)
    sizes = []

    def measured(kept):
        sizes.append(len(kept._jdf.queryExecution().optimizedPlan().toString()) + len(kept._jdf.queryExecution().executedPlan().toString()))
        return keep(kept)

    keep = boosting.keep
    monkeypatch.setattr(boosting, "keep", measured)
    monkeypatch.setattr(boosting, "REFRESH", 1)
    monkeypatch.setattr(boosting, "WRITTEN", 3, raising=False)
    boosting.boost(table.rows, [boosting.Fit([0], 0, None)], 8)
    assert len(sizes) == 8
    assert max(sizes[4:]) <= max(sizes[1:4])


def test_trees_grow_on_blocks(spark, planted, monkeypatch):
    """What the passes over a table read is a row per block of rows, and its sums are those of the rows."""
    from corpusgauge.operators import boosting

    table = classifiers._prepared(planted, {"all": ["width", "noise"]}, "id", 2, 1)
    counts, keep = [], boosting.keep
    monkeypatch.setattr(boosting, "keep", lambda df: counts.append(df.count()) or keep(df))
    boosting.boost(table.rows.coalesce(1), [boosting.Fit([0], 0, None)], 6)
    assert counts == [1, 1]

    rng = np.random.default_rng(8)
    n = 3000
    bins = rng.integers(0, 40, (3, n)).astype(np.uint8)
    complete = np.stack([np.ones(n, bool), rng.random(n) < 0.3, np.zeros(n, bool)], axis=1)
    margin, y = rng.normal(size=(3, n)), (rng.random(n) < 0.4).astype(float)
    block = boosting.Block(bins, y, rng.integers(0, 4, n).astype(np.int32), rng.random(n) < 0.25, complete, margin)
    fits = [boosting.Fit([0, 1, 2], 0, 1), boosting.Fit([0, 2], 1, None), boosting.Fit([1], 2, 0)]
    for fit in fits:
        for _ in range(2):
            fit.feature.append(rng.choice([-1, *fit.columns], 15))
            fit.cut.append(rng.integers(0, 40, 15))
            fit.value.append(rng.normal(size=16))
    for level in range(boosting.DEPTH):
        sizes = [3 * (1 << level) * len(f.columns) * 64 for f in fits]
        found = np.split(boosting._histograms(block, fits, level), np.cumsum(sizes)[:-1])
        for j, fit in enumerate(fits):
            use, own = np.flatnonzero(fit.trains(block)), found[j].reshape(3, 1 << level, len(fit.columns), 64)
            node, first = np.zeros((2, len(use)), int)
            for deep, tree in ((level, 1), (boosting.DEPTH, 0)):
                for i, row in enumerate(use):
                    at = 0
                    for d in range(deep):
                        k = (1 << d) - 1 + at
                        at = 2 * at + int(fit.feature[tree][k] >= 0 and bins[fit.feature[tree][k], row] > fit.cut[tree][k])
                    (node if tree else first)[i] = at
            p = 1 / (1 + np.exp(-margin[j][use] - fit.value[0][first]))
            for i, c in enumerate(fit.columns):
                for k, w in enumerate((p - y[use], p * (1 - p), np.ones(len(use)))):
                    want = np.zeros((1 << level, 64))
                    np.add.at(want, (node, bins[c][use]), w)
                    assert np.allclose(own[k, :, i], want, atol=1e-9)


def test_moved_features_in_trees_that_use_them(spark, planted):
    """Shuffled scores are the trees' sums in their order, whatever trees the moved feature is in."""
    table = classifiers._prepared(planted, {"both": ["width", "noise"]}, "id", 1, 42)
    fit = boosting.Fit(table.sets["both"], 0, None)
    boosting.boost(table.rows, [fit], 3)
    got = classifiers._shuffled_scores(table, [fit], 42, 2).toPandas()
    rows = table.rows.filter("quarter").toPandas()
    plain = boosting.sigmoid(fit.base + boosting.raw_scores(fit, np.array([list(b) for b in rows["bins"]], np.uint8)))
    for repeat in (0, 1):
        assert sorted(got[(got["feature"] == -1) & (got["repeat"] == repeat)]["prob"]) == sorted(plain)
    assert len(got) == 3 * 2 * len(rows)
