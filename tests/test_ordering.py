import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.functions.hashing import stable_hex
from corpusgauge.operators.manifest import hash_sample, sample_fraction, split_validation
from corpusgauge.operators.ordering import (
    exact_quantiles,
    first_per_group,
    hash_block,
    ranked,
    running_max,
    running_totals,
    string_block,
    with_value_blocks,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """60% of the rows in one group, many equal values."""
    rng = np.random.default_rng(1)
    n = 4000
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(list("abc"), n))
    value = np.where(rng.random(n) < 0.3, 5.0, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"g": group, "id": np.arange(n), "v": value})
    return pdf, spark.createDataFrame(pdf).repartition(7)


def test_ranks_in_hash_order(skewed):
    pdf, df = skewed
    hashed = df.withColumn("h", stable_hex(F.col("id"), 3))
    got = ranked(hashed, ["g"], ["h", "id"], hash_block(F.col("h"))).toPandas().set_index("id")
    want = got.sort_values("h").groupby("g").cumcount() + 1
    assert (got["rank"].sort_index() == want.sort_index()).all()
    assert (got["rank_total"] == got["g"].map(pdf["g"].value_counts())).all()


def test_running_totals_and_max_in_value_order(skewed):
    _, df = skewed
    blocked = with_value_blocks(df, {"v": "b"}, 16)
    got = running_totals(blocked, ["g"], ["v", "id"], {"v": F.col("v")}, F.col("b")).toPandas().sort_values(["v", "id"])
    before = got.groupby("g")["v"].cumsum() - got["v"]
    assert np.allclose(got["v_before"], before)
    top = running_max(blocked, ["g"], ["v", "id"], {"i": F.col("id")}, F.col("b")).toPandas().sort_values(["v", "id"])
    want = top.groupby("g")["id"].transform(lambda s: s.cummax().shift())
    assert np.allclose(top["i_before"].astype(float), want, equal_nan=True)


def test_string_blocks_do_not_change_ranks(skewed):
    _, df = skewed
    named = df.withColumn("p", F.concat(F.lit("dir/"), F.lpad("id", 6, "0")))
    got = ranked(named, ["g"], ["p"], string_block(named, "p", 8)).toPandas()
    assert (got.sort_values("p").groupby("g").cumcount() + 1 == got["rank"].loc[got.sort_values("p").index]).all()


def test_exact_quantiles_equal_numpy(skewed):
    pdf, df = skewed
    probs = {"low": 0.05, "mid": 0.5, "high": 0.95}
    got = exact_quantiles(df.withColumn("nothing", F.lit(None).cast("double")), ["g"], ["v", "id", "nothing"], probs).collect()
    assert len(got) == 8
    for r in got:
        values = pdf.loc[pdf["g"] == r["g"], r["feature"]]
        assert r["n"] == len(values)
        for name, q in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, q), abs=1e-12)


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert exact_quantiles(df, [], ["v"], {"m": 0.3}).first()["m"] == 1.0
    assert exact_quantiles(df.filter("v > 2"), [], ["v"], {"m": 0.3}).count() == 0


def test_first_per_group(skewed):
    pdf, df = skewed
    got = first_per_group(df, ["g"], ["v", "id"], 3).toPandas()
    want = pdf.sort_values(["v", "id"]).groupby("g").head(3)
    assert set(got["id"]) == set(want["id"])


def files(spark, copies=1):
    """101 per label in `valid`; `copies` of them share one content."""
    rows = [("train", "real", "t", "sha_t")]
    for label in ("real", "fake"):
        for i in range(101):
            sha = "same" if i < copies else f"sha_{label}_{i}"
            rows.append(("valid", label, f"{label}/{i:03d}", sha))
    return spark.createDataFrame(rows, "split string, label string, rel_path string, sha256 string")


def halves(df, seed=42):
    done = split_validation(df, seed, "valid", "a", "b")
    return {r["rel_path"]: r["split"] for r in done.collect()}


@pytest.mark.parametrize("copies", [1, 60, 101])
def test_split_is_even_stable_and_by_content(spark, copies):
    df = files(spark, copies)
    first = halves(df)
    assert first["t"] == "train" and len(first) == 203
    for label in ("real", "fake"):
        sides = [s for p, s in first.items() if p.startswith(label)]
        assert (sides.count("a"), sides.count("b")) == (50, 51)
    assert halves(df.orderBy(F.rand(3)).repartition(9)) == first
    # the definition, by hand
    pdf = df.withColumn("h", stable_hex(F.col("sha256"), 42)).toPandas()
    for _, g in pdf[pdf["split"] == "valid"].groupby("label"):
        ordered = list(g.sort_values(["h", "rel_path"])["rel_path"])
        assert [first[p] for p in ordered] == ["a"] * 50 + ["b"] * 51


def test_split_depends_on_seed_and_rejects_bad_input(spark):
    df = files(spark)
    assert halves(df) != halves(df, 7)
    for args in ((42, "valid", "a", "a"), (42, "missing", "a", "b")):
        with pytest.raises(ValueError):
            split_validation(df, *args)
    with pytest.raises(ValueError):
        split_validation(df.filter("rel_path in ('real/000')"), 42, "valid", "a", "b")


def test_samples(spark):
    df = files(spark)
    assert hash_sample(df, 1000, 1).count() == 203
    assert {r["rel_path"] for r in hash_sample(df, 10, 1).collect()} == {
        r["rel_path"] for r in hash_sample(df.repartition(5), 10, 1).collect()
    }
    sizes = sample_fraction(df.filter("split = 'valid'"), 0.25, 3, ["label"]).groupBy("label").count().collect()
    assert {r["count"] for r in sizes} == {25}
