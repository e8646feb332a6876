import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusgauge.operators import close_prints, dedupe

SPLITS = ("train", "val", "test", "crossgen")


def make(spark, hashes, seed=0):
    rng = np.random.default_rng(seed)
    n = len(hashes)
    pdf = pd.DataFrame(
        {
            "item_id": rng.permutation(n).astype(np.int64),
            "phash": hashes[:, 0].view(np.int64),
            "dhash": hashes[:, 1].view(np.int64),
            "dataset": "d",
            "split": rng.choice(SPLITS, n),
            "label": rng.choice(["real", "fake"], n),
        }
    )
    pdf["rel_path"] = "p" + pdf["item_id"].astype(str)
    return pdf, spark.createDataFrame(pdf)


def planted(n=60, copies=20, exact=25, seed=4):
    """Random prints, near copies with 0-5 flipped bits, and one print shared by many items."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, size=(n, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    near = base[:copies].copy()
    for row in near:
        for h in range(2):
            for bit in rng.choice(64, rng.integers(0, 6), replace=False):
                row[h] ^= np.uint64(1) << np.uint64(bit)
    return np.concatenate([base, near, np.repeat(base[:1], exact, axis=0)])


def same_first_hash(n=70, seed=5):
    """One first hash for all: buckets differ by the second one only."""
    out = planted(n, 30, 5, seed)
    out[:, 0] = 12345
    return out


def dense(n=120, seed=6):
    """Different prints around one, nearly all of them close to each other."""
    rng = np.random.default_rng(seed)
    out = np.full((n, 2), 2**40 + 17, dtype=np.uint64)
    for row in out:
        for h in range(2):
            for bit in rng.choice(64, rng.integers(0, 4), replace=False):
                row[h] ^= np.uint64(1) << np.uint64(bit)
    return out


def brute(pdf, d):
    rows = []
    records = pdf.sort_values("item_id").to_dict("records")
    for a in range(len(records)):
        for b in range(a + 1, len(records)):
            i, j = records[a], records[b]
            p = ((i["phash"] ^ j["phash"]) & (2**64 - 1)).bit_count()
            q = ((i["dhash"] ^ j["dhash"]) & (2**64 - 1)).bit_count()
            if p <= d and q <= d:
                rows.append((i, j, p, q))
    return rows


@pytest.mark.parametrize("d", [0, 2, 4])
@pytest.mark.parametrize("hot", [dedupe.HOT_BUCKET, 2, 7])
def test_pairs_equal_brute_force(spark, d, hot):
    pdf, df = make(spark, planted())
    want = brute(pdf, d)
    folded = dedupe.near_duplicate_pairs(df.repartition(5), d, hot).collect()
    assert sum(r["pairs"] for r in folded) == len(want)
    # unfold through the membership table: the item-level list is all there
    member = {r["item_id"]: r["print_id"] for r in dedupe.print_members(df).collect()}
    key = {(r["print_i"], r["print_j"]): (r["phash_dist"], r["dhash_dist"]) for r in folded}
    for i, j, p, q in want:
        pair = tuple(sorted((member[i["item_id"]], member[j["item_id"]])))
        assert key[pair] == (p, q)
    assert len(key) == len(folded)


@pytest.mark.parametrize("hot", [dedupe.HOT_BUCKET, 3])
@pytest.mark.parametrize("hashes", [planted(), same_first_hash(), dense()], ids=["planted", "constant", "dense"])
def test_totals_and_drops_equal_brute_force(spark, hashes, hot):
    pdf, df = make(spark, hashes)
    want = brute(pdf, 4)
    rank = {s: k for k, s in enumerate(SPLITS)}
    totals = dedupe.pair_totals(dedupe.annotate_pairs(df, SPLITS, hot_bucket=hot)).first()
    cross = [w for w in want if w[0]["split"] != w[1]["split"]]
    assert totals["pairs_total"] == len(want) and totals["pairs_cross_split"] == len(cross)
    assert totals["pairs_same_split"] == len(want) - len(cross)
    assert totals["pairs_with_label_conflict"] == sum(w[0]["label"] != w[1]["label"] for w in want)
    drops = {}
    for i, j, p, q in cross:
        lose, keep = (i, j) if rank[i["split"]] > rank[j["split"]] else (j, i)
        drops.setdefault(lose["rel_path"], (keep["rel_path"], p, q))
    report = {r["metric"]: r["n"] for r in dedupe.dedupe_report(df, SPLITS, hot_bucket=hot).collect() if r["split"] is None}
    assert {k: report[k] for k in totals.asDict()} == totals.asDict()
    got = dedupe.resolve_drops(df.repartition(3), SPLITS, hot_bucket=hot).collect()
    assert {r["rel_path"]: (r["duplicate_of_rel_path"], r["phash_dist"], r["dhash_dist"]) for r in got} == drops
    assert len(got) == len(drops)
    border = dedupe.borderline_pairs(df, SPLITS, k=7).collect()
    far = sorted(cross, key=lambda w: (-w[2], -w[3], w[0]["item_id"], w[1]["item_id"]))[:7]
    assert [(r["id_i"], r["id_j"]) for r in border] == [(w[0]["item_id"], w[1]["item_id"]) for w in far]


def test_hot_prints_are_joined_in_place(spark):
    _, df = make(spark, planted())
    cells = dedupe.cells_of(df)
    found = dedupe._partners(cells, SPLITS, 4, dedupe.HOT_BUCKET)
    plain, hot = (sorted(map(str, dedupe._drops(df, cells, found, n).collect())) for n in (10**6, 3))
    assert plain == hot and plain
    prints = dedupe.prints_of(cells)
    plain, hot = (sorted(map(str, dedupe._with_print(df, prints, n).collect())) for n in (10**6, 3))
    assert plain == hot and len(hot) == df.count()


def test_report_agrees_with_drops(spark):
    _, df = make(spark, planted())
    report = {(r["metric"], r["split"]): r["n"] for r in dedupe.dedupe_report(df, SPLITS).collect()}
    drops = dedupe.resolve_drops(df, SPLITS)
    assert report[("dropped_images", None)] == drops.count() and report[("images_hashed", None)] == df.count()
    for r in drops.groupBy("split").count().collect():
        assert report[("dropped_by_dataset_split", r["split"])] == r["count"]


def test_drop_case_by_hand(spark):
    """a(train)-b(test), a-c(both train), c-d(crossgen): b and d go."""
    rows = [(1, 0, 0, "train", "a", "real"), (2, 1, 0, "test", "b", "fake"), (3, 3, 0, "train", "c", "real"), (4, 2**40 + 3, 7, "crossgen", "d", "real")]
    df = spark.createDataFrame(
        [(i, p, q, "d", s, path, lb) for i, p, q, s, path, lb in rows],
        "item_id bigint, phash bigint, dhash bigint, dataset string, split string, rel_path string, label string",
    )
    got = {r["rel_path"]: r["duplicate_of_rel_path"] for r in dedupe.resolve_drops(df, SPLITS, 3).collect()}
    assert got == {"b": "a", "d": "a"}


def test_unknown_split_and_bucket_guard(spark):
    _, df = make(spark, planted())
    with pytest.raises(Exception, match="split without priority"):
        dedupe.resolve_drops(df, ("train", "val")).collect()
    buckets = dedupe.bucket_guard(df, 4, 20).collect()
    assert {r["band"] for r in buckets} == {0, 1, 2, 3, 4} and min(r["n"] for r in buckets) > 20
    assert dedupe.bucket_guard(df, 4).count() == 0


def test_copies_never_multiply_rows(spark):
    """A third of the items share one print: still one row."""
    df = spark.range(30_000).select(
        F.col("id").alias("item_id"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.xxhash64("id")).alias("phash"),
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.xxhash64("id", F.lit(1))).alias("dhash"),
        F.lit("d").alias("dataset"),
        F.when(F.col("id") % 2 == 0, "train").otherwise("test").alias("split"),
        F.lit("real").alias("label"),
        F.col("id").cast("string").alias("rel_path"),
    )
    folded = dedupe.near_duplicate_pairs(df, 4).collect()
    assert [(r["print_i"], r["n_i"], r["pairs"]) for r in folded] == [(0, 10_000, 10_000 * 9_999 // 2)]
    assert dedupe.resolve_drops(df, SPLITS).count() == 5_000


def test_dense_cluster_gives_no_row_per_pair(spark):
    """1,500 different prints within two bits of one: over a million close pairs, at most one row per print and bucket."""
    rng = np.random.default_rng(8)
    hashes = np.full((1500, 2), 99, dtype=np.uint64)
    for row in hashes:
        for h in range(2):
            for bit in rng.choice(64, 2, replace=False):
                row[h] ^= np.uint64(1) << np.uint64(bit)
    _, df = make(spark, hashes)
    cells = dedupe.cells_of(df)
    found = dedupe._partners(cells, SPLITS, 4, dedupe.HOT_BUCKET)
    sums = found.agg(F.sum("total")).first()[0]
    assert sums > 1_000_000 and found.count() <= 25 * cells.count() + 100


def test_one_exchange_a_level(spark):
    """Rows are shuffled once, on their bucket."""
    _, df = make(spark, planted())
    prints = dedupe.prints_of(dedupe.cells_of(df))
    plan = dedupe.print_pairs(prints, 4)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    buckets = [x for x in plan.splitlines() if "Exchange hashpartitioning(path" in x]
    assert len(buckets) == 1 and "Join" not in plan


def test_layout_of_the_bits():
    """Chunks and what is left of them hold every bit once, level by level."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 2**64, 50, dtype=np.uint64)
    for d in (0, 1, 4, 16):
        bits, rest = 64, x
        for _ in range(close_prints.LEVELS):
            layout = close_prints.chunk_masks(d, bits)
            assert sum(w for _, w in layout) == bits
            taken = [close_prints._bits(rest, s, w) for s, w in layout]
            total = sum(np.bitwise_count(t).astype(int) for t in taken)
            assert (total == np.bitwise_count(rest)).all()
            shift, width = layout[d // 2]
            left = close_prints._without(rest, shift, width, bits)
            assert (np.bitwise_count(left) + np.bitwise_count(taken[d // 2]) == np.bitwise_count(rest)).all()
            bits, rest = bits - width, left
