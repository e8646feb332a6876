"""The corpus manifest: building, checking, splitting, sampling, summarising."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.hashing import stable_hex
from corpusgauge.operators.ordering import first_per_group, hash_block, ranked, running_totals, string_block

LABELS = ("real", "fake")
MANIFEST_SCHEMA = (
    "dataset string, source string, label string, split string, rel_path string, sha256 string, format string, "
    "width int, height int, mode string, file_size bigint, jpeg_quality_est int, has_exif string, has_icc string, "
    "has_xmp string, read_error string"
)
MANIFEST_COLUMNS = tuple(part.split()[0] for part in MANIFEST_SCHEMA.split(", "))


def repeated_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def validate_manifest(df: DataFrame) -> DataFrame:
    """Violations as (rule, n): unknown labels, repeated (dataset, rel_path) rows. Missing columns raise."""
    missing = [c for c in MANIFEST_COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"manifest lacks columns: {missing}")
    bad = df.agg(F.count(F.when(~F.coalesce(F.col("label").isin(*LABELS), F.lit(False)), 1)).alias("n"))
    extra = repeated_keys(df, ["dataset", "rel_path"]).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    return bad.select(F.lit("unknown_label").alias("rule"), "n").unionByName(
        extra.select(F.lit("duplicate_key").alias("rule"), "n")
    )


def require_valid(df: DataFrame) -> DataFrame:
    """The manifest itself; raises if a rule is broken."""
    broken = {r["rule"]: r["n"] for r in validate_manifest(df).collect() if r["n"]}
    if broken:
        raise ValueError(f"invalid manifest: {broken}")
    return df


def merge_specs_meta(specs: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join on rel_path, one to one, in manifest column order; absent columns become null.

    A repeated path on either side raises while the join runs: each side is grouped by the join key
    first, so the check shares the join's shuffle.
    """

    def single(df: DataFrame, side: str) -> DataFrame:
        rest = [c for c in df.columns if c != "rel_path"]
        message = F.concat(F.lit(f"repeated rel_path in {side}: "), F.col("rel_path"))
        grouped = df.groupBy("rel_path").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row"))
        checked = F.when(F.col("_n") > 1, F.raise_error(message).cast("boolean")).otherwise(True)
        return grouped.filter(checked).select("rel_path", "_row.*")

    joined = single(specs, "specs").join(single(meta, "metadata"), "rel_path", "left")
    types = dict(part.split() for part in MANIFEST_SCHEMA.split(", "))
    return joined.select(
        *[
            F.col(c).cast(types[c]).alias(c) if c in joined.columns else F.lit(None).cast(types[c]).alias(c)
            for c in MANIFEST_COLUMNS
        ]
    )


def resolve_paths(df: DataFrame, roots: Mapping[str, str]) -> DataFrame:
    """Add `path` = root of the dataset / rel_path; a dataset without a root raises."""
    root = F.create_map(*[F.lit(x) for pair in roots.items() for x in pair])[F.col("dataset")]
    unknown = F.raise_error(F.concat(F.lit("no root for dataset "), F.col("dataset")))
    return df.withColumn("path", F.concat(F.coalesce(root, unknown.cast("string")), F.lit("/"), F.col("rel_path")))


def parse_roots(items: Sequence[str]) -> dict[str, str]:
    """DATASET=PATH texts to a mapping."""
    roots = {}
    for item in items:
        name, _, path = item.partition("=")
        if not name or not path:
            raise ValueError(f"expected DATASET=PATH, got {item!r}")
        roots[name] = path
    return roots


def concat_manifests(*manifests: DataFrame) -> DataFrame:
    """All readable rows of several manifests."""
    out = manifests[0]
    for other in manifests[1:]:
        out = out.unionByName(other)
    return out.filter(F.col("read_error").isNull())


def summarize_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset", "split", "source", "label").agg(
        F.count(F.lit(1)).alias("images"), F.count("read_error").alias("unreadable")
    )


def split_validation(df: DataFrame, seed: int, source_split: str, first: str, second: str) -> DataFrame:
    """Halve one split per label in hash order of the content; the first ⌊n/2⌋ become `first`.

    Copies share a hash and are told apart by path. They are counted before anything is ordered, so
    only the one content the cut runs through, if any, needs an order by path. Per label one cut row
    comes to the driver (there are two labels).
    """
    if first == second:
        raise ValueError("first and second must differ")
    order = stable_hex(F.col("sha256"), seed)
    part = df.filter(F.col("split") == source_split)
    contents = part.groupBy("label", order.alias("_h")).agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(contents, ["label"], ["_h"], {"n": F.col("n")}, hash_block(F.col("_h")))
    half = F.floor(F.col("n_total") / 2)
    at = (F.col("n_before") < half) & (half <= F.col("n_before") + F.col("n"))
    found = placed.groupBy("label").agg(
        F.max("n_total").alias("total"),
        F.max(F.when(at, F.struct(F.col("_h").alias("h"), (half - F.col("n_before")).alias("take"), F.col("n")))).alias("cut"),
    )
    cuts = {r["label"]: r for r in found.limit(len(LABELS) + 1).collect()}
    if not cuts:
        raise ValueError(f"no rows with split {source_split!r}")
    small = [label for label, r in cuts.items() if r["total"] < 2]
    if small or not set(cuts) <= set(LABELS):
        raise ValueError(f"too few rows, or unknown labels: {sorted(map(str, cuts))}")

    def per_label(field: str) -> Column:
        pairs = [F.lit(x) for label, r in cuts.items() for x in (label, r["cut"][field])]
        return F.create_map(*pairs)[F.col("label")]

    ours = F.col("split") == source_split
    marked = df.withColumn("_side", F.when(ours & (order < per_label("h")), 0).when(ours & (order > per_label("h")), 2).when(ours, 1))
    side = F.when(F.col("_side") == 0, first).when(F.col("_side") == 2, second)
    if all(r["cut"]["take"] == r["cut"]["n"] for r in cuts.values()):
        side = side.when(F.col("_side") == 1, first)
        return marked.withColumn("split", F.coalesce(side, F.col("split"))).drop("_side")

    clear = marked.filter(F.col("_side").isNull() | (F.col("_side") != 1))
    cut_rows = marked.filter(F.col("_side") == 1)
    ordered = ranked(cut_rows, ["label"], ["rel_path"], string_block(cut_rows, "rel_path"))
    inside = F.when(F.col("rank") <= per_label("take"), first).otherwise(second)
    done = ordered.withColumn("split", inside).drop("rank", "rank_total")
    rest = clear.withColumn("split", F.coalesce(side, F.col("split")))
    return rest.unionByName(done).drop("_side")


def hash_sample(df: DataFrame, limit: int, seed: int, keys: Sequence[str] = (), name: str = "rel_path") -> DataFrame:
    """At most `limit` rows per group, the smallest hashes of the path."""
    ordered = df.withColumn("_h", stable_hex(F.col(name), seed))
    if keys:
        return first_per_group(ordered, keys, ["_h", name], limit).drop("_h")
    return ordered.orderBy("_h", name).limit(limit).drop("_h")


def sample_groups(df: DataFrame, n: int, seed: int, group: Sequence[str], name: str = "rel_path") -> DataFrame:
    return hash_sample(df, n, seed, group, name)


def sample_fraction(df: DataFrame, fraction: float, seed: int, group: Sequence[str], name: str = "rel_path") -> DataFrame:
    """A fixed share of every group: round(fraction * n) rows, half to even, in hash order.

    `name` must be unique in the group. Ranks come from hash blocks, not from one sort per group.
    """
    hashed = df.withColumn("_h", stable_hex(F.col(name), seed))
    placed = ranked(hashed, group, ["_h", name], hash_block(F.col("_h")))
    keep = F.bround(F.lit(float(fraction)) * F.col("rank_total"), 0)
    return placed.filter(F.col("rank") <= keep).drop("_h", "rank", "rank_total")


def import_stats(candidates: DataFrame, present: DataFrame, limit: int, seed: int) -> DataFrame:
    """Per source: found, selected, identical_skipped, already_present, copied.

    `candidates` (source, rel_path, sha256); `present` (source, sha256) is what the target holds.
    Of identical files the first path is the one taken.
    """
    found = candidates.groupBy("source").agg(F.count(F.lit(1)).alias("found"))
    chosen = hash_sample(candidates, limit, seed, ["source"])
    contents = chosen.groupBy("source", "sha256").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first_path"))
    held = present.select("source", "sha256").distinct().withColumn("held", F.lit(1))
    marked = contents.join(held, ["source", "sha256"], "left")
    stats = marked.groupBy("source").agg(
        F.sum("n").alias("selected"),
        F.sum(F.col("n") - 1).alias("identical_skipped"),
        F.count("held").alias("already_present"),
        F.count(F.when(F.col("held").isNull(), 1)).alias("copied"),
    )
    return found.join(stats, "source", "left").na.fill(0)


def class_balance(df: DataFrame, max_ratio: float = 1.1) -> DataFrame:
    """One row: readable reals and fakes, a warning if one is missing or they differ much, any EXIF."""
    readable = F.col("read_error").isNull()
    counts = df.agg(
        F.count(F.when(readable & (F.col("label") == "real"), 1)).alias("real"),
        F.count(F.when(readable & (F.col("label") == "fake"), 1)).alias("fake"),
        F.count(F.when(F.lower("has_exif") == "true", 1)).alias("with_exif"),
    )
    low, high = F.least("real", "fake"), F.greatest("real", "fake")
    warning = F.when(low == 0, "single_class").when(F.try_divide(high, low) > max_ratio, "imbalanced").otherwise("none")
    return counts.withColumn("warning", warning)
