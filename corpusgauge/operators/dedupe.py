"""Near duplicates under two 64-bit fingerprints, and what to drop because of them.

Two items are near when both fingerprints differ in at most d bits; `close_prints` finds them.

Copies are folded before anything is compared. The unit is the *print*, a distinct pair of
fingerprints, known by its smallest item id, or a *cell*, the items of one print, dataset, split and label.
Pair tables hold one row per pair of these with the number of item pairs it stands for; so a group of copies
holding a third of all items is one row, totals stay exact and nothing quadratic is written. Drops and the report need no
pair table at all: buckets give each cell's smallest partner and sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.caching import keep
from corpusgauge.operators.close_prints import HOT_BUCKET, chunk, chunk_masks, close_pairs, partners
from corpusgauge.operators.joins import HOT_ROWS, lookup_join
from corpusgauge.operators.ordering import first_per_group

CELL = ("dataset", "split", "label")


def bucket_sizes(items: DataFrame, max_distance: int) -> DataFrame:
    """Items per (chunk number, chunk value) of the first fingerprint."""
    parts = [
        F.struct(F.lit(i).alias("band"), chunk(F.col("phash"), s, w).alias("chunk"))
        for i, (s, w) in enumerate(chunk_masks(max_distance))
    ]
    return items.select(F.inline(F.array(*parts))).groupBy("band", "chunk").agg(F.count(F.lit(1)).alias("n"))


def bucket_guard(items: DataFrame, max_distance: int = 4, max_bucket: int = 50_000) -> DataFrame:
    """Buckets above a size: usually blank or identical files worth a look. The join copes with them."""
    return bucket_sizes(items, max_distance).filter(F.col("n") > max_bucket)


def cells_of(items: DataFrame) -> DataFrame:
    """Items folded to (fingerprints, dataset, split, label): size and smallest id."""
    sizes = [F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_id")]
    return keep(items.groupBy("phash", "dhash", *CELL).agg(*sizes))


def prints_of(cells: DataFrame) -> DataFrame:
    """Distinct fingerprint pairs: `print_id` is the smallest item id, `n` the number of items."""
    return cells.groupBy("phash", "dhash").agg(F.sum("n").alias("n"), F.min("first_id").alias("print_id"))


def print_pairs(prints: DataFrame, max_distance: int, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Pairs of different prints within the distance: print_i < print_j, both distances, both sizes."""
    found = close_pairs(prints.select("phash", "dhash", "print_id", "n"), ["print_id"], max_distance, hot_bucket)
    return found.select(F.col("print_id_i").alias("print_i"), F.col("print_id_j").alias("print_j"), "phash_dist", "dhash_dist", "n_i", "n_j")


def near_duplicate_pairs(items: DataFrame, max_distance: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """All near pairs, folded: pairs of prints, and one row per print that has copies (print_i = print_j).

    `pairs` is the number of item pairs a row stands for; their sum is the size of the item-level list.
    """
    prints = prints_of(cells_of(items))
    between = print_pairs(prints, max_distance, hot_bucket).withColumn("pairs", F.col("n_i") * F.col("n_j"))
    copies = prints.filter(F.col("n") > 1).select(
        F.col("print_id").alias("print_i"),
        F.col("print_id").alias("print_j"),
        F.lit(0).alias("phash_dist"),
        F.lit(0).alias("dhash_dist"),
        F.col("n").alias("n_i"),
        F.col("n").alias("n_j"),
        F.expr("n * (n - 1) div 2").alias("pairs"),
    )
    return between.unionByName(copies)


def print_members(items: DataFrame) -> DataFrame:
    """Which print an item belongs to: with the print pairs, this is the whole item-level pair list."""
    prints = prints_of(cells_of(items))
    return _with_print(items, prints).select("item_id", "print_id")


def _with_print(items: DataFrame, prints: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    key = ["phash", "dhash"]
    return lookup_join(items, prints.select(*key, "print_id"), key, prints, hot_rows)


def _split_rank(split: Column, priority: Sequence[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(s) for s in priority]), split) - 1
    unknown = F.raise_error(F.concat(F.lit("split without priority: "), F.coalesce(split, F.lit("null"))))
    return F.when(place >= 0, place.cast("int")).otherwise(unknown.cast("int"))


def annotate_pairs(
    items: DataFrame, split_priority: Sequence[str], max_distance: int = 4, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """Near pairs by cell: dataset, split and label of both sides, cross_split, label_conflict, pairs.

    A print has few cells, so the table stays in proportion to the print pairs.
    """
    return _annotated(cells_of(items), split_priority, max_distance, hot_bucket)


def _annotated(
    cells: DataFrame, split_priority: Sequence[str], max_distance: int = 4, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    own_print = F.min("first_id").over(Window.partitionBy("phash", "dhash"))
    named = cells.withColumn("print", own_print).withColumn("rank", _split_rank(F.col("split"), split_priority))
    between = close_pairs(named, ["print", "first_id"], max_distance, hot_bucket).withColumn("pairs", F.col("n_i") * F.col("n_j"))
    sides = [F.col(c).alias(f"{c}_{t}") for t in "ij" for c in named.columns if c not in ("phash", "dhash")]
    own = named.filter(F.col("n") > 1).select(*sides, F.lit(0).alias("phash_dist"), F.lit(0).alias("dhash_dist"), F.expr("n * (n - 1) div 2").alias("pairs"))
    return (
        between.unionByName(own)
        .withColumn("cross_split", F.col("rank_i") != F.col("rank_j"))
        .withColumn("label_conflict", F.col("label_i") != F.col("label_j"))
    )


def _partners(cells: DataFrame, split_priority: Sequence[str], max_distance: int, hot_bucket: int) -> DataFrame:
    folded = cells.groupBy("phash", "dhash", "split", "label").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"))
    return partners(folded.withColumn("rank", _split_rank(F.col("split"), split_priority)), max_distance, hot_bucket)


def _drop_cells(found: DataFrame) -> DataFrame:
    """Per (print, split) that loses: the smallest partner id in an earlier split.

    An item's first pair in (i, j) order is the one with its smallest partner, on whichever side.
    """
    return found.filter("kept_id is not null").groupBy("phash", "dhash", "split").agg(F.min("kept_id").alias("kept_id"))


def resolve_drops(
    items: DataFrame, split_priority: Sequence[str], max_distance: int = 4, hot_bucket: int = HOT_BUCKET
) -> DataFrame:
    """One row per item to drop: its near partner sits in an earlier split. Same-split pairs stay."""
    cells = cells_of(items)
    return _drops(items, cells, _partners(cells, split_priority, max_distance, hot_bucket))


def _drops(items: DataFrame, cells: DataFrame, found: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    kept = items.select(
        F.col("item_id").alias("kept_id"),
        F.col("phash").alias("kept_phash"),
        F.col("dhash").alias("kept_dhash"),
        F.col("dataset").alias("duplicate_of_dataset"),
        F.col("split").alias("duplicate_of_split"),
        F.col("rel_path").alias("duplicate_of_rel_path"),
    )
    losers = keep(_drop_cells(found)).join(kept, "kept_id").drop("kept_id")
    key = ["phash", "dhash", "split"]
    sizes = cells.groupBy(*key).agg(F.sum("n").alias("n"))
    return lookup_join(items, losers, key, sizes, hot_rows).select(
        "dataset",
        "split",
        "rel_path",
        "duplicate_of_dataset",
        "duplicate_of_split",
        "duplicate_of_rel_path",
        F.bit_count(F.col("phash").bitwiseXOR(F.col("kept_phash"))).alias("phash_dist"),
        F.bit_count(F.col("dhash").bitwiseXOR(F.col("kept_dhash"))).alias("dhash_dist"),
    )


def pair_totals(annotated: DataFrame) -> DataFrame:
    """Item-pair totals: all, same split, cross split, label conflicts."""

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("pairs")).otherwise(0)), F.lit(0))

    return annotated.agg(
        total(F.lit(True)).alias("pairs_total"),
        total(~F.col("cross_split")).alias("pairs_same_split"),
        total(F.col("cross_split")).alias("pairs_cross_split"),
        total(F.col("label_conflict")).alias("pairs_with_label_conflict"),
    )


def dedupe_report(items: DataFrame, split_priority: Sequence[str], max_distance: int = 4, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Long report (metric, dataset, split, n): pair totals, items hashed, drops, drops per split."""
    cells = cells_of(items)
    found = keep(_partners(cells, split_priority, max_distance, hot_bucket))
    # pairs inside a cell are neither across splits nor in conflict, but datasets are folded in the sums of partners
    inside = cells.groupBy("phash", "dhash", "split", "label").agg(F.sum("n").alias("n"))
    own = inside.select(F.expr("n * (n - 1) div 2").alias("total"), F.lit(0).cast("bigint").alias("cross"), F.lit(0).cast("bigint").alias("conflict"))
    sums = found.select("total", "cross", "conflict").unionByName(own).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "cross", "conflict")])
    totals = sums.select(
        F.col("total").alias("pairs_total"),
        (F.col("total") - F.col("cross")).alias("pairs_same_split"),
        F.col("cross").alias("pairs_cross_split"),
        F.col("conflict").alias("pairs_with_label_conflict"),
    )
    names = ["pairs_total", "pairs_same_split", "pairs_cross_split", "pairs_with_label_conflict"]
    rows = totals.unpivot([], names, "metric", "n")
    hashed = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("metric", F.lit("images_hashed"))
    drops = cells.join(_drop_cells(found), ["phash", "dhash", "split"])
    by_split = drops.groupBy("dataset", "split").agg(F.sum("n").alias("n")).withColumn("metric", F.lit("dropped_by_dataset_split"))
    dropped = by_split.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).withColumn("metric", F.lit("dropped_images"))
    plain = rows.unionByName(hashed).unionByName(dropped)
    nothing = F.lit(None).cast("string")
    whole = plain.withColumns({"dataset": nothing, "split": nothing})
    return whole.unionByName(by_split).select("metric", "dataset", "split", "n")


def borderline_pairs(items: DataFrame, split_priority: Sequence[str], max_distance: int = 4, k: int = 12) -> DataFrame:
    """The k cross-split item pairs with the largest distances, ties by smaller ids.

    The k best cells hold the k best pairs, and inside a cell only its k smallest ids can matter.
    """
    folded = cells_of(items)
    cross = _annotated(folded, split_priority, max_distance).filter("cross_split")
    first, second = F.least("first_id_i", "first_id_j"), F.greatest("first_id_i", "first_id_j")
    farthest = [F.col("phash_dist").desc(), F.col("dhash_dist").desc()]
    cells = cross.orderBy(*farthest, first, second).limit(k)

    # the k smallest ids per cell before the print is looked up: copies are gone by then
    few = first_per_group(items.select("phash", "dhash", *CELL, "item_id"), ["phash", "dhash", *CELL], ["item_id"], k)
    few = few.join(prints_of(folded).select("phash", "dhash", "print_id"), ["phash", "dhash"])

    def side(tag: str) -> DataFrame:
        return few.select(*[F.col(c).alias(f"{c}_{tag}") for c in (*CELL,)], F.col("print_id").alias(f"print_{tag}"), F.col("item_id").alias(f"id_{tag}"))

    on_i = ["print_i", *[f"{c}_i" for c in CELL]]
    on_j = ["print_j", *[f"{c}_j" for c in CELL]]
    open_pairs = cells.join(side("i"), on_i).join(side("j"), on_j)
    swap = F.col("id_i") > F.col("id_j")
    pairs = open_pairs.select(
        F.least("id_i", "id_j").alias("id_i"),
        F.greatest("id_i", "id_j").alias("id_j"),
        F.when(swap, F.col("split_j")).otherwise(F.col("split_i")).alias("split_i"),
        F.when(swap, F.col("split_i")).otherwise(F.col("split_j")).alias("split_j"),
        "phash_dist",
        "dhash_dist",
    )
    return pairs.orderBy(F.col("phash_dist").desc(), F.col("dhash_dist").desc(), "id_i", "id_j").limit(k)
