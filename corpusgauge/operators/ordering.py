"""Running totals, ranks and exact quantiles over groups of any size.

A window ordered inside a large group sorts that group in one task. Here the order is cut into
blocks first, block totals are added up per group, and the window runs inside (group, block).
Every row counts, and a group holding most of the table is spread over all blocks. Blocks only
balance the work: results do not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, about; and blocks at most, as their cuts go through the driver.
ROWS_PER_BLOCK = 250_000
MOST_BLOCKS = 16_384
STRING_BLOCKS = 64
STRING_SAMPLE = 4096


def block_count(n_rows: int) -> int:
    """Blocks for so many rows: each about as large as a task sorts at ease."""
    return max(1, min(MOST_BLOCKS, -(-n_rows // ROWS_PER_BLOCK)))


def with_value_blocks(df: DataFrame, columns: Mapping[str, str], blocks: int | None = None) -> DataFrame:
    """Add a block number per numeric column ({column: block column}); their number follows from the rows.

    One pass of quantile sketches gives the cuts, which come to the driver. Few rows are one block and need no cuts.
    """
    names = list(columns)
    if blocks is None:
        blocks = block_count(df.count())
    if blocks < 2:
        return df.withColumns({columns[c]: F.lit(0) for c in names})
    as_double = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    sketched = as_double.approxQuantile(names, [i / blocks for i in range(1, blocks)], 0.5 / blocks)
    for name, cuts in zip(names, sketched, strict=True):
        splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
        if len(splits) < 3:
            df = df.withColumn(columns[name], F.lit(0))
            continue
        df = df.withColumn("_raw", F.col(name).cast("double"))
        step = Bucketizer(splits=splits, inputCol="_raw", outputCol="_block_no", handleInvalid="keep")
        df = step.transform(df).withColumn(columns[name], F.col("_block_no").cast("int")).drop("_raw", "_block_no")
    return df


def hash_block(hex_text: Column) -> Column:
    """Block of a uniform hash in hex: its first three digits, 4096 even blocks."""
    return F.conv(F.substring(hex_text, 1, 3), 16, 10).cast("int")


def string_block(df: DataFrame, column: str, blocks: int = STRING_BLOCKS) -> Column:
    """Block of a text column; the cuts come from a hash sample of bounded size."""
    n = df.count()
    one_in = max(1, n // STRING_SAMPLE)
    picked = df.select(column).filter(F.pmod(F.xxhash64(column), F.lit(one_in)) == 0).distinct()
    sample = sorted(r[0] for r in picked.limit(8 * STRING_SAMPLE).collect() if r[0] is not None)
    cuts = sample[:: max(1, -(-len(sample) // blocks))][1:]
    return reduce(lambda acc, c: acc + (F.col(column) >= F.lit(c)).cast("int"), cuts, F.lit(0))


def _along(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Mapping[str, Column],
    block: Column,
    fold: Callable[[Column | str], Column],
    merge: Callable[[Column, Column], Column],
) -> DataFrame:
    """Fold of the earlier rows (`<name>_before`, null for the first) and of the group (`<name>_total`)."""
    # the keys as one value that is never null: what the plain join deals by serves the window after it too
    key = F.struct(*keys) if keys else F.lit(0)
    placed = df.withColumns({"_key": key, "_block": block, **{f"_{name}": value for name, value in values.items()}})
    group = ["_key", "_block"]
    per_block = placed.groupBy(*group).agg(*[fold(f"_{name}").alias(f"_{name}") for name in values])
    # one row per (group, block): the number of blocks is fixed, so this window stays small
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_key")
    offsets = per_block.select(
        *[F.col(c).alias(f"_at_{c}") for c in group],
        *[fold(f"_{name}").over(earlier).alias(f"_{name}_offset") for name in values],
        *[fold(f"_{name}").over(whole).alias(f"{name}_total") for name in values],
    )
    joined = placed.join(offsets, [F.col(c) == F.col(f"_at_{c}") for c in group])
    local = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = {f"{name}_before": merge(F.col(f"_{name}_offset"), fold(f"_{name}").over(local)) for name in values}
    scratch = [*group, *[f"_at_{c}" for c in group], *[f"_{n}" for n in values], *[f"_{n}_offset" for n in values]]
    return joined.withColumns(before).drop(*scratch)


def running_totals(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], block: Column
) -> DataFrame:
    """Add `<name>_before` (sum over earlier rows of the group) and `<name>_total` for each sum.

    `order` must tell rows of one group apart (aggregate ties first) and `block` must never fall
    along that order.
    """

    def plus(a: Column, b: Column) -> Column:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))

    return _along(df, keys, order, sums, block, F.sum, plus)


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Mapping[str, Column], block: Column
) -> DataFrame:
    """Add `<name>_before`, the largest earlier value of the group (null for its first row)."""
    done = _along(df, keys, order, values, block, F.max, lambda a, b: F.greatest(a, b))
    return done.drop(*[f"{name}_total" for name in values])


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, name: str = "rank") -> DataFrame:
    """Add the 1-based rank in the group and `<name>_total`, the group's size."""
    done = running_totals(df, keys, order, {name: F.lit(1).cast("bigint")}, block)
    return done.withColumn(name, F.col(f"{name}_before") + 1).drop(f"{name}_before")


def first_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """At most n rows per group. Map tasks keep n rows per group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def exact_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Quantiles with linear interpolation, long form: keys, `feature`, one column per name, `n`.

    Values are counted before they are ordered, so the cost follows distinct values and no task
    holds a whole group. Nulls and NaN are left out.
    """
    blocked = with_value_blocks(df, {c: f"_block_{c}" for c in columns})
    triples = [
        F.struct(
            F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(f"_block_{c}").alias("_at")
        )
        for c in columns
    ]
    long = blocked.select(*keys, F.inline(F.array(*triples))).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    counted = long.groupBy(*keys, "feature", "_at", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = running_totals(counted, [*keys, "feature"], ["value"], {"n": F.col("n")}, F.col("_at"))

    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    picks = []
    for name, q in probs.items():
        at = (F.col("n_total") - 1) * F.lit(float(q))
        low, high = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((first <= low) & (low <= last), F.col("value"))).alias(f"_{name}_low"),
            F.max(F.when((first <= high) & (high <= last), F.col("value"))).alias(f"_{name}_high"),
            F.max(at - low).alias(f"_{name}_part"),
        ]
    found = placed.groupBy(*keys, "feature").agg(*picks, F.max("n_total").alias("n"))
    blend = [
        (F.col(f"_{p}_low") + (F.col(f"_{p}_high") - F.col(f"_{p}_low")) * F.col(f"_{p}_part")).alias(p) for p in probs
    ]
    return found.select(*keys, "feature", *blend, "n")
