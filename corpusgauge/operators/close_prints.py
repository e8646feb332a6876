"""Pairs of fingerprints in which both 64-bit hashes differ in at most d bits, met in small buckets.

Cut into d + 1 chunks, two hashes that close agree on a whole chunk, and this holds for each of the two. So a row goes to
(d + 1)^2 buckets, one for each choice of a chunk of the first and of the second hash, and close rows share one. A bucket with
more than a bounded number of rows is split by the same argument applied to the bits its rows need not share: its rows go to
(d + 1)^2 buckets each of chunks of those. What is still crowded after LEVELS of this is dealt to a grid of shares. A pair may
meet in several buckets and counts in the first one.

Each level shuffles its rows once, on their bucket. Inside a task a bucket's rows are compared by arrays at growing
distance in their order, so no table of candidate pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusgauge.caching import keep

HASH_BITS = 64
HOT_BUCKET = 4096
LEVELS = 3
#: Base of the numbers that name a row's choices of chunks, level by level.
PATH_BASE = 512
#: Rows that a task compares at a time, if a bucket does not have more.
CHUNK_ROWS = 50_000

BUCKET = ("path", "kp", "kd")
U = np.uint64
#: What a comparison sees: columns by name, and rows a and b of each counted pair with both distances.
Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def chunk_masks(max_distance: int, bits: int = HASH_BITS) -> list[tuple[int, int]]:
    """(shift, width) of the d + 1 chunks of so many bits; the first ones take the spare bits."""
    if not 0 <= max_distance <= 16:
        raise ValueError(f"distance must be in 0..16, got {max_distance}")
    n = max_distance + 1
    widths = [bits // n + (1 if i < bits % n else 0) for i in range(n)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def chunk(hash_: Column, shift: int, width: int) -> Column:
    part = F.shiftrightunsigned(hash_, shift)
    return part if width == HASH_BITS else part.bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _bits(x: np.ndarray, shift: int, width: int) -> np.ndarray:
    return (x >> U(shift)) & U((1 << width) - 1) if shift < HASH_BITS else np.zeros_like(x)


def _without(x: np.ndarray, shift: int, width: int, bits: int) -> np.ndarray:
    """The other bits, moved together."""
    high = x >> U(shift + width) if shift + width < bits else np.zeros_like(x)
    return (x & U((1 << shift) - 1)) | (high << U(shift) if shift < HASH_BITS else high)


def _choices(path: int, side: int) -> list[tuple[int, int]]:
    out = []
    while path:
        path, band = divmod(path, PATH_BASE)
        out.append(divmod(band - 1, side))
    return out[::-1]


def _rest(x: np.ndarray, chosen: Sequence[int], max_distance: int) -> tuple[np.ndarray, int]:
    """The bits outside the chosen chunks, and how many they are."""
    bits = HASH_BITS
    for i in chosen:
        shift, width = chunk_masks(max_distance, bits)[i]
        x, bits = _without(x, shift, width, bits), bits - width
    return x, bits


def _first_here(differ: np.ndarray, chosen: Sequence[int], max_distance: int) -> np.ndarray:
    """Whether the chosen chunk is the first without a differing bit, at every level."""
    here, bits = np.ones(len(differ), bool), HASH_BITS
    for i in chosen:
        layout = chunk_masks(max_distance, bits)
        for shift, width in layout[:i]:
            here &= _bits(differ, shift, width) != 0
        shift, width = layout[i]
        here &= _bits(differ, shift, width) == 0
        differ, bits = _without(differ, shift, width, bits), bits - width
    return here


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _split(max_distance: int, names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of crowded buckets, each in all buckets of the next level."""
    side = max_distance + 1

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            paths, kp, kd = (b.column(c).to_numpy() for c in BUCKET)
            p, q = (b.column(c).to_numpy().view(U) for c in ("phash", "dhash"))
            for path in np.unique(paths).tolist():
                at = np.flatnonzero(paths == path)
                chosen = _choices(path, side)
                x, y = (_rest(h[at], c, max_distance) for h, c in zip((p, q), zip(*chosen, strict=True), strict=True))
                rows = [b.column(c).take(pa.array(at)) for c in names]
                for i, (si, wi) in enumerate(chunk_masks(max_distance, x[1])):
                    for j, (sj, wj) in enumerate(chunk_masks(max_distance, y[1])):
                        new_p = (kp[at] << wi) | _bits(x[0], si, wi).view(np.int64)
                        new_d = (kd[at] << wj) | _bits(y[0], sj, wj).view(np.int64)
                        new_path = np.full(len(at), path * PATH_BASE + i * side + j + 1)
                        yield pa.RecordBatch.from_arrays([pa.array(new_path), pa.array(new_p), pa.array(new_d), *rows], [*BUCKET, *names])

    return go


def _bucketed(rows: DataFrame, max_distance: int, hot: int) -> list[DataFrame]:
    """Tables of rows gathered by bucket, with at most `hot` rows in each, or twice that where `share` is set."""
    names, side = rows.columns, max_distance + 1
    layout = chunk_masks(max_distance)
    halves = rows.select("*", F.posexplode(F.array(*[chunk(F.col("phash"), *x) for x in layout])).alias("i", "kp"))
    keyed = halves.select("*", F.posexplode(F.array(*[chunk(F.col("dhash"), *x) for x in layout])).alias("j", "kd"))
    level = keyed.select((F.col("i") * side + F.col("j") + 1).cast("bigint").alias("path"), "kp", "kd", *names)
    schema = StructType([*(StructField(c, LongType()) for c in BUCKET), *rows.schema])
    out: list[DataFrame] = []
    for depth in range(LEVELS):
        sized = keep(level.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*BUCKET))).filter("rows > 1"))
        crowded = sized.filter(F.col("rows") > hot)
        out.append(sized.filter(F.col("rows") <= hot).withColumn("share", F.lit(-1)).drop("rows").sortWithinPartitions(*BUCKET))
        if crowded.isEmpty():
            return out
        if depth < LEVELS - 1:
            level = crowded.select(*BUCKET, *names).mapInArrow(_split(max_distance, names), schema)
    # every two shares of a bucket meet in a group of their own: nothing grows but the number of groups
    shares = F.ceil(F.col("rows") / hot).cast("int")
    own = crowded.withColumn("share", F.pmod(F.xxhash64("phash", "dhash"), shares).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), shares - 1)))
    low, high = F.least("share", "other"), F.greatest("share", "other")
    grid = dealt.withColumns({"ga": low, "gb": high, "share": F.when(F.col("share") == F.col("other"), -1).otherwise(F.col("share"))})
    group = [*BUCKET, "ga", "gb"]
    out.append(grid.drop("rows", "other").repartition(*group).sortWithinPartitions(*group))
    return out


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that end with a bucket, and how many rows of its bucket follow each row."""
    held: list[pa.RecordBatch] = []
    size = 0

    def ends(table: pa.Table) -> np.ndarray:
        turn = np.zeros(table.num_rows, bool)
        turn[-1:] = True
        for c in ("path", "kp", "kd", "ga", "gb"):
            if c in table.column_names:
                values = _column(table, c)
                turn[:-1] |= values[1:] != values[:-1]
        return np.flatnonzero(turn)

    def counted(table: pa.Table, end: np.ndarray) -> tuple[pa.Table, np.ndarray]:
        last = np.repeat(end, np.diff(end, prepend=-1))
        return table, last - np.arange(table.num_rows)

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CHUNK_ROWS:
            table = pa.Table.from_batches(held)
            end = ends(table)
            if len(end) > 1:
                cut = int(end[-2]) + 1
                yield counted(table.slice(0, cut), end[:-1])
                held = table.slice(cut).combine_chunks().to_batches()
                size = table.num_rows - cut
    if size:
        table = pa.Table.from_batches(held)
        yield counted(table, ends(table))


def _met(table: pa.Table, after: np.ndarray, max_distance: int) -> Found:
    """Rows a < b of each pair that counts here, and its distances: neighbours first, then rows further apart."""
    p, q = (_column(table, c).view(U) for c in ("phash", "dhash"))
    path, share = _column(table, "path"), _column(table, "share")
    a, k, side = np.arange(len(p)), 1, max_distance + 1
    while True:
        a = a[after[a] >= k]
        if not len(a):
            return
        x, y = p[a] ^ p[a + k], q[a] ^ q[a + k]
        dp, dq = np.bitwise_count(x), np.bitwise_count(y)
        ok = (dp <= max_distance) & (dq <= max_distance) & ((share[a] < 0) | (share[a] != share[a + k]))
        for one in np.unique(path[a[ok]]).tolist():
            at = np.flatnonzero(ok & (path[a] == one))
            chosen_p, chosen_d = zip(*_choices(one, side), strict=True)
            at = at[_first_here(x[at], chosen_p, max_distance) & _first_here(y[at], chosen_d, max_distance)]
            if len(at):
                yield a[at], a[at] + k, dp[at].astype(np.int32), dq[at].astype(np.int32)
        k += 1


def compare(
    rows: DataFrame, max_distance: int, schema: str, look: Callable[[pa.Table, Found], Iterator[pa.RecordBatch]], hot: int = HOT_BUCKET
) -> DataFrame:
    """`look` sees tables of whole buckets with the pairs that count there, and gives rows of `schema`.

    `rows` has phash, dhash and whatever `look` needs. Every close pair of rows is seen once, also rows with equal hashes.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, after in _whole_buckets(batches):
            yield from look(table, _met(table, after, max_distance))

    parts = [t.mapInArrow(go, schema) for t in _bucketed(rows, max_distance, hot)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def close_pairs(rows: DataFrame, order: Sequence[str], max_distance: int, hot: int = HOT_BUCKET) -> DataFrame:
    """Each close pair of rows: all their columns but the hashes, as <column>_i and <column>_j, and both distances; i comes first by `order` (numbers)."""
    names = [c for c in rows.columns if c not in ("phash", "dhash")]
    types = {f.name: f.dataType for f in rows.schema}
    schema = ", ".join(f"{c}_{t} {types[c].simpleString()}" for t in "ij" for c in names) + ", phash_dist int, dhash_dist int"

    def look(table: pa.Table, found: Found) -> Iterator[pa.RecordBatch]:
        columns = [table.column(c).combine_chunks() for c in names]
        keys = [_column(table, c) for c in order]
        for a, b, dp, dq in found:
            swap, tied = np.zeros(len(a), bool), np.ones(len(a), bool)
            for key in keys:
                swap |= tied & (key[a] > key[b])
                tied &= key[a] == key[b]
            first, second = pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b))
            sides = [c.take(at) for at in (first, second) for c in columns]
            yield pa.RecordBatch.from_arrays([*sides, pa.array(dp), pa.array(dq)], [*(f"{c}_{t}" for t in "ij" for c in names), "phash_dist", "dhash_dist"])

    return compare(rows, max_distance, schema, look, hot)


def partners(cells: DataFrame, max_distance: int, hot: int = HOT_BUCKET) -> DataFrame:
    """For cells (phash, dhash, split, label, rank, n, first_id): what their close pairs amount to, without a row per pair.

    Rows with a kept_id say that cells of (phash, dhash, split) have a partner of lower rank, the smallest of whose ids in some
    bucket is kept_id. The other rows hold sums over item pairs: total, cross (ranks differ) and conflict (labels differ).
    """
    schema = "phash bigint, dhash bigint, split string, kept_id bigint, total bigint, cross bigint, conflict bigint"
    names = [x.split()[0] for x in schema.split(", ")]
    never = np.iinfo(np.int64).max

    def look(table: pa.Table, found: Found) -> Iterator[pa.RecordBatch]:
        rank, n, first = (_column(table, c) for c in ("rank", "n", "first_id"))
        label = table.column("label").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        best, sums = np.full(len(rank), never), [0, 0, 0]
        for a, b, _, _ in found:
            pairs = n[a] * n[b]
            across = rank[a] != rank[b]
            sums[0] += int(pairs.sum())
            sums[1] += int(pairs[across].sum())
            sums[2] += int(pairs[(label[a] != label[b]) & (label[a] >= 0) & (label[b] >= 0)].sum())
            # a row stands once among the a and once among the b of a step
            lose_a, lose_b = rank[a] > rank[b], rank[a] < rank[b]
            best[a[lose_a]] = np.minimum(best[a[lose_a]], first[b[lose_a]])
            best[b[lose_b]] = np.minimum(best[b[lose_b]], first[a[lose_b]])
        at = pa.array(np.flatnonzero(best < never))
        none = pa.nulls(len(at), pa.int64())
        losers = [table.column(c).combine_chunks().take(at) for c in ("phash", "dhash", "split")]
        yield pa.RecordBatch.from_arrays([*losers, pa.array(best).take(at), none, none, none], names)
        if sums[0]:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), *(pa.array([s]) for s in sums)], names)

    return compare(cells, max_distance, schema, look, hot)
