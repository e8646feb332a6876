"""Exact set-similarity join of documents by word shingles.

Shingles are ordered by how often they occur in the corpus (counted in a table of fixed size), rare ones first. Two sets that
are similar enough share one of the first few of them, so each distinct set is posted under those alone. A posting list is
walked in blocks of equal place: places and sizes bound what two sets can share, and whole blocks that cannot reach
the threshold are skipped. Answers are derived from those of a similar set: each set is compared with one hub, the smallest
possible partner that its lists know, and what it lacks of the hub's shingles and adds to them is kept. What two sets of one hub share follows
from these few shingles, inside the lists, where only pairs of different classes are looked at; links found join classes at once. So a crowd of
near copies is never expanded into pairs, and only pairs without a common hub are decided on their texts. No text is moved for a pair
whose sketches (counts of a set's shingles by the first bits of their names) differ by more than a link allows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.components import components
from corpusgauge.llm.mph import mix
from corpusgauge.llm.shared import free_name, stored
from corpusgauge.llm.words import WORD_BASE, WORD_BASE_2, chunks, spans

U = np.uint64
#: Counters of shingles, the parts they are summed in, and the groups of tasks that are summed first.
COUNTERS, PARTS, GROUPS = 1 << 21, 64, 8
#: Bits of a table of digests for each digest, and the most bits that it has.
BITS, MOST_BITS = 16, 1 << 27
#: Sets of a block of a posting list.
BLOCK = 128


def shingle_sets(texts: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, shingles, where each text's begin) of chunks of a column: distinct ascending names per text.

    A-Z are lower-cased. A text with fewer than n words, but some, has all of them as its one shingle.
    """
    for a, names, starts in chunks(texts, lower=True):
        sizes = np.diff(starts)
        count = np.where(sizes >= n, sizes - n + 1, np.minimum(sizes, 1))
        of = np.repeat(np.arange(len(sizes)), count)
        begin = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        end = begin + np.minimum(n, sizes[of])
        with np.errstate(over="ignore"):
            value = mix(spans(names, begin, end, WORD_BASE) + (end - begin).astype(U) * U(WORD_BASE_2), 20)
        order = np.lexsort((value, of))
        value, of = value[order], of[order]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (of[1:] != of[:-1])
        value, of = value[new], of[new]
        yield a, value, np.searchsorted(of, np.arange(len(sizes) + 1))


def _marks(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers that name each set; 0 for empty ones."""
    out = []
    for seed in (21, 22):
        with np.errstate(over="ignore"):
            total = np.concatenate([np.zeros(1, U), np.cumsum(mix(value, seed))])
            out.append((total[starts[1:]] - total[starts[:-1]]).view(np.int64))
    return tuple(out)


def sketches(value: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A sketch of each set: how many of its shingles begin with the same bits, up to 15, two counts a byte.

    There are 2 to 4 shingles to a count, so a longer set has a longer sketch.
    """
    size = np.diff(starts)
    bits = np.maximum(np.frexp(size)[1] - 2, 1)
    begin = np.concatenate([[0], np.cumsum(1 << bits)])
    of = np.repeat(np.arange(len(size)), size)
    cell = begin[of] + (value >> (64 - bits[of]).astype(U)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=begin[-1]), 15).astype(np.uint8).reshape(-1, 2)
    packed = counts[:, 0] | counts[:, 1] << 4
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((begin // 2).astype(np.int32)), pa.py_buffer(packed)])


def sketches_apart(x: bytes, y: bytes) -> int:
    """By how many shingles at least two sets differ, from their sketches."""
    counts = []
    for packed in (x, y):
        flat = np.frombuffer(packed, np.uint8)
        c = np.stack([flat & 15, flat >> 4], 1).ravel().astype(np.int16)
        while len(c) > 2 * min(len(x), len(y)):  # counts of one bit less; capped again, they are as if counted so
            c = np.minimum(c[0::2] + c[1::2], 15)
        counts.append(c)
    return int(np.abs(counts[0] - counts[1]).sum())


def may_link(b: pa.RecordBatch, num: int, den: int, near: bool = False) -> np.ndarray:
    """Which rows (.., size, sketch, other_size, other_sketch) can be links or, with near, differ by at most half of a set."""
    size, other = (b.column(c).to_numpy().astype(np.int64) for c in ("size", "other_size"))
    apart = [sketches_apart(x.as_py(), y.as_py()) for x, y in zip(b.column("sketch"), b.column("other_sketch"), strict=True)]
    most = size + other - 2 * least_overlap(size, other, num, den)
    return np.array(apart, np.int64) <= (np.maximum(most, size // 2) if near else most)


def survey(texts: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """(key, digest, size, h1, h2, sketch) of each text's set, and how many sets of the corpus have a shingle with each counter.

    All documents count; the table of counters has a fixed size, and tasks' tables are summed in two steps.
    """
    part = COUNTERS // PARTS
    names = ["key", "digest", "size", "h1", "h2", "sketch", "part", "group", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            for a, value, starts in shingle_sets(b.column(1), n):
                np.add.at(total, (value % U(COUNTERS)).astype(np.int64), 1)
                h1, h2 = _marks(value, starts)
                m = len(h1)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, m), b.column(2).slice(a, m), pa.array(np.diff(starts)), pa.array(h1), pa.array(h2), sketches(value, starts), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)
        if total.any():
            group, none = TaskContext.get().partitionId() % GROUPS, pa.nulls(PARTS, pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.nulls(PARTS, pa.binary()), pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, group, np.int32)), pa.array([zlib.compress(x, 1) for x in total.reshape(PARTS, part)], pa.binary())], names)

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(part, np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(zlib.decompress(x.as_py()), np.int64)
        return pa.table({"part": group.column("part")[:1], "group": group.column("group")[:1], "counts": pa.array([zlib.compress(total, 1)], pa.binary())})

    found = stored(texts.mapInArrow(count, "key long, digest long, size long, h1 long, h2 long, sketch binary, part int, group int, counts binary"), "survey")
    schema = "part int, group int, counts binary"
    tables = found.where("part is not null").select("part", "group", "counts")
    summed = tables.groupBy("part", "group").applyInArrow(add, schema).groupBy("part").applyInArrow(add, schema)
    out = np.zeros((PARTS, part), np.int64)
    for r in summed.select("part", "counts").collect():  # PARTS rows of a fixed size
        out[r["part"]] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    return found.where("part is null").select("key", "digest", "size", "h1", "h2", "sketch"), out.reshape(-1)


def histograms(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers per set that hold how many of its shingles fall to each of 16 classes, a byte each, 255 for more."""
    n = len(starts) - 1
    of = np.repeat(np.arange(n), np.diff(starts))
    cell = of * 16 + ((value >> U(40)) & U(15)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=16 * n), 255).astype(np.uint8).reshape(n, 16)
    return tuple(np.ascontiguousarray(counts[:, i : i + 8]).view(np.int64).ravel() for i in (0, 8))


def least_overlap(x: np.ndarray, y: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shared shingles that sets of x and y shingles need: den * shared >= num * (x + y - shared)."""
    return -(-(num * (x + y)) // (num + den))


class Posting:
    """Sets of one list: place of the list's shingle in each, set sizes, and names; sorted by place."""

    def __init__(self, at: np.ndarray, size: np.ndarray, key: np.ndarray, mark: np.ndarray, low8: np.ndarray, high8: np.ndarray, group: np.ndarray | None = None):
        order = np.lexsort((key, size, mark))
        mark, sizes = mark[order], size[order]
        new = np.ones(len(order), bool)
        new[1:] = (mark[1:] != mark[:-1]) | (sizes[1:] != sizes[:-1])
        order = order[new]  # equal sets: the smallest key stands for them
        order = order[np.lexsort((key[order], size[order], at[order]))]
        self.at, self.size, self.key = at[order].astype(np.int64), size[order].astype(np.int64), key[order]
        self.low8, self.high8 = low8[order], high8[order]
        self.classes = np.stack([self.low8, self.high8], 1).view(np.uint8).astype(np.int16)
        self.group = None if group is None else group[order]

        self.blocks = np.arange(0, len(order), BLOCK)
        self.low_at = self.at[self.blocks]
        self.low, self.high = (f.reduceat(self.size, self.blocks) for f in (np.minimum, np.maximum))

    def possible(self, i: int, num: int, den: int) -> np.ndarray:
        """Which sets after set i can be similar enough to it, by sizes and places; blocks that cannot hold one are skipped."""
        own, left = self.size[i], self.size[i] - self.at[i]
        near = (np.minimum(left, self.high - self.low_at) >= least_overlap(own, self.low, num, den)) & (self.high * den >= num * own) & (own * den >= num * self.low)
        near[: i // BLOCK] = False
        blocks = np.flatnonzero(near)
        if not len(blocks):
            return blocks
        rest = (self.blocks[blocks][:, None] + np.arange(BLOCK)).ravel()
        rest = rest[(rest > i) & (rest < len(self.key))]
        y = self.size[rest]
        ok = (np.minimum(left, y - self.at[rest]) >= least_overlap(own, y, num, den)) & (np.minimum(y, own) * den >= num * np.maximum(y, own))
        rest, y = rest[ok], y[ok]
        # sets differ at least as much as their classes' counts do
        apart = np.abs(self.classes[rest] - self.classes[i]).sum(axis=1)
        return rest[apart <= own + y - 2 * least_overlap(own, y, num, den)]


def _each_set(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Shingles of each text of a column; equal texts share one array."""
    coded = texts.dictionary_encode()
    found = [x for _, value, starts in shingle_sets(coded.dictionary, n) for x in np.split(value, starts[1:-1])]
    return [found[i] for i in coded.indices.to_numpy()]


def similar_rows(texts: pa.Array, others: pa.Array, n: int, num: int, den: int) -> np.ndarray:
    """For each row of two text columns, whether den * (shared shingles) >= num * (shingles of either)."""
    out = np.zeros(len(texts), bool)
    for i, (x, y) in enumerate(zip(_each_set(texts, n), _each_set(others, n), strict=True)):
        if len(x) and len(y):
            shared = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            out[i] = den * shared >= num * (len(x) + len(y) - shared)
    return out


def _relations(b: pa.RecordBatch, n: int, num: int, den: int) -> pa.RecordBatch:
    """(key, hub, linked, hub_size, lacks, adds) of rows (key, hub, text, other): the places of the hub's shingles that a set lacks, and those it adds.

    Where both are more than half of the set, nothing is kept: such a set is compared by its text.
    """
    linked, sizes, lacks, adds = [], [], [], []
    for x, y in zip(_each_set(b.column(2), n), _each_set(b.column(3), n), strict=True):
        there = np.isin(y, x, assume_unique=True, kind="sort")
        shared = int(there.sum())
        linked.append(bool(shared) and den * shared >= num * (len(x) + len(y) - shared))
        sizes.append(len(y))
        near = len(x) + len(y) - 2 * shared <= len(x) // 2
        lacks.append(np.flatnonzero(~there).astype("<u4").tobytes() if near else None)
        adds.append(x[~np.isin(x, y, assume_unique=True, kind="sort")].tobytes() if near else None)
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked), pa.array(sizes, pa.int32()), pa.array(lacks, pa.binary()), pa.array(adds, pa.binary())], ["key", "hub", "linked", "hub_size", "lacks", "adds"])


class Relations:
    """How some sets differ from their hubs: X is the hub's set without the places `lacks` of it and with `adds`.

    What two sets of one hub share follows from these few shingles: the hub's size less the shingles that either
    lacks, and those that both add. So the answers for a set come from its hub's, and no set is read again.
    """

    def __init__(self, hub: np.ndarray, hub_size: np.ndarray, lacks: np.ndarray, adds: np.ndarray):
        self.hub, self.hub_size = hub, hub_size.astype(np.int64)
        self.lacks, self.adds = self._flat(lacks, np.dtype("<u4")), self._flat(adds, np.dtype(U))

    @staticmethod
    def _flat(parts: np.ndarray, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(parts), kind), np.concatenate([[0], np.cumsum([len(x) // kind.itemsize for x in parts])])

    @staticmethod
    def _common(flat: tuple[np.ndarray, np.ndarray], i: int, others: np.ndarray) -> np.ndarray:
        """How many of set i's shingles are among those of each other set."""
        values, starts = flat
        sizes = starts[others + 1] - starts[others]
        at = np.repeat(starts[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        own = values[starts[i] : starts[i + 1]]
        if not len(own) or not len(at):
            return np.zeros(len(others), np.int64)
        there = own[np.minimum(np.searchsorted(own, values[at]), len(own) - 1)] == values[at]
        return np.bincount(np.repeat(np.arange(len(others)), sizes), there, minlength=len(others)).astype(np.int64)

    def shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Shingles that set i shares with others of its hub."""
        lack = np.diff(self.lacks[1])
        return self.hub_size[i] - lack[i] - lack[others] + self._common(self.lacks, i, others) + self._common(self.adds, i, others)


def _places(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    return order[np.searchsorted(keys[order], wanted)]


def _crossing(p: Posting, relations: Relations, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, known) of a list: links between classes that the relations to a common hub decide, and pairs without one that may be links.

    Classes that a link joins are one from then on, so a crowd leaves a link for each class and not one for each pair.
    """
    a, b, known = [], [], []
    group = p.group.copy()
    for i in range(len(p.key) - 1):
        found = p.possible(i, num, den)
        found = found[group[found] != group[i]]
        same = relations.hub[found] == relations.hub[i]
        near, other = found[same], found[~same]
        if len(near):
            shared = relations.shared(i, near)
            near = near[den * shared >= num * (p.size[i] + p.size[near] - shared)]
            near = near[np.unique(group[near], return_index=True)[1]]
            if len(near):
                group[np.isin(group, group[near])] = group[i]
                other = other[group[other] != group[i]]
        for rows, sure in ((near, True), (other, False)):
            a.append(np.full(len(rows), p.key[i]))
            b.append(p.key[rows])
            known.append(np.full(len(rows), sure))
    return tuple(np.concatenate(x) for x in (a, b, known))


def _lists(walk: Callable[..., pa.RecordBatch | None], columns: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Calls `walk` with the columns of each list of a table sorted by token; lists of one row are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                held.clear()
                if len(whole[0]) > 1:
                    out = walk(*whole)
                    if out is not None and out.num_rows:
                        yield out

        for b in batches:
            if not b.num_rows:
                continue
            at = [b.schema.get_field_index(c) for c in columns]
            if min(at) < 0:  # pyarrow takes column(-1) for the last one
                raise ValueError(f"no column {columns[at.index(-1)]} in {b.schema.names}")
            data = [b.column(i).to_numpy(zero_copy_only=False) for i in at]
            token = data[0]
            cut = np.flatnonzero(token[1:] != token[:-1]) + 1
            if held and held[0][0][0] != token[0]:
                yield from flush()
            if not len(cut):
                held.append(data)
                continue
            held.append([x[: cut[0]] for x in data])
            yield from flush()
            sizes = np.diff(cut)
            for i in np.flatnonzero(sizes > 1):
                out = walk(*[x[cut[i] : cut[i + 1]] for x in data])
                if out is not None and out.num_rows:
                    yield out
            held.append([x[cut[-1] :] for x in data])
        yield from flush()

    return run


ENTRY = "token long, mark long, size int, at int, low8 long, high8 long"


def _merged(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Small record batches put together."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def digest_of(text: str) -> Column:
    """A number that names a text; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def texts_of(texts: DataFrame, sets: DataFrame, more: list[str]) -> DataFrame:
    """(key, *more, text) of sets (h1, *more, rows, _key, _digest), from rows (key, text, digest); each set once.

    A table of bits, one for the remainder of each digest, leaves out most other texts before the rest are joined.
    """
    n = min(MOST_BITS, 1 << max(15, (BITS * sets.count()).bit_length()))
    place = F.pmod(F.col("_digest"), F.lit(n)) + 1
    parts = sets.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("at")).groupBy("part").agg(F.bitmap_construct_agg("at").alias("bits"))
    table = np.zeros((n >> 15, 1 << 12), np.uint8)
    for r in parts.collect():  # at most MOST_BITS in all
        table[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    bits = sets.sparkSession.sparkContext.broadcast(table.ravel())

    @F.pandas_udf("boolean")
    def asked_for(digest: pd.Series) -> pd.Series:
        at = digest.to_numpy() % n
        return pd.Series(bits.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    named = sets.select("h1", *more, "rows", "_key", "_digest")
    chosen = texts.where(asked_for("digest")).join(named, F.col("key").eqNullSafe(F.col("_key")) & (F.col("digest") == F.col("_digest"))).select(F.col("h1").alias("key"), *more, "text")
    return stored(chosen if sets.where("rows > 1").isEmpty() else chosen.dropDuplicates(["key"]), "texts")


def similar_classes(docs: DataFrame, key: str, text: str, n: int = 5, num: int = 80, den: int = 100, keep_digest: bool = False) -> DataFrame:
    """One row per row of `docs`: key, n_shingles and component_id, the smallest key reachable by links.

    Sets are compared with their hubs on whole texts, which take less room in a shuffle than sets of 64-bit names do, and with each other by
    their differences from the hub.
    Two texts link if den * (shared shingles) >= num * (shingles of either). Null and empty texts have no shingles and link with
    nothing; a text of fewer than n words is one shingle. What is joined are distinct sets, each named by a 64-bit sum over its shingles: a key that
    several rows have, or none, links no texts. A component is null if no row that it reaches has a key. With
    keep_digest, _digest names each row's text and _class its class, which may have the same smallest key as others (null without shingles).
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), digest_of(text).alias("digest"))
    own, totals = survey(texts, n)
    counts = docs.sparkSession.sparkContext.broadcast(np.minimum(totals, (1 << 31) - 1).astype(np.int32))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, value, starts in shingle_sets(b.column(0), n):
                mark, _ = _marks(value, starts)
                low8, high8 = histograms(value, starts)
                size = np.diff(starts)
                of = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((value, counts.value[(value % U(COUNTERS)).astype(np.int64)], of))
                at = np.arange(len(value)) - starts[:-1][of]
                first = at < (size - -(-(num * size) // den) + 1)[of]
                o, of, at = order[first], of[first], at[first]
                yield pa.RecordBatch.from_arrays([pa.array(value[o].view(np.int64)), pa.array(mark[of]), pa.array(size[of].astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(low8[of]), pa.array(high8[of])], names)

    names = ["token", "mark", "size", "at", "low8", "high8"]
    posted = texts.select("text").mapInArrow(post, ENTRY)

    def partners(token, mark, size, at, low8, high8) -> pa.RecordBatch | None:
        p = Posting(at, size, mark, mark, low8, high8)
        m = len(p.key)
        if m < 2:
            return None
        # each set's partner is the smallest key that it may be similar to: mostly the same one in all lists
        hub, met = p.key.copy(), np.zeros(m, bool)
        for i in range(m - 1):
            found = p.possible(i, num, den)
            if len(found):
                hub[found] = np.minimum(hub[found], p.key[i])
                hub[i] = min(hub[i], p.key[found].min())
                met[found] = met[i] = True
        ok = np.flatnonzero(met)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(ok), token[0])), pa.array(p.key[ok]), pa.array(p.size[ok].astype(np.int32)), pa.array(p.at[ok].astype(np.int32)), pa.array(hub[ok]), pa.array(p.low8[ok]), pa.array(p.high8[ok])], ["token", "key", "size", "at", "hub", "low8", "high8"])

    lists = posted.repartition("token").sortWithinPartitions("token")
    near = stored(lists.mapInArrow(lambda it: _merged(_lists(partners, names)(it)), "token long, key long, size int, at int, hub long, low8 long, high8 long"), "postings")

    # each set's hub is the smallest key that it may be similar to in any list
    hubs = stored(near.groupBy("key").agg(F.min("hub").alias("hub")), "hubs")
    # one row's text stands for each set that may have partners
    row = F.struct("rows", F.col("key").isNull().alias("none"), "key", "digest", "size", "sketch")
    found = own.join(hubs.select(F.col("key").alias("h1"), "hub"), "h1").groupBy("h1", "hub", "key", "digest", "size", "sketch").agg(F.count("*").alias("rows"))
    picked = found.groupBy("h1", "hub").agg(F.min(row).alias("row"))
    reps = stored(picked.select("h1", "hub", "row.rows", F.col("row.key").alias("_key"), F.col("row.digest").alias("_digest"), "row.size", "row.sketch"), "rows")

    def by_sketches(pairs: DataFrame, a: str, b: str, name: str, near: bool) -> DataFrame:
        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.select([0, 1]).filter(pa.array(may_link(batch, num, den, near)))

        one, two = reps.select(F.col("h1").alias(a), "size", "sketch"), reps.select(F.col("h1").alias(b), F.col("size").alias("other_size"), F.col("sketch").alias("other_sketch"))
        return stored(pairs.join(one, a).join(two, b).select(a, b, "size", "sketch", "other_size", "other_sketch").mapInArrow(likely, f"{a} long, {b} long"), name)

    # a set that its hub tells nothing about is a hub of its own; near ones stay, also if they are no links
    led = by_sketches(hubs.where("key != hub"), "key", "hub", "led", True)
    leads = led.select(F.col("hub").alias("_hub")).distinct()
    compared = reps.drop("hub").join(led.withColumnRenamed("key", "h1"), "h1", "left").join(leads, F.col("h1") == F.col("_hub"), "left")
    needed = texts_of(texts, compared.withColumn("leads", F.col("_hub").isNotNull()).where("leads or hub is not null"), ["hub", "leads"])

    def against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield _relations(b, n, num, den)

    # a set's text goes to its hub's, and of the hubs' texts each goes once
    leaders = needed.where("leads").select(F.col("key").alias("hub"), F.col("text").alias("other"))
    both = needed.where("hub is not null").select("key", "hub", "text").join(leaders, "hub").select("key", "hub", "text", "other")
    relations = stored(both.mapInArrow(against_hub, "key long, hub long, linked boolean, hub_size int, lacks binary, adds binary"), "relations")
    first = relations.where("linked").select(F.col("key").alias("a"), F.col("hub").alias("b"))
    groups = components(first, "a", "b")

    def across(token, keys, size, at, low8, high8, group, hub, hub_size, lacks, adds) -> pa.RecordBatch | None:
        p = Posting(at, size, keys, keys, low8, high8, group)
        if len(p.key) < 2 or (p.group == p.group[0]).all():
            return None
        order = _places(keys, p.key)
        out = _crossing(p, Relations(hub[order], hub_size[order], lacks[order], adds[order]), num, den)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["a", "b", "known"])

    own_relation = relations.where("lacks is not null").select("key", "hub", "hub_size", "lacks", "adds")
    # a hub is its own: nothing lacks and nothing is added
    grouped = stored(near.select("token", "key", "size", "at", "low8", "high8").join(groups, F.col("key") == F.col("node"), "left").withColumn("group", F.coalesce("component", "key")).drop("node", "component"), "grouped")
    # only lists of several classes go on
    mixed = grouped.groupBy("token").agg(F.min("group").alias("_low"), F.max("group").alias("_high")).where("_low < _high").select("token")
    classed = grouped.join(mixed, "token", "left_semi").join(own_relation, "key", "left").select(
        "token", "key", "size", "at", "low8", "high8", "group", F.coalesce("hub", "key").alias("hub"),
        F.coalesce("hub_size", "size").alias("hub_size"), F.coalesce("lacks", F.lit(b"")).alias("lacks"), F.coalesce("adds", F.lit(b"")).alias("adds"),
    )
    columns = ["token", "key", "size", "at", "low8", "high8", "group", "hub", "hub_size", "lacks", "adds"]
    crossing = stored(classed.repartition("token").sortWithinPartitions("token").mapInArrow(lambda it: _merged(_lists(across, columns)(it)), "a long, b long, known boolean"), "crossing")
    second = crossing.where("known").select("a", "b").distinct()
    groups2 = components(first.unionByName(second), "a", "b")
    # pairs of sets with different hubs, and by now of different classes, are decided on their texts
    decided = relations.select(F.col("hub").alias("a"), F.col("key").alias("b"))
    asked = crossing.where("not known").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(decided, ["a", "b"], "left_anti")
    left, right = (groups2.select(F.col("node").alias(c), F.col("component").alias(f"class_{c}")) for c in "ab")
    apart = asked.join(left, "a", "left").join(right, "b", "left").where(F.coalesce("class_a", "a") != F.coalesce("class_b", "b")).select("a", "b")

    apart = by_sketches(apart, "a", "b", "apart", False)
    wanted = apart.select(F.col("a").alias("_set")).unionByName(apart.select(F.col("b").alias("_set"))).distinct()
    others = texts_of(texts, reps.join(wanted, F.col("h1") == F.col("_set"), "left_semi"), [])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ok = pa.array(similar_rows(batch.column(2), batch.column(3), n, num, den))
                yield batch.select([0, 1]).filter(ok)

    one = apart.join(others, F.col("a") == F.col("key")).select("a", "b", "text")
    pairs = one.join(others.select("key", F.col("text").alias("other")), F.col("b") == F.col("key")).select("a", "b", "text", "other")
    third = stored(pairs.mapInArrow(verified, "a long, b long"), "links")
    all_groups = components(first.unionByName(second).unionByName(third), "a", "b")

    # classes of sets, and only now the keys of their rows
    sets = own.where("size > 0").groupBy("h1", "h2").agg(F.min("key").alias("rep"))
    classed_sets = sets.join(all_groups, F.col("h1") == F.col("node"), "left").select("h1", "h2", "rep", F.coalesce("component", "h1").alias("class"))
    smallest = classed_sets.groupBy("class").agg(F.min("rep").alias("component_id"))
    joined = own.join(classed_sets.join(smallest, "class").select("h1", "h2", "class", "component_id"), ["h1", "h2"], "left")
    more = [F.col("digest").alias("_digest"), F.col("class").alias("_class")] if keep_digest else []
    return joined.select(F.col("key").alias(key), F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"), *more)


def keep_one(docs: DataFrame, classes: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of `docs` that stand for their class, from similar_classes with keep_digest: of each class, one row of its smallest key.

    A row goes only if its own text is in the class of a row that stays. So rows of one key whose texts are not
    similar all stay. In classes in which no row has a key all rows stay; of equal ones, one.
    """
    apart = F.when(F.col(key).isNull(), F.col("_digest"))
    own = classes.where(F.col(key).eqNullSafe(F.col("component_id"))).groupBy(F.col(key).alias("_key"), "_class", apart.alias("_apart"), "_digest").agg(F.count("*").alias("_rows"))
    one = own.groupBy("_key", "_class", "_apart").agg(F.min(F.struct("_digest", "_rows")).alias("_one"))
    chosen = one.select("_key", F.col("_one._digest").alias("_digest"), F.col("_one._rows").alias("_rows"))
    own_key, own_digest = free_name(docs, "_key"), free_name(docs, "_digest")  # names that the table does not have

    def here(some: DataFrame) -> DataFrame:
        named = some.select(F.col("_key").alias(own_key), F.col("_digest").alias(own_digest))
        return docs.join(named, F.col(key).eqNullSafe(F.col(own_key)) & (digest_of(text) == F.col(own_digest)), "left_semi")

    once, again = here(chosen.where("_rows = 1")), chosen.where("_rows > 1")
    keyed, unkeyed = here(again.where("_key is not null")), here(again.where("_key is null"))
    return once.unionByName(keyed.withColumn(own_digest, digest_of(text)).dropDuplicates([key, own_digest]).drop(own_digest)).unionByName(unkeyed.dropDuplicates())
