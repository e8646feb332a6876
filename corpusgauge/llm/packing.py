"""Packing of token sequences: bounded-space best fit with a bitset of free space."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusgauge.llm.bpe import whole_text_ids
from corpusgauge.llm.shared import stored

#: Bins that a task holds open at once.
OPEN_BINS = 1024
#: Sequences emptier than this share when a task ends are packed again, together with those of other tasks.
FULL_SHARE = 0.985
#: Pieces of one task of the second round, at most about.
SECOND_PIECES = 20_000


class BestFit:
    """A fixed number of open bins; the one with the least sufficient space takes a piece, the fullest closes first.

    Bit f of `free` is set if an open bin has f places left, and `bins[f]` lists those bins, so the best bin is the
    lowest set bit from the piece's length on.
    """

    def __init__(self, size: int, open_bins: int):
        self.size, self.most, self.free, self.n = size, open_bins, 0, 0
        self.bins: dict[int, list[list]] = {}

    def _take(self, f: int) -> list:
        group = self.bins[f]
        taken = group.pop()
        if not group:
            self.free &= ~(1 << f)
        self.n -= 1
        return taken

    def add(self, piece, length: int) -> list | None:
        """Places a piece; returns the bin that closes by it, if one does."""
        fits = self.free >> length
        closed = None
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            content = self._take(f)
        else:
            if self.n >= self.most:
                closed = self._take((self.free & -self.free).bit_length() - 1)
            f, content = self.size, []
        content.append(piece)
        if f == length:
            if closed is None:
                return content
            self.full.append(content)
            return closed
        self.bins.setdefault(f - length, []).append(content)
        self.free |= 1 << (f - length)
        self.n += 1
        return closed

    #: Bins that became full while another one had to close.
    @property
    def full(self) -> list[list]:
        return self.__dict__.setdefault("_full", [])

    def rest(self) -> Iterator[tuple[int, list]]:
        """What is still open, with its free space."""
        for f, group in self.bins.items():
            for content in group:
                yield f, content


def pack(pieces: Iterable[tuple[object, int]], size: int, open_bins: int = OPEN_BINS) -> Iterator[tuple[int, list]]:
    """(free space, pieces) of each bin, closed ones first; free space -1: closed while others were open."""
    fit = BestFit(size, open_bins)
    for piece, length in pieces:
        if length >= size:
            yield 0, [piece]
            continue
        closed = fit.add(piece, length)
        if closed is not None:
            yield -1, closed
        while fit.full:
            yield -1, fit.full.pop()
    yield from fit.rest()


_PLACED = T.StructType([
    T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
    T.StructField("ids", T.BinaryType()), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
])


def _rows(bins: Iterable[tuple[int, list, bool]], schema: pa.Schema, first_id: int) -> Iterator[pa.RecordBatch]:
    """Record batches of placed pieces; a piece is (keys, number, start, ids bytes)."""
    n, out, held = first_id, [[] for _ in schema], 0
    for _, content, placed in bins:
        at = 0
        for keys, number, start, ids in content:
            length = len(ids) // 4
            row = (*keys, number, start, length, ids, n if placed else None, at if placed else None)
            for column, value in zip(out, row, strict=True):
                column.append(value)
            at += length
            held += len(ids)
        n += placed
        if held > 8_000_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            out, held = [[] for _ in schema], 0
    if out[0]:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)


def pack_documents(df: DataFrame, key: str, text: str, path: str, size: int = 1024, end_id: int = 2, open_bins: int = OPEN_BINS) -> DataFrame:
    """Packs all texts into sequences of at most `size` ids; one row per piece.

    Each text becomes its ids and `end_id`; null and empty texts are `end_id` alone. Texts longer than `size` are cut into
    full pieces after a shorter first one. Returns the key column, piece, start (ids before it), length, ids (binary),
    sequence_id and offset. Every task packs what it reads, without a shuffle; sequences that are still open and not
    nearly full at its end go through a second round with those of other tasks. An empty table gives no rows; repeated
    and null keys are packed like others.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    table = df.select(F.col(key), F.col(text))
    fields = T.StructType([T.StructField(key, table.schema[0].dataType), *_PLACED.fields])
    arrow = to_arrow_schema(fields)

    def cut(keys: Iterable, texts: Iterable[str | None]) -> Iterator[tuple[tuple, int]]:
        end = np.array([end_id], "<u4").tobytes()
        for k, ids in zip(keys, whole_text_ids(path, texts), strict=True):
            ids += end
            n = len(ids) // 4
            first = n % size or size
            for number, start in enumerate([0, *range(first, n, size)]):
                stop = first if not number else start + size
                yield ((k,), number, start, ids[4 * start : 4 * stop]), stop - start

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        pieces = (p for b in batches for p in cut(b.column(0).to_pylist(), b.column(1).to_pylist()))
        bins = ((f, c, f <= size * (1 - FULL_SHARE)) for f, c in pack(pieces, size, open_bins))
        yield from _rows(bins, arrow, part << 33)

    placed = stored(table.mapInArrow(first_round, fields), "packed")
    open_pieces = placed.where(F.col("sequence_id").isNull())
    parts = max(1, -(-open_pieces.count() // SECOND_PIECES))

    def second_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()

        def again() -> Iterator[tuple[tuple, int]]:
            for b in batches:
                for k, number, start, length, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                    yield ((k,), number, start, ids), length

        bins = ((f, c, True) for f, c in pack(again(), size, 1 << 20))
        yield from _rows(bins, arrow, (1 << 62) | (part << 33))

    # pieces of one key would meet in one task, so they are dealt by their order instead
    packed_again = open_pieces.repartition(parts).mapInArrow(second_round, fields)
    return placed.where(F.col("sequence_id").isNotNull()).unionByName(packed_again)
