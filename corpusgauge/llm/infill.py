"""Fill-in-the-middle: lines of a text in the order prefix, suffix, middle or suffix, prefix, middle, assembled by a secondary sort.

A text is cut into lines, two draws from its key cut the lines into three parts, and each part leaves as pieces of bounded
size that carry their place in the output. One shuffle by text, sorted by place inside the partitions, brings the pieces
together; they stream through a digest or into files, and no task holds a whole text after the cut. To restore, the marks are found
in that stream alone, its pieces get their places in the text, are sorted once more where they are, and stream through a digest again.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type
from pyspark.sql.types import DataType

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The marks of each form in output order, and the place in the text of the part that follows each.
FORMS = {"plain": (), "psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1))}
#: Bytes of a piece, and of the pieces that leave a task together.
PIECE_BYTES, BATCH_BYTES = 1 << 18, 1 << 22

_UNIT = re.compile(rb"[^\n]*\n|[^\n]+")


def _schema(names: str, key: DataType) -> pa.Schema:
    """The columns of a stream; those not listed are 64-bit numbers."""
    kinds = {"id": pa.binary(), "key": to_arrow_type(key), "form": pa.string(), "output_sha256": pa.string(), "restored_sha256": pa.string(), "data": pa.binary()}
    return pa.schema([(name, kinds.get(name, pa.int64())) for name in names.split()])


def draws(seed: int, key: object) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits for a key (a null key: the empty text)."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(h[i : i + 4], "big") for i in range(0, 16, 4))


def cut(text: bytes, key: object, seed: int, rate: int, spm: int) -> tuple[int, str, int, int]:
    """(units, form, end of the prefix, end of the middle) of a text, ends in bytes."""
    n = text.count(b"\n") + (not text.endswith(b"\n") and text != b"")
    h1, h2, h3, h4 = draws(seed, key)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= rate:
        return n, "plain", 0, 0
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a = z = 0
    for i, unit in enumerate(_UNIT.finditer(text)):
        if i == high:
            break
        a, z = unit.end() if i < low else a, unit.end()
    return n, "spm" if h4 % 100 < spm else "psm", a, z


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows as batches of a few megabytes; the last column is the large one."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _sliced(parts: list[tuple[bytes, bytes]]) -> Iterator[bytes]:
    """The output in pieces; a mark leads the first piece of its part."""
    for mark, part in parts:
        first = max(0, PIECE_BYTES - len(mark))
        yield mark + part[:first]
        for a in range(first, len(part), PIECE_BYTES):
            yield part[a : a + PIECE_BYTES]


def pieces(docs: DataFrame, key: str, text: str, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """The transformed texts as pieces (id, place, key, n_units, form, prefix_chars, middle_chars, data), gathered by text and sorted by place.

    A text is plain if it is empty, holds a mark or its third draw is `rate` percent or more; otherwise spm for fourth draws below
    `spm` percent, else psm. The columns between place and data stand in a text's first piece only. id names a row:
    its content, the partition it was read from, and a number among equal rows there, so a task that runs again gives the same
    ids whatever the order of its rows, and many equal rows spread over all partitions.

    A null text counts as empty, a null key as the empty text in the draws; equal rows and repeated keys stand for
    themselves; an empty table gives no piece; other columns are not looked at, whatever their names.
    """
    schema = _schema("id place key n_units form prefix_chars middle_chars data", docs.schema[key].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        task, copies = TaskContext.get().partitionId().to_bytes(4, "big"), Counter()
        for b in batches:
            for key_, text_ in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                whole = text_.as_buffer().to_pybytes() if text_.is_valid else b""
                same = hashlib.blake2b(f"{key_!r}:".encode() + whole, digest_size=16).digest()
                id_ = same + task + copies[same].to_bytes(4, "big")
                copies[same] += 1
                n, form, a, z = cut(whole, key_, seed, rate, spm)
                ends = {0: whole[:a], 1: whole[a:z], 2: whole[z:]}
                chars = (None, None) if form == "plain" else (len(ends[0].decode()), len(ends[1].decode()))
                parts = [(mark, ends[k]) for mark, k in FORMS[form]] or [(b"", whole)]
                for place, data in enumerate(_sliced(parts)):
                    yield (id_, place, *((None,) * 5 if place else (key_, n, form, *chars)), data)

    keyed = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    out = keyed.mapInArrow(lambda batches: _batches(rows(batches), schema), from_arrow_schema(schema))
    return out.repartition("id").sortWithinPartitions("id", "place")


class _Back:
    """Finds the marks in a stream of output and gives what lies between them its place in the text."""

    def __init__(self, form: str):
        self.left, self.rank, self.count, self.tail = list(FORMS[form]), 0, 0, b""

    def feed(self, data: bytes, last: bool = False) -> Iterator[tuple[int, bytes]]:
        data = self.tail + data
        while self.left:
            mark, rank = self.left[0]
            at = data.find(mark)
            if at < 0:
                break
            yield from self._out(data[:at])
            data, self.rank = data[at + len(mark) :], rank
            self.left.pop(0)
        keep = 0 if last or not self.left else min(len(data), 2)  # a mark may go on in the next piece
        self.tail = data[len(data) - keep :]
        yield from self._out(data[: len(data) - keep])

    def _out(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if data:
            yield (self.rank << 48) + self.count, data
            self.count += 1


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """Rows sorted by id, and whether each is the first of its id."""
    last = None
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            yield row[0] != last, row
            last = row[0]


def digests(pieces: DataFrame) -> DataFrame:
    """Per text: key, n_units, form, prefix_chars, middle_chars and the lower-case hex SHA-256 of the output and of the text restored from output and form.

    The pieces have to lie as pieces() leaves them. They stream through; the only further work is a sort inside the partitions.
    """
    key = pieces.schema["key"].dataType
    placed = _schema("id place key n_units form prefix_chars middle_chars output_sha256 data", key)
    checked = _schema("key n_units form prefix_chars middle_chars output_sha256 restored_sha256", key)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first = digest = back = None

        def end() -> Iterator[tuple]:
            yield from ((first[0], place, *(None,) * 6, data) for place, data in back.feed(b"", last=True))
            yield (first[0], -1, *first[2:7], digest.hexdigest(), None)

        for new, row in _streams(batches):
            if new:
                if first:
                    yield from end()
                first, digest, back = row, hashlib.sha256(), _Back(row[4])
            digest.update(row[7])
            yield from ((row[0], place, *(None,) * 6, data) for place, data in back.feed(row[7]))
        if first:
            yield from end()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first = digest = None
        for new, row in _streams(batches):
            if new:
                if first:
                    yield (*first[2:8], digest.hexdigest())
                first, digest = row, hashlib.sha256()
            else:
                digest.update(row[8])
        if first:
            yield (*first[2:8], digest.hexdigest())

    back = pieces.mapInArrow(lambda batches: _batches(read(batches), placed), from_arrow_schema(placed)).sortWithinPartitions("id", "place")
    return back.mapInArrow(lambda batches: _batches(check(batches), checked), from_arrow_schema(checked))


def texts(pieces: DataFrame) -> DataFrame:
    """Per text: key, form and its whole output, for texts that fit a row."""
    schema = _schema("key form data", pieces.schema["key"].dataType)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        first, held = None, []
        for new, row in _streams(batches):
            if new:
                if first:
                    yield (first[2], first[4], b"".join(held))
                first, held = row, []
            held.append(row[7])
        if first:
            yield (first[2], first[4], b"".join(held))

    out = pieces.mapInArrow(lambda batches: _batches(join(batches), schema), from_arrow_schema(schema))
    return out.select("key", "form", F.col("data").cast("string").alias("output"))
