"""Token-id shards: raw payloads with a perfect-hash index for keyed access.

A shard is one file: a header of section sizes, the perfect hash, then per place the key's fingerprint, its first row and
number of rows, then per row the key, a null mark and the offset of its ids, and last the ids, 16 bits wide where the vocabulary
allows it and 32 else. Rows ascend by key within a shard and from shard to shard, null keys first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusgauge.llm.bpe import encoder, whole_text_ids
from corpusgauge.llm.mph import PerfectHash, fingerprints
from corpusgauge.llm.shared import one_by_one, place, small_batches, write_whole

MAGIC = b"IDSHARD1"
#: What stands for a null key in the index; it has a mark of its own beside each row.
NULL_KEY = -(1 << 63)
#: Rows and ids that are read at once; a row with more ids is read alone.
BLOCK_ROWS, BLOCK_IDS = 2000, 1 << 20
MANIFEST = "shard int, file string, n_rows long, n_ids long, first_key long, last_key long"
ROWS = "key long, start long, n_tokens long, ids binary, shard int"


def write_shards(df: DataFrame, key: str, text: str, path: str, folder: str, end_id: int = 2) -> DataFrame:
    """Encodes every whole text, appends `end_id`, and writes shards in ascending key order; returns the manifest.

    `key` is a 64-bit number; null and repeated keys are kept, null and empty texts are `end_id` alone. Each task streams its
    rows to one file, written under another name and moved, so that a repeated attempt leaves the same file. The manifest
    is a Parquet table in the folder, one row per shard, in one file: a file of its own for each row would cost every task
    several processes where Hadoop sets a local file's mode by a command.
    """
    small_batches(df.sparkSession)
    table = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    ordered = table.repartitionByRange(F.col("key").asc_nulls_first()).sortWithinPartitions(F.col("key").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        kind = "<u2" if encoder(path).size <= 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        keys: list = []
        sizes: list[int] = []
        held: list[bytes] = []
        for b in batches:
            keys += b.column(0).to_pylist()
            for ids in whole_text_ids(path, (x.as_py() for x in b.column(1))):
                raw = np.frombuffer(ids, "<u4").astype(kind).tobytes() + end
                held.append(raw)
                sizes.append(len(raw) // np.dtype(kind).itemsize)
        if not keys:
            return
        name = f"shard-{shard:06d}.ids"
        write_whole(f"{folder}/{name}", _file(keys, sizes, held, kind))
        real = [k for k in keys if k is not None]
        yield pa.RecordBatch.from_pydict(
            {"shard": [shard], "file": [name], "n_rows": [len(keys)], "n_ids": [sum(sizes)], "first_key": [min(real, default=None)], "last_key": [max(real, default=None)]},
            pa.schema([("shard", pa.int32()), ("file", pa.string()), ("n_rows", pa.int64()), ("n_ids", pa.int64()), ("first_key", pa.int64()), ("last_key", pa.int64())]),
        )

    ordered.mapInArrow(write, MANIFEST).repartition(1).write.parquet(f"{folder}/manifest")
    return read_manifest(df.sparkSession, folder)


def _file(keys: list, sizes: list[int], held: list[bytes], kind: str) -> Iterator[bytes]:
    null = np.array([k is None for k in keys], np.uint8)
    row_keys = np.array([NULL_KEY if k is None else k for k in keys], "<i8")
    first = np.flatnonzero(np.concatenate([[True], (row_keys[1:] != row_keys[:-1]) | (null[1:] != null[:-1])]))
    first = first[null[first] == 0]
    distinct = row_keys[first]
    many = np.diff(np.concatenate([first, [len(keys)]])) if len(first) else np.zeros(0, np.int64)
    index = PerfectHash.build(distinct)
    at = index.places(distinct)
    marks, rows, counts = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<i8"), np.zeros(len(distinct), "<i8")
    marks[at], rows[at], counts[at] = fingerprints(distinct), first, many
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    sections = [index.to_bytes(), marks.tobytes(), rows.tobytes(), counts.tobytes(), row_keys.tobytes(), null.tobytes(), offsets.tobytes()]
    head = np.array([np.dtype(kind).itemsize, len(keys), len(distinct), *[len(s) for s in sections]], "<i8").tobytes()
    yield MAGIC + head
    yield from sections
    yield from held


class Shard:
    """An opened shard: the index is read at once, ids only where they are asked for."""

    def __init__(self, uri: str):
        fs, path = place(uri)
        self.file = fs.open_input_file(path)
        if self.file.read(8) != MAGIC:
            raise ValueError(f"{uri} is no shard")
        head = np.frombuffer(self.file.read(80), "<i8")
        self.width, self.n_rows, self.n_keys = (int(x) for x in head[:3])
        raw = [self.file.read(int(n)) for n in head[3:]]
        self.index = PerfectHash.from_bytes(raw[0])
        self.marks, self.first, self.many = np.frombuffer(raw[1], "<u4"), np.frombuffer(raw[2], "<i8"), np.frombuffer(raw[3], "<i8")
        self.keys, self.null, self.offsets = np.frombuffer(raw[4], "<i8"), np.frombuffer(raw[5], np.uint8), np.frombuffer(raw[6], "<i8")
        self.payload = 88 + int(head[3:].sum())

    def blocks(self) -> Iterator[tuple[int, int]]:
        """First and end of rows to be read at once, all rows in order."""
        a = 0
        while a < self.n_rows:
            most = int(np.searchsorted(self.offsets, self.offsets[a] + BLOCK_IDS, "right")) - 1
            b = min(max(a + 1, most), a + BLOCK_ROWS, self.n_rows)
            yield a, b
            a = b

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First row and number of rows of each key, in constant time; number 0 where a fingerprint or the key differs."""
        if not self.n_keys:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        at = self.index.places(keys)
        ok = (at >= 0) & (self.marks[at] == fingerprints(keys))
        row = np.where(ok, self.first[at], 0)
        ok &= (self.keys[row] == keys) & (self.null[row] == 0)
        return row, np.where(ok, self.many[at], 0)

    def ids(self, row: int) -> np.ndarray:
        """Ids of a row, read from its place in the file."""
        a, b = int(self.offsets[row]), int(self.offsets[row + 1])
        self.file.seek(self.payload + a * self.width)
        return np.frombuffer(self.file.read((b - a) * self.width), f"<u{self.width}").astype("<u4")

    def __enter__(self) -> Shard:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The shards of a folder with the number of ids before each; one row per shard, so one window over all is small."""
    table = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return table.withColumn("ids_before", F.coalesce(before, F.lit(0)))


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of every shard, one task per shard, each key found through the index: key, start (ids before it in all shards), n_tokens, ids."""
    listed = read_manifest(spark, folder).select("shard", "file", "ids_before")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard, name, before in batch.itertuples(index=False):
                with Shard(f"{folder}/{name}") as s:
                    for a, b in s.blocks():
                        rows = np.arange(a, b)
                        null = s.null[rows] == 1
                        first, many = s.rows_of(s.keys[rows])
                        if not np.all(null | ((first <= rows) & (rows < first + many))):
                            raise ValueError(f"index of {name} does not match its rows")
                        yield pd.DataFrame({
                            "key": pd.array(np.where(null, None, s.keys[rows]), dtype="Int64"), "start": before + s.offsets[rows],
                            "n_tokens": s.offsets[rows + 1] - s.offsets[rows], "ids": [s.ids(r).tobytes() for r in rows], "shard": np.int32(shard),
                        })

    return one_by_one(listed, "shard").mapInPandas(read, ROWS)


def lookup(keys: DataFrame, key: str, folder: str) -> DataFrame:
    """Rows of the asked keys (64-bit numbers; null finds nothing): a range join with the manifest, then one index probe per key."""
    spark = keys.sparkSession
    wanted = keys.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()
    listed = read_manifest(spark, folder)
    routed = wanted.join(F.broadcast(listed.where("first_key is not null")), F.col("key").between(F.col("first_key"), F.col("last_key"))).select("key", "shard", "file", "ids_before")

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (shard, name, before), group in batch.groupby(["shard", "file", "ids_before"]):
                out = []
                with Shard(f"{folder}/{name}") as s:
                    for k, row, n in zip(group["key"], *s.rows_of(group["key"].to_numpy(np.int64)), strict=True):
                        out += [(k, before + int(s.offsets[r]), int(s.offsets[r + 1] - s.offsets[r]), s.ids(r).tobytes(), shard) for r in range(row, row + n)]
                yield pd.DataFrame(out, columns=["key", "start", "n_tokens", "ids", "shard"])

    return routed.mapInPandas(probe, ROWS)
