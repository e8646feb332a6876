"""Folders all machines see, tables written in between, and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows that goes to a Python worker.
BATCH_BYTES, BATCH_SETTING = "4m", "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """From now on texts go to Python workers in small batches, unless the session has a limit of its own.

    10,000 whole texts at once, Spark's usual batch, are held several times over: in the JVM's buffers, which it keeps for the
    next stages, and in each worker.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="corpusgauge-llm-")
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def new_folder(spark: SparkSession, name: str) -> str:
    """A path for one table or archive below the shared folder; nothing is there yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: it is computed once, and no executor's loss undoes it."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def one_by_one(files: DataFrame, column: str) -> DataFrame:
    """A table of files dealt so that each is a task's own; counted first, as Spark would merge tasks that read so few bytes."""
    return files.repartitionByRange(max(1, files.count()), column)


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system and path of a folder or file, in any store that pyarrow knows by its scheme."""
    import pyarrow.fs

    if not urlparse(uri).scheme:
        uri = f"file://{uri}"
    return pyarrow.fs.FileSystem.from_uri(uri)


def write_whole(uri: str, data: Iterator[bytes]) -> int:
    """Write a file under another name, then move it: readers and repeated attempts never meet half a file."""
    fs, path = place(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part, size = f"{path}.{uuid.uuid4().hex}.part", 0
    with fs.open_output_stream(part) as out:
        for piece in data:
            out.write(piece)
            size += len(piece)
    fs.move(part, path)
    return size


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have yet, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
