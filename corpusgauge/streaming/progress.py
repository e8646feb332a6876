"""Incremental ledger: an append log folded into the latest record per key, bucket by bucket.

A ledger is a folder of versions, one per micro-batch: `buckets=<n>/v=<batch>/bucket=<b>`. A version holds the buckets that
its batch touched, whole; a bucket's newest finished version counts. So a batch rewrites what it touches and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusgauge.operators.ledger import KEY, latest_records

#: Buckets of a new ledger: one is a task's work in a batch, so some hundred megabytes each are right.
BUCKETS = 64
#: Newest versions of a bucket that stay: what counts, and one more for those who read while a batch is written.
KEPT_VERSIONS = 2


def _folder(spark: SparkSession, path: str):
    """The file system of a path, whatever it is, and a function that makes its paths."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _named(fs, folder, name: str) -> list[int]:
    """Numbers n of the folders <name>=n below a path."""
    if not fs.exists(folder):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(x.partition("=")[2]) for x in found if x.startswith(f"{name}="))


def bucket_count(spark: SparkSession, path: str) -> int | None:
    """How many buckets a ledger has; None if there is none yet."""
    fs, of = _folder(spark, path)
    known = _named(fs, of(path), "buckets")
    if len(known) > 1:
        raise ValueError(f"{path} holds ledgers of {known} buckets")
    return known[0] if known else None


def bucket_versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[int]]:
    """Finished versions (below a number, if given) of each bucket, oldest first."""
    n = bucket_count(spark, path)
    fs, of = _folder(spark, path)
    out: dict[int, list[int]] = {}
    for v in _named(fs, of(f"{path}/buckets={n}"), "v") if n else []:
        if (before is None or v < before) and fs.exists(of(f"{path}/buckets={n}/v={v}/_SUCCESS")):
            for b in _named(fs, of(f"{path}/buckets={n}/v={v}"), "bucket"):
                out.setdefault(b, []).append(v)
    return out


def _read(spark: SparkSession, path: str, newest: dict[int, int], schema=None) -> DataFrame | None:
    n = bucket_count(spark, path)
    places = [f"{path}/buckets={n}/v={v}/bucket={b}" for b, v in sorted(newest.items())]
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*places) if places else None


def read_ledger(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The latest record of every key (as of a batch number, if given), or None."""
    return _read(spark, path, {b: vs[-1] for b, vs in bucket_versions(spark, path, before).items()})


def fold_batch(batch: DataFrame, batch_id: int, path: str, key: Sequence[str] = KEY, seq: str = "seq", buckets: int = BUCKETS) -> None:
    """Write the buckets that a batch touches: their records and the batch's, last record per key.

    Running a batch again after a failure reads the same older versions and overwrites its own. Versions that newer
    finished ones have replaced go before the batch is written, all but the last KEPT_VERSIONS of each bucket.
    """
    spark = batch.sparkSession
    known = bucket_count(spark, path)
    if known not in (None, buckets):
        raise ValueError(f"{path} has {known} buckets, not {buckets}")
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int").alias("bucket")
    rows = batch.select("*", bucket).persist()
    try:
        touched = {r[0] for r in rows.select("bucket").distinct().collect()}
        if not touched:
            return
        versions = bucket_versions(spark, path, batch_id)
        fs, of = _folder(spark, path)
        for b, vs in versions.items():
            for v in vs[:-KEPT_VERSIONS]:
                fs.delete(of(f"{path}/buckets={buckets}/v={v}/bucket={b}"), True)
        old = _read(spark, path, {b: versions[b][-1] for b in touched & set(versions)}, batch.schema)
        both = rows if old is None else rows.unionByName(old.select("*", bucket))
        last = latest_records(both, ["bucket", *key], seq).repartition("bucket")
        last.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/buckets={buckets}/v={batch_id}")
    finally:
        rows.unpersist()


def stream_progress(
    log: DataFrame, path: str, checkpoint: str, key: Sequence[str] = KEY, seq: str = "seq", buckets: int = BUCKETS
) -> StreamingQuery:
    """Fold a streaming log into the ledger at `path`, one version of the touched buckets per micro-batch."""

    def fold(batch: DataFrame, batch_id: int) -> None:
        fold_batch(batch, batch_id, path, key, seq, buckets)

    writer = log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
