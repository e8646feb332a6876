"""The preparation ledger: what is done, what is left, how it went."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("dataset", "rel_path")
STATUSES = ("ok", "no_face", "read_error", "duplicate_dropped")


def latest_records(log: DataFrame, key: Sequence[str] = KEY, seq: str = "seq") -> DataFrame:
    """Last record per key of an append log. Partial aggregation: a hot key folds before the shuffle."""
    rest = [c for c in log.columns if c not in (*key, seq)]
    last = log.groupBy(*key).agg(F.max(F.struct(seq, *rest)).alias("_last"))
    return last.select(*key, f"_last.{seq}", *[f"_last.{c}" for c in rest])


def exclude_dropped(manifest: DataFrame, drops: DataFrame) -> DataFrame:
    """Manifest rows that no drop row names."""
    return manifest.join(drops.select(*KEY), list(KEY), "left_anti")


def mark_dropped(manifest: DataFrame, drops: DataFrame) -> DataFrame:
    listed = drops.select(*KEY).distinct().withColumn("is_dropped", F.lit(True))
    return manifest.join(listed, list(KEY), "left").na.fill({"is_dropped": False})


def resume_todo(manifest: DataFrame, ledger: DataFrame, existing: DataFrame, drops: DataFrame) -> DataFrame:
    """Rows a resumed run still has to handle, each with its `action`.

    Done means the ledger has a record, and for `ok` records the output is still among `existing`
    (processed_rel_path). The others become read_error, duplicate_dropped or process, in that order.
    """
    outputs = existing.select("processed_rel_path").distinct()
    ok = F.col("status") == "ok"
    failed = ledger.filter(~ok).select(*KEY)
    intact = ledger.filter(ok).join(outputs, "processed_rel_path", "left_semi").select(*KEY)
    left = manifest.join(failed.unionByName(intact), list(KEY), "left_anti")
    action = F.when(F.col("read_error").isNotNull(), "read_error").when(F.col("is_dropped"), "duplicate_dropped")
    return mark_dropped(left, drops).withColumn("action", action.otherwise("process")).drop("is_dropped")


def ledger_for_manifest(ledger: DataFrame, manifest: DataFrame) -> DataFrame:
    return ledger.join(manifest.select(*KEY), list(KEY), "left_semi")


def status_counts(ledger: DataFrame, keys: Sequence[str] = ("dataset", "split", "source", "label", "status")) -> DataFrame:
    return ledger.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def status_report(ledger: DataFrame) -> DataFrame:
    """Per source: rows, rows done, and among those the clamped-crop and several-faces rates."""
    ok = F.col("status") == "ok"
    return ledger.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(F.when(ok, 1)).alias("n_ok"),
        F.avg(F.when(ok, F.col("crop_clamped").cast("int"))).alias("crop_clamped_rate"),
        F.avg(F.when(ok, (F.col("num_faces") > 1).cast("int"))).alias("multi_face_rate"),
    )


def status_rates(ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    return ledger.groupBy(*keys).agg(
        *[F.avg((F.col("status") == s).cast("int")).alias(f"{s}_rate") for s in STATUSES],
    )


def generation_status(log: DataFrame, existing: DataFrame) -> DataFrame:
    """One row: saved (last record ok and its file exists) and degenerate records of a generator log."""
    last = latest_records(log, ["index"])
    files = existing.select("file").distinct().withColumn("there", F.lit(1))
    joined = last.join(files, "file", "left")
    return joined.agg(
        F.count(F.when((F.col("status") == "ok") & F.col("there").isNotNull(), 1)).alias("saved"),
        F.count(F.when(F.col("status") == "degenerate", 1)).alias("degenerate"),
    )
