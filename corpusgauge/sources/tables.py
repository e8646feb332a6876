"""Readers and writers of the tables that pass between stages. Schemas are explicit, never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.hashing import output_name
from corpusgauge.operators.ledger import latest_records
from corpusgauge.operators.manifest import MANIFEST_COLUMNS, MANIFEST_SCHEMA, require_valid, sample_fraction

PREDICTION_SCHEMA = (
    "dataset string, split string, source string, label string, rel_path string, processed_rel_path string, logit double"
)
PREDICTION_COLUMNS = tuple(part.split()[0] for part in PREDICTION_SCHEMA.split(", "))
PROGRESS_SCHEMA = "dataset string, rel_path string, status string, processed_rel_path string"
PROCESSED_REQUIRED = ("status", "label", "split", "dataset", "processed_rel_path")


#: How manifests lie in files: quotes doubled, line ends inside quotes, blanks kept, and nothing for null and for an empty text, which comes back as null.
MANIFEST_FORMAT = {"header": "true", "quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n", "nullValue": "", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
TORN = "_torn"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Gzip CSV (or any CSV) manifest: pinned types, torn rows found, header and rules checked."""
    head = spark.read.options(**MANIFEST_FORMAT).csv(path).columns
    if tuple(head) != MANIFEST_COLUMNS:
        raise ValueError(f"{path} is no manifest: its columns are {head}")
    options = {**MANIFEST_FORMAT, "columnNameOfCorruptRecord": TORN, "mode": "PERMISSIVE", "enforceSchema": "false"}
    rows = spark.read.schema(f"{MANIFEST_SCHEMA}, {TORN} string").options(**options).csv(path)
    # a torn row has a value too many or too few, or one of another type; all columns are read, or the column would not be filled
    torn = rows.select(*MANIFEST_COLUMNS, TORN).filter(F.col(TORN).isNotNull()).limit(3).collect()
    if torn:
        raise ValueError(f"{path} holds torn rows, such as {[r[TORN][:200] for r in torn]}")
    return require_valid(rows.drop(TORN))


def write_manifest(df: DataFrame, path: str) -> None:
    """A checked manifest as gzip CSV, one part per task."""
    require_valid(df).select(*MANIFEST_COLUMNS).write.mode("overwrite").options(**MANIFEST_FORMAT).csv(path, compression="gzip")


def manifest_lines(df: DataFrame) -> DataFrame:
    """Manifest rows as CSV text lines."""
    columns = [part.split()[0] for part in MANIFEST_SCHEMA.split(", ")]
    return df.select(F.to_csv(F.struct(*columns)).alias("line"))


def parse_manifest_lines(lines: DataFrame) -> DataFrame:
    return lines.select(F.from_csv("line", MANIFEST_SCHEMA).alias("r")).select("r.*")


def merge_predictions(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of prediction tables, one row per (dataset, rel_path): the first table that has it.

    Tables are ranked by position, repeats inside one table by their values (files have no row
    order). The minimum is taken by partial aggregation, so a key repeated everywhere folds early.
    """
    out = None
    for i, frame in enumerate(frames):
        missing = [c for c in PREDICTION_COLUMNS if c not in frame.columns]
        if missing:
            raise ValueError(f"table {i} is not a predictions table (missing {missing})")
        part = frame.select(*PREDICTION_COLUMNS, F.lit(i).alias("_file"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no prediction tables given")
    rest = [c for c in PREDICTION_COLUMNS if c not in ("dataset", "rel_path")]
    first = out.groupBy("dataset", "rel_path").agg(F.min(F.struct("_file", *rest)).alias("_r"))
    return first.select("dataset", "rel_path", *[f"_r.{c}" for c in rest]).select(*PREDICTION_COLUMNS)


def read_predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Prediction CSVs; the header must name all seven columns."""
    frames = []
    for path in paths:
        header = spark.read.option("header", "true").csv(path).columns
        missing = [c for c in PREDICTION_COLUMNS if c not in header]
        if missing:
            raise ValueError(f"{path} is not a predictions file (missing {missing})")
        types = dict(part.split() for part in PREDICTION_SCHEMA.split(", "))
        schema = ", ".join(f"`{c}` {types.get(c, 'string')}" for c in header)
        frames.append(spark.read.schema(schema).option("header", "true").csv(path))
    return merge_predictions(frames)


def processed_rows(
    ledger: DataFrame,
    splits: Sequence[str] | None = None,
    datasets: Sequence[str] | None = None,
    fraction: float = 1.0,
    seed: int = 42,
) -> DataFrame:
    """Rows with status ok, optionally of some splits and datasets and a share per label; empty is an error."""
    missing = [c for c in PROCESSED_REQUIRED if c not in ledger.columns]
    if missing:
        raise ValueError(f"not a processed manifest (missing {missing})")
    rows = ledger.filter(F.col("status") == "ok")
    if splits:
        rows = rows.filter(F.col("split").isin(list(splits)))
    if datasets:
        rows = rows.filter(F.col("dataset").isin(list(datasets)))
    if rows.isEmpty():
        raise ValueError(f"no processed rows for splits={splits} datasets={datasets}")
    return sample_fraction(rows, fraction, seed, ["label"]) if fraction < 1.0 else rows


def parse_progress(lines: DataFrame, schema: str = PROGRESS_SCHEMA, key: Sequence[str] = ("dataset", "rel_path")) -> DataFrame:
    """JSON lines (`seq`, `line`) to the last record per key. Blank and torn lines are skipped."""
    parsed = lines.filter(F.trim("line") != "").select(
        "seq", F.from_json("line", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r")
    )
    return latest_records(parsed.filter(F.col("r._bad").isNull()).select("seq", "r.*").drop("_bad"), key)


def read_progress_log(spark: SparkSession, path: str, schema: str = PROGRESS_SCHEMA, seq: str = "seq") -> DataFrame:
    """A JSON-lines log whose records carry their append number, last record per key."""
    full = f"{schema}, `{seq}` bigint, _bad string"
    raw = spark.read.schema(full).option("columnNameOfCorruptRecord", "_bad").json(path)
    return latest_records(raw.filter(F.col("_bad").isNull()).drop("_bad"), seq=seq)


def with_output_name(df: DataFrame) -> DataFrame:
    name: Column = output_name(F.col("dataset"), F.col("split"), F.col("label"), F.col("sha256"), F.col("rel_path"))
    return df.withColumn("processed_rel_path", name)


def write_partitioned(df: DataFrame, path: str) -> None:
    """Parquet below dataset=/split=/label=, with the output name as a column.

    Rows spread over each folder's tasks by content, so a folder holding most rows is written by many.
    """
    named = with_output_name(df)
    spread = F.pmod(F.xxhash64("rel_path"), F.lit(64))
    placed = named.withColumn("_part", spread).repartition("dataset", "split", "label", "_part").drop("_part")
    placed.write.mode("overwrite").partitionBy("dataset", "split", "label").parquet(path)
