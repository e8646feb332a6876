"""File listings and scans on Spark's binaryFile and image sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.functions.formats import IMAGE_EXTENSIONS, sniff_format


SPLIT_FOLDERS = ("train", "valid", "test")


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """(path, rel_path, length) of all files below root with an allowed extension, any case.

    The content column is never selected, so no file is opened.
    """
    base = root.rstrip("/")
    allowed = "|".join(e.lstrip(".") for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    tail = F.element_at(F.split("path", f"\\Q{base}/\\E", 2), -1)
    named = files.select("path", tail.alias("rel_path"), "length")
    return named.filter(F.col("path").rlike(rf"(?i)\.({allowed})$"))


def layout_specs(
    paths: DataFrame,
    dataset: str,
    layout: str = "external",
    sources: Mapping[str, str] | None = None,
    splits: Sequence[str] = SPLIT_FOLDERS,
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
) -> DataFrame:
    """Record specs (rel_path, dataset, source, label, split) from a table of paths (`rel_path`), wherever it comes from.

    `split` layout: <split>/<label>/..., with known splits, the source following from the label (`sources`).
    `external` layout: <label>/<source>/..., the split being the dataset. Paths of no image, without the two folders, or
    below other folders are no specs. Narrow: a listing of any size is filtered where it stands.
    """
    parts = F.split("rel_path", "/")
    label, other = (F.get(parts, F.lit(i)) for i in ((1, 0) if layout == "split" else (0, 1)))
    if layout == "split":
        named = F.create_map(*[F.lit(x) for pair in (sources or {}).items() for x in pair]) if sources else F.create_map().cast("map<string,string>")
        columns, fits = {"source": F.try_element_at(named, label), "split": other}, other.isin(list(splits))
    elif layout == "external":
        columns, fits = {"source": other, "split": F.lit(dataset)}, F.lit(True)
    else:
        raise ValueError(f"unknown layout {layout!r}")
    allowed = "|".join(e.lstrip(".") for e in extensions)
    image = F.element_at(parts, -1).rlike(rf"(?i)^.+\.({allowed})$")
    deep = paths.filter(image & (F.size(parts) >= 3) & label.isin("real", "fake") & fits)
    return deep.withColumns({"dataset": F.lit(dataset), "label": label, **columns}).select("rel_path", "dataset", "source", "label", "split")


def missing_folders(specs: DataFrame, splits: Sequence[str] = SPLIT_FOLDERS) -> DataFrame:
    """(split, label) folders of the split layout without an image: each of them has to hold some."""
    wanted = specs.sparkSession.range(1).select(F.explode(F.array(*[F.lit(s) for s in splits])).alias("split")).withColumn("label", F.explode(F.array(F.lit("real"), F.lit("fake"))))
    return wanted.join(specs.select("split", "label").distinct(), ["split", "label"], "left_anti")


def discover_files(
    spark: SparkSession,
    root: str,
    dataset: str,
    layout: str = "external",
    sources: Mapping[str, str] | None = None,
    extensions: Sequence[str] = IMAGE_EXTENSIONS,
    complete: bool = False,
) -> DataFrame:
    """Specs of the files below a folder, see layout_specs; no file at all is an error, and with `complete` so is an empty folder of the split layout."""
    specs = layout_specs(list_files(spark, root, extensions), dataset, layout, sources, extensions=extensions)
    if complete and layout == "split" and (empty := missing_folders(specs).collect()):
        raise ValueError(f"no images in {root}: {sorted(f'{r.split}/{r.label}' for r in empty)}")
    if specs.isEmpty():
        raise ValueError(f"no images under {root}")
    return specs


def scan_columns(content: Column) -> dict[str, Column]:
    """sha256, size and sniffed format of binary content."""
    return {"sha256": F.sha2(content, 256), "file_size": F.octet_length(content).cast("bigint"), "format": sniff_format(content)}


def scan_bytes(df: DataFrame, content: str = "content") -> DataFrame:
    """Add the scan columns; rows of no known image format stay, with `read_error`."""
    scanned = df.withColumns(scan_columns(F.col(content))).drop(content)
    known = F.col("format").isin("jpeg", "png", "webp", "gif", "bmp")
    empty = F.when(F.col("file_size") == 0, "empty file")
    return scanned.withColumn("read_error", empty.when(~known, "cannot identify image file"))


def scan_files(spark: SparkSession, specs: DataFrame, root: str) -> DataFrame:
    """Scan the files of a spec table. Narrow per file; the join to the specs is on rel_path."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    named = files.select(F.element_at(F.split("path", f"\\Q{base}/\\E", 2), -1).alias("rel_path"), "content")
    found = scan_bytes(named).withColumn("_found", F.lit(True))
    missing = F.when(F.col("_found").isNull(), "file not found")
    return specs.join(found, "rel_path", "left").withColumn("read_error", F.coalesce("read_error", missing)).drop("_found")


def image_pixels(spark: SparkSession, root: str) -> DataFrame:
    """Decoded pictures (`image` struct); a file that cannot be decoded has height -1."""
    return spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root)
