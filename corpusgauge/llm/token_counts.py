"""Token totals by source, language and tokenizer version, kept up to date by signed deltas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm.bpe import whole_text_ids
from corpusgauge.llm.shared import stored

GROUP = ["source", "lang", "tokenizer"]
TOTALS = ["n_docs", "n_tokens"]


def token_counts(docs: DataFrame, keep: list[str], text: str, path: str, version: str) -> DataFrame:
    """The kept columns, tokenizer version and number of tokens of every whole text; null and empty texts have none."""
    table = docs.select(*keep, F.col(text).alias("_text"))
    schema = docs.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(x) // 4 for x in whole_text_ids(path, (x.as_py() for x in b.column(len(keep))))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return table.mapInArrow(count, schema).withColumn("tokenizer", F.lit(version))


def signed(changes: DataFrame) -> DataFrame:
    """Additive rows of a change table: source, lang, tokenizer, old_tokens, new_tokens.

    old_tokens null: an insert; new_tokens null: a delete; both: a revised count, which moves no document; neither: nothing.
    """
    old, new = F.col("old_tokens"), F.col("new_tokens")
    return changes.select(*GROUP, (new.isNotNull().cast("long") - old.isNotNull().cast("long")).alias("n_docs"), (F.coalesce(new, F.lit(0)) - F.coalesce(old, F.lit(0))).cast("long").alias("n_tokens"))


def fold(rows: DataFrame) -> DataFrame:
    """Totals per group, partly summed before the shuffle, so a source with a third of all rows is a few rows. Null groups count."""
    return rows.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in TOTALS])


#: Bytes of a batch's name, at most: it is written in hexadecimal digits in a folder's name.
NAME_BYTES = 100


class Rollup:
    """Totals in a folder, maintained: a base table, and one small table of folded deltas per batch committed since.

    A batch is committed by the writer's own _SUCCESS mark; committing a batch of the same name again replaces nothing and
    adds nothing, half a batch is overwritten. compact() folds all batches into a new base, which counts from the moment its list
    of batches is written; so totals read one base and the few batches that it does not hold, however many there were.
    One writer at a time; readers may go on meanwhile.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    @staticmethod
    def _place(batch: str) -> str:
        """Any name may be given; it never reaches a path as it is."""
        raw = batch.encode()
        if not 0 < len(raw) <= NAME_BYTES:
            raise ValueError(f"a batch's name has 1 to {NAME_BYTES} bytes")
        return f"batch={raw.hex()}"

    def _folders(self, prefix: str) -> list[str]:
        if not self.fs.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self.fs.listStatus(self._path(""))]
        return sorted(n[len(prefix) :] for n in names if n.startswith(prefix))

    def _base(self) -> int | None:
        """The newest base that is whole: its totals are written before the list of its batches."""
        done = [int(n) for n in self._folders("base=") if self.fs.exists(self._path(f"base={n}/held/_SUCCESS"))]
        return max(done, default=None)

    def _held(self, base: int) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/base={base}/held")

    def committed(self, batch: str) -> bool:
        if self.fs.exists(self._path(f"{self._place(batch)}/_SUCCESS")):
            return True
        base = self._base()
        return base is not None and not self._held(base).where(F.col("batch") == batch).isEmpty()

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of changes; false if it is there already, in its own folder or in the base."""
        if self.committed(batch):
            return False
        fold(signed(changes)).write.mode("overwrite").parquet(f"{self.folder}/{self._place(batch)}")
        return True

    def batches(self) -> list[str]:
        """Batches committed since the base was made."""
        names = [bytes.fromhex(n).decode() for n in self._folders("batch=") if self.fs.exists(self._path(f"batch={n}/_SUCCESS"))]
        base = self._base()
        if base is None or not names:
            return sorted(names)
        old = {r["batch"] for r in self._held(base).where(F.col("batch").isin(names)).collect()}  # no more than there are folders
        return sorted(set(names) - old)

    def _sum(self, base: int | None, batches: list[str]) -> DataFrame | None:
        places = [f"{self.folder}/base={base}/totals"] * (base is not None) + [f"{self.folder}/{self._place(b)}" for b in batches]
        if not places:
            return None
        schema = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
        return fold(self.spark.read.schema(schema).parquet(*places)).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def totals(self) -> DataFrame:
        """Current totals; groups whose documents are all gone have no row."""
        found = self._sum(self._base(), self.batches())
        return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs long, n_tokens long") if found is None else found

    def compact(self) -> int:
        """Folds the base and all batches into a new base; returns how many batches it took in.

        Broken off before its list is written, it has changed nothing. What the new base holds is removed after that; a folder
        that stays because of a failure is known from the list and counts no more.
        """
        base, names = self._base(), self.batches()
        if not names:
            return 0
        new = 0 if base is None else base + 1
        self._sum(base, names).write.mode("overwrite").parquet(f"{self.folder}/base={new}/totals")
        listed = self.spark.createDataFrame([(b,) for b in names], "batch string")
        listed = listed if base is None else self._held(base).unionByName(listed)
        listed.write.mode("overwrite").parquet(f"{self.folder}/base={new}/held")
        for b in names:
            self.fs.delete(self._path(self._place(b)), True)
        for n in self._folders("base="):
            if int(n) < new - 1:  # those who read the last base may go on
                self.fs.delete(self._path(f"base={n}"), True)
        return len(names)


def retokenized(docs: DataFrame, key: str, text: str, path: str, version: str, old_path: str, old_version: str) -> tuple[DataFrame, DataFrame]:
    """Counts by two tokenizer versions of each row, the old one's for a delete and the new one's for an insert."""
    keep = [key, "source", "lang"]
    return stored(token_counts(docs, keep, text, old_path, old_version), "counts"), stored(token_counts(docs, keep, text, path, version), "counts")
