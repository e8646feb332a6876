"""From raw documents to packed training sequences: five stages over the documents table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusgauge.llm import jaccard, packing, quality, substrings, toxicity
from corpusgauge.llm.queries import BYTE_BPE, table, vocabulary, with_crc32
from corpusgauge.llm.shared import BATCH_SETTING, free_name, small_batches, stored  # noqa: F401


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model scores 0.5 or more go."""
    small_batches(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    name = free_name(docs, "_score")
    return toxicity.score(docs, model, out=name).where(F.col(name) < 0.5).drop(name)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; equal keys share the answers of their texts."""
    judged = quality.judge(docs, table(spark, sf_dir, "labels"), keep_digest=True)
    id_, digest = free_name(docs, "_id"), free_name(docs, "_digest")
    rejected = judged.where(~F.col("kept")).select(F.col("doc_id").alias(id_), F.col("_digest").alias(digest)).distinct()
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col(id_)) & (own == F.col(digest)), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of documents with similar sets of five-word shingles (0.8 or more), the one with the smallest id stays."""
    small_batches(spark)
    classes = jaccard.similar_classes(docs, "doc_id", "text", n=5, num=80, den=100, keep_digest=True)
    return jaccard.keep_one(docs, classes, "doc_id", "text")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that also stand elsewhere go; other texts stay as they are."""
    small_batches(spark)
    return substrings.cut_repeated(docs, "doc_id", "text").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 ids; one row per piece."""
    small_batches(spark)
    return with_crc32(packing.pack_documents(docs, "doc_id", "text", vocabulary(BYTE_BPE), size=1024, end_id=2), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("quality rules", keep_quality), ("n-gram Jaccard join", drop_near_copies), ("substring dedup", cut_repeats), ("best-fit packing", pack),
]

#: Tokenizers and the learned stages cannot be written in SQL; tests compare the chained stages with plain versions, given the learned model and cutoffs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each one's rows written and read again as the next one's documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
