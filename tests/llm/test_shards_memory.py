"""What executors hold and start while shards are written and read: small batches both ways, and one file for the manifest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pytest

from corpus_pipeline import BATCH_SETTING
from corpusgauge.llm import shards
from corpusgauge.llm.queries import WORD_BPE, vocabulary
from corpusgauge.llm.shared import new_folder, place


@pytest.fixture
def written(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one shard
    spark.conf.unset(BATCH_SETTING)
    folder = new_folder(spark, "shards")
    try:
        shards.write_shards(spark.range(0, 400).selectExpr("id as k", "concat('some words ', id) as t"), "k", "t", vocabulary(WORD_BPE), folder)
        yield folder
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.unset(BATCH_SETTING)


def test_manifest_is_one_file(spark, written):
    fs, path = place(f"{written}/manifest")
    files = [x.base_name for x in fs.get_file_info(pa.fs.FileSelector(path)) if x.base_name.endswith(".parquet")]
    listed = shards.read_manifest(spark, written).collect()
    assert len(files) == 1 and len(listed) > 3 and sum(r["n_rows"] for r in listed) == 400
    assert sorted(r["key"] for r in shards.read_shards(spark, written).collect()) == list(range(400))


def test_texts_go_to_workers_in_small_batches(spark, written):
    def batch_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    long_texts = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word ', 1000) as text")  # 30 MB
    found = long_texts.mapInArrow(batch_bytes, "n long, bytes long").collect()
    assert sum(x["n"] for x in found) == 6000 and max(x["bytes"] for x in found) < 6_000_000


@pytest.mark.parametrize("sizes", [[1] * 5000, [700_000] * 5, [1, 3_000_000, 1, 1, 0, 2_000_000], [1 << 20, 1 << 20], [1 << 19] * 4, [0, 0], []])
def test_rows_are_read_in_small_blocks(sizes):
    s = shards.Shard.__new__(shards.Shard)
    s.n_rows, s.offsets = len(sizes), np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    found = list(s.blocks())
    assert [x for a, b in found for x in range(a, b)] == list(range(len(sizes)))
    assert all(b - a == 1 or (b - a <= shards.BLOCK_ROWS and sum(sizes[a:b]) <= shards.BLOCK_IDS) for a, b in found)
