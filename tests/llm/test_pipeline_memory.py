"""What executors hold while the pipeline runs: batches of whole texts, and the toxicity model's terms."""

from __future__ import annotations

import tracemalloc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from corpusgauge.llm import toxicity
from corpusgauge.llm.shared import new_folder

STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("stage", ["toxicity", "n-gram Jaccard join", "substring dedup", "best-fit packing"])
def test_texts_go_to_workers_in_small_batches(spark, stage):
    def batch_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    folder = new_folder(spark, "tables")
    docs = spark.createDataFrame([(i, f"some words {i}", "en", "s", 12) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    docs.selectExpr("doc_id", "1 as quality", "0 as toxic").write.parquet(f"{folder}/labels.parquet")
    long_texts = spark.range(0, 6000, 1, 1).selectExpr("id", "repeat('word ', 1000) as text")  # 30 MB
    name = corpus_pipeline.BATCH_SETTING
    spark.conf.unset(name)
    try:
        assert STAGES[stage](spark, docs, folder).count()
        found = long_texts.mapInArrow(batch_bytes, "n long, bytes long").collect()
        assert sum(x["n"] for x in found) == 6000 and max(x["bytes"] for x in found) < 6_000_000
        spark.conf.set(name, "1m")
        STAGES[stage](spark, docs, folder)
        assert spark.conf.get(name) == "1m"
    finally:
        spark.conf.unset(name)


def test_fit_holds_terms_few_times():
    r = np.random.default_rng(5)
    y = (r.random(2000) < 0.1).astype(float)
    terms = [np.unique(np.append(r.integers(100, 50_000, 500), [7, 8] if label else [])).astype("<u4") for label in y]
    tracemalloc.start()
    model = toxicity.fit(terms, y)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {7, 8} <= set(model["term"].tolist()) and model["term"].dtype == np.int64
    assert most < 5 * sum(t.nbytes for t in terms)
    wide = toxicity.fit([t.astype(np.int64) for t in terms], y)
    assert all(np.array_equal(model[k], wide[k]) for k in model)
