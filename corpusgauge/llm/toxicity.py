"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the model is fitted on, at most.
FIT_ROWS = 20_000
#: Terms with weights, at most: those that tell the labels apart best; and how many labelled texts a term needs.
TERMS, MIN_TEXTS = 4096, 4
#: Least evidence of a term (natural log of a likelihood ratio): chance alone rarely reaches it among all terms.
MIN_GAIN = 7
#: Length of the beginnings of words that are terms of their own.
STEM = 5
FACTORS, EPOCHS, STEP, BATCH = 8, 25, 0.2, 256

_WORD = re.compile(r"[^\W\d_]+")
#: Words whose terms a task remembers; beyond it the memory starts anew.
KEPT_WORDS = 100_000


def hashes(word: str) -> tuple[int, ...]:
    """Hashed terms of a word: itself, and its beginning if it is longer."""
    data = word.encode()
    return (zlib.crc32(data), zlib.crc32(word[:STEM].encode(), 1)) if len(word) >= STEM else (zlib.crc32(data),)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def fit(terms: list[np.ndarray], y: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights of a factorization machine: bias, and for each hashed term that was chosen a weight and factors.

    score = bias + sum of weights + sum over pairs of terms of the product of their factors; AdaGrad on the log loss.
    """
    n, pos = max(1, len(y)), int(y.sum())
    # terms stay as narrow as they come, and only chosen ones get a row and a slot
    flat = lambda some: np.concatenate([*some, np.zeros(0, np.uint32)])
    seen, in_all = np.unique(flat(terms), return_counts=True)
    in_all, in_pos = in_all.astype(float), np.zeros(len(seen))
    found, times = np.unique(flat(t for t, label in zip(terms, y, strict=True) if label), return_counts=True)
    in_pos[np.searchsorted(seen, found)] = times
    # strength of evidence: the likelihood ratio of a term's share of positives against all
    p, q = (in_pos + 0.5) / (in_all + 1), (pos + 0.5) / (n + 1)
    gain = in_pos * np.log(p / q) + (in_all - in_pos) * np.log((1 - p) / (1 - q))
    gain[in_all < MIN_TEXTS] = -1
    best = np.sort(np.argsort(-gain, kind="stable")[:TERMS])
    best = best[gain[best] > MIN_GAIN]
    chosen, m = seen[best].astype(np.int64), len(best)
    places = ((t, np.searchsorted(chosen[:-1], t)) for t in terms)
    slots = [at[chosen[at] == t] if m else at[:0] for t, at in places]
    row, slot = np.repeat(np.arange(len(terms)), [len(t) for t in slots]), np.concatenate([*slots, np.zeros(0, np.int64)])
    starts = np.searchsorted(row, np.arange(len(terms) + 1))
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(q / (1 - q))), np.zeros(m), rng.normal(0, 0.01, (m, FACTORS))
    hb, hw, hv = 1e-6, np.full(m, 1e-6), np.full((m, FACTORS), 1e-6)
    for _ in range(EPOCHS if m else 0):
        order = rng.permutation(len(terms))
        for a in range(0, len(order), BATCH):
            picked = order[a : a + BATCH]
            sizes = starts[picked + 1] - starts[picked]
            r = np.repeat(np.arange(len(picked)), sizes)
            at = np.repeat(starts[picked] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            s = slot[at]
            z, sums = _raw(bias, w, v, s, r, len(picked))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[picked]) / len(picked)
            gw = np.bincount(s, g[r], minlength=m) + 1e-6 * w
            gv = np.stack([np.bincount(s, g[r] * (sums[r, f] - v[s, f]), minlength=m) for f in range(FACTORS)], 1) + 1e-5 * v
            hb, hw, hv = hb + g.sum() ** 2, hw + gw**2, hv + gv**2
            bias -= STEP * g.sum() / np.sqrt(hb)
            w -= STEP * gw / np.sqrt(hw)
            v -= 0.25 * STEP * gv / np.sqrt(hv)
    return {"bias": np.array([bias]), "term": chosen, "w": w, "v": v.reshape(-1)}


def _raw(bias: float, w: np.ndarray, v: np.ndarray, slot: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of n rows before the logistic function, and their sums of factors."""
    z = bias + np.bincount(row, w[slot], minlength=n)
    sums = np.stack([np.bincount(row, v[slot, f], minlength=n) for f in range(v.shape[1])], 1) if len(w) else np.zeros((n, max(1, v.shape[1])))
    squares = np.bincount(row, (v[slot] ** 2).sum(1), minlength=n) if len(w) else 0
    return z + 0.5 * ((sums**2).sum(1) - squares), sums


class Scorer:
    """Scores texts with fitted weights; remembers the terms of words it has met."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.bias, self.w, self.v = float(model["bias"][0]), model["w"], model["v"].reshape(-1, FACTORS)
        self.slot = {int(t): i for i, t in enumerate(model["term"])}
        self.memory: dict[str, tuple[int, ...]] = {}

    def slots(self, text: str | None) -> set[int]:
        if len(self.memory) > KEPT_WORDS:
            self.memory.clear()
        memory, out = self.memory, set()
        for word in words(text):
            if (found := memory.get(word)) is None:
                found = memory[word] = tuple(self.slot[h] for h in hashes(word) if h in self.slot)
            if found:
                out.update(found)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        each = [self.slots(t) for t in texts]
        row = np.repeat(np.arange(len(each)), [len(x) for x in each])
        slot = np.fromiter((s for x in each for s in sorted(x)), np.int64, len(row))
        z, _ = _raw(self.bias, self.w, self.v, slot, row, len(each))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = FIT_ROWS) -> dict[str, np.ndarray]:
    """A model of at most `rows` labelled documents outside the held-out ones, those with the smallest key hashes.

    Null labels and labels without a document count for nothing; without any, every score is the same. Terms are made on the
    executors, one task fits, and a model of at most TERMS terms comes back.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    picked = known.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).orderBy(F.xxhash64("_key"), "_key", "_label").limit(rows)
    sample = docs.select(F.col(key).alias("_k"), F.col(text).alias("_text")).join(F.broadcast(picked), F.col("_k") == F.col("_key")).select("_k", "_label", "_text")

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [np.unique(np.array([h for w in words(t) for h in hashes(w)], np.int64)) for t in b["_text"]]
            yield pd.DataFrame({"_k": b["_k"], "_label": b["_label"], "terms": [f.astype("<u4").tobytes() for f in found]})

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_k", "_label", "terms"])
        model = fit([np.frombuffer(t, "<u4") for t in group["terms"]], group["_label"].to_numpy(float))
        return pd.DataFrame({"name": list(model), "data": [x.astype("<i8" if k == "term" else "<f8").tobytes() for k, x in model.items()]})

    schema = T.StructType([T.StructField("_k", docs.schema[key].dataType), T.StructField("_label", T.IntegerType()), T.StructField("terms", T.BinaryType())])
    found = sample.mapInPandas(terms, schema).withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(fitted, "name string, data binary").collect()
    model = {r["name"]: np.frombuffer(bytes(r["data"]), "<i8" if r["name"] == "term" else "<f8") for r in found}
    return model or {"bias": np.array([-3.0]), "term": np.zeros(0, np.int64), "w": np.zeros(0), "v": np.zeros(0)}


def score(docs: DataFrame, model: dict[str, np.ndarray], text: str = "text", out: str = "score") -> DataFrame:
    """Adds a score between 0 and 1 of every whole text; null and empty texts get the bias alone. All rows and columns stay."""
    if out in docs.columns:
        raise ValueError(f"the table has a column {out} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text))
            found = [scorer.scores([x.as_py() for x in texts[a : a + 512]]) for a in range(0, len(texts), 512)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([*found, np.zeros(0)]))], [*b.schema.names, out])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
