"""Repeated passages by recompression.

A text is a row of word names. Rounds give runs of one symbol, and then pairs of neighbouring symbols of two kinds, names
of their own; a name is a hash of what it stands for, so every task on every machine names equal runs and pairs alike without
asking. Whether a boundary between symbols outlives a round depends on near-by words only. For each boundary it is tracked
on which words; where these lie within REACH words on both sides, equal passages have equal boundaries of equal
level. Each window of a text picks one such boundary in its middle, of the highest level and then by a hash of the words
beside it: equal windows pick the same one. Shared boundaries (by the name of the words around them) show where windows may repeat, and
names of all the words of their windows decide it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusgauge.llm.mph import mix
from corpusgauge.llm.shared import free_name
from corpusgauge.llm.words import WORD_BASE, WORD_BASE_2, chunks, spans

U = np.uint64
#: Rounds of naming, and how far from a boundary the words may lie that decide about it.
ROUNDS, REACH = 4, 8
FAR = 1 << 40
_NULL_KEY = -(1 << 63)


def boundary_levels(names: np.ndarray, first_word: np.ndarray, rounds: int = ROUNDS, reach: int = REACH) -> np.ndarray:
    """For each word, how many rounds the boundary before it outlives as far as the words within `reach` of it tell; 0 for the first word of a text."""
    n = len(names)
    level = np.zeros(n, np.int8)
    if not n:
        return level
    at, name = np.arange(n + 1), names
    first = np.zeros(n + 1, bool)
    first[first_word[first_word < n]] = True
    first[n] = True
    # words that a boundary's survival and a symbol's name depend on: from low to high
    blo, bhi = np.where(first, -FAR, at), np.where(first, FAR, at)
    slo, shi = at[:-1].copy(), at[:-1] + 1

    def renew(stay: np.ndarray, new_name) -> None:
        nonlocal at, name, first, blo, bhi, slo, shi
        m = len(name)
        lo, hi = blo.copy(), bhi.copy()
        lo[1:m] = np.minimum(blo[1:m], np.minimum(slo[:-1], slo[1:]))
        hi[1:m] = np.maximum(bhi[1:m], np.maximum(shi[:-1], shi[1:]))
        lo[first], hi[first] = -FAR, FAR
        idx = np.flatnonzero(stay)
        ends = np.append(idx[1:], m)
        slo2 = np.minimum(np.minimum.reduceat(slo, idx), np.minimum(lo[idx], lo[ends]))
        shi2 = np.maximum(np.maximum.reduceat(shi, idx), np.maximum(hi[idx], hi[ends]))
        name = new_name(idx, ends - idx)
        keep = np.append(idx, m)
        at, first, blo, bhi, slo, shi = at[keep], first[keep], lo[keep], hi[keep], slo2, shi2

    for k in range(1, rounds + 1):
        old = name
        stay = np.ones(len(old), bool)
        stay[1:] = (old[1:] != old[:-1]) | first[1:-1]
        renew(stay, lambda idx, n_of, old=old: np.where(n_of > 1, mix(old[idx] ^ mix(n_of.astype(U), 2), 3), old[idx]))
        old = name
        left = (mix(old, 10 + k) & U(1)) == 1
        stay = np.ones(len(old), bool)
        stay[1:] = ~(left[:-1] & ~left[1:]) | first[1:-1]

        def paired(idx: np.ndarray, n_of: np.ndarray, old: np.ndarray = old) -> np.ndarray:
            other = old[np.minimum(idx + 1, len(old) - 1)]
            with np.errstate(over="ignore"):
                return np.where(n_of > 1, mix(old[idx] * U(3) + mix(other, 4), 5), old[idx])

        renew(stay, paired)
        near = ~first[:-1] & (at[:-1] - blo[:-1] <= reach) & (bhi[:-1] - at[:-1] <= reach)
        level[at[:-1][near]] = k
    return level


def anchors(names: np.ndarray, starts: np.ndarray, width: int, rounds: int = ROUNDS, reach: int = REACH) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows that pick the same boundary: text number, first window's word, number of windows, key, block.

    `starts` tells where each text's words begin and the last ones' end. Key names the words around the boundary that all
    windows with this boundary share, block all words of the run; a window without a boundary is a run of its own.
    """
    reach = min(reach, max(0, (width - 2) // 2))
    sizes = np.diff(starts)
    per_text = np.maximum(0, sizes - width + 1)
    text = np.repeat(np.arange(len(sizes)), per_text)
    if not len(text):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(U), none.astype(U)
    s = np.repeat(starts[:-1] - (np.cumsum(per_text) - per_text), per_text) + np.arange(len(text))
    level = boundary_levels(names, starts[:-1], rounds, reach)
    # one number per boundary: level, a hash of the words beside it, and its place, the first being largest
    bits = len(names).bit_length()
    beside = names.copy()
    with np.errstate(over="ignore"):
        beside[1:] = beside[1:] * U(5) + names[:-1]
    order = (level.astype(U) << U(60)) | (mix(beside, 11) >> U(4 + bits) << U(bits)) | (U((1 << bits) - 1) - np.arange(len(names), dtype=U))
    order[level == 0] = 0
    best, have, want = order, 1, width - 2 * reach + (reach > 0)
    while have < want:
        step = min(have, want - have)
        best = np.maximum(best[: len(best) - step], best[step:])
        have += step
    won = best[s + reach]
    picked, rank = ((1 << bits) - 1 - (won & U((1 << bits) - 1)).astype(np.int64)), (won >> U(60)).astype(np.int8)
    picked[won == 0] = -1
    alone = picked < 0
    picked[alone] = s[alone]
    new = np.ones(len(s), bool)
    new[1:] = (picked[1:] != picked[:-1]) | (text[1:] != text[:-1]) | (rank[1:] != rank[:-1])
    run = np.flatnonzero(new)
    count = np.diff(np.append(run, len(s)))
    p, s0, k = picked[run], s[run], rank[run]
    lo, hi = np.where(k > 0, p - reach, p), np.where(k > 0, p + reach, p + width)
    with np.errstate(over="ignore"):
        key = mix(spans(names, lo, hi, WORD_BASE) + k.astype(U), 6)
        block = mix(spans(names, s0, s0 + count - 1 + width, WORD_BASE_2) + (p - s0).astype(U) * U(WORD_BASE) + count.astype(U), 7)
    return text[run], s0 - starts[text[run]], count, key, block


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(U).view(np.int64))


def repeated_windows(docs: DataFrame, key: str, text: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The keyed texts (id, th, text) and, per text with any, the windows whose words also start elsewhere: runs (first, count).

    Texts are keyed by id and a hash, so repeated ids don't mix; two equal rows have equal answers. Only (key, block)
    rows and the few windows at the ends of repeated passages are shuffled, and the texts themselves once.
    """
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY)).alias("id")
    texts = docs.select(id_, F.hash(F.col(text)).alias("th"), F.coalesce(F.col(text), F.lit("")).alias("text")).repartition("id", "th")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for a, names, starts in chunks(b.column(2)):
                of, first, count, k, block = anchors(names, starts, width)
                yield pa.RecordBatch.from_arrays([_signed(k), _signed(block), pa.array(ids[a + of]), pa.array(th[a + of]), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["key", "block", "id", "th", "first", "count"])

    runs = texts.mapInArrow(find, "key long, block long, id long, th int, first int, count int").repartition("key")
    by_key, by_block = Window.partitionBy("key"), Window.partitionBy("key", "block")
    counted = runs.withColumns({
        "n": F.count("*").over(by_block), "nth": F.row_number().over(by_block.orderBy("id", "th", "first")), "all": F.count("*").over(by_key),
    }).where("all > 1")
    # kind 1: every window of the run repeats; 2: it has to be looked at; 3: as 1, and it stands for its equals where others are looked at
    marks = counted.select("id", "th", "first", "count", F.when(F.col("n") == 1, 2).when((F.col("nth") == 1) & (F.col("all") > F.col("n")), 3).otherwise(1).cast("byte").alias("kind"))
    grouped = marks.groupBy("id", "th").agg(F.collect_list(F.struct("first", "count", "kind")).alias("marks"))
    looked = texts.join(grouped.where(F.exists("marks", lambda m: m["kind"] > 1)), ["id", "th"]).select("id", "th", "text", F.filter("marks", lambda m: m["kind"] > 1).alias("marks"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, th, marks = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3)
            offsets, flat = marks.offsets.to_numpy() - marks.offsets[0].as_py(), marks.flatten()
            first, count, kind = (flat.field(c).to_numpy() for c in ("first", "count", "kind"))
            for a, names, starts in chunks(b.column(2)):
                m = np.arange(offsets[a], offsets[min(len(ids), a + len(starts) - 1)])
                of = np.searchsorted(offsets, m, "right") - 1
                each = np.repeat(np.arange(len(m)), count[m])
                at = first[m][each] + (np.arange(len(each)) - np.repeat(np.cumsum(count[m]) - count[m], count[m]))
                s = starts[of[each] - a] + at
                h1, h2 = mix(spans(names, s, s + width, WORD_BASE), 8), mix(spans(names, s, s + width, WORD_BASE_2), 9)
                yield pa.RecordBatch.from_arrays([_signed(h1), _signed(h2), pa.array(ids[of[each]]), pa.array(th[of[each]]), pa.array(at.astype(np.int32)), pa.array(np.where(kind[m][each] == 3, 2, 1).astype(np.int32))], ["h1", "h2", "id", "th", "at", "weight"])

    windows = looked.mapInArrow(name, "h1 long, h2 long, id long, th int, at int, weight int")
    seen = windows.withColumn("total", F.sum("weight").over(Window.partitionBy("h1", "h2"))).where("weight = 1 and total > 1")
    edges = seen.groupBy("id", "th").agg(F.collect_list(F.struct(F.col("at").alias("first"), F.lit(1).alias("count"))).alias("edges"))
    whole = F.transform(F.filter("marks", lambda m: m["kind"] != 2), lambda m: F.struct(m["first"].alias("first"), m["count"].alias("count")))
    none = F.array().cast("array<struct<first:int,count:int>>")
    found = grouped.select("id", "th", whole.alias("whole")).join(edges, ["id", "th"], "left").select("id", "th", F.concat("whole", F.coalesce("edges", none)).alias("runs"))
    return texts, found.where(F.size("runs") > 0)


def _left(text: str, runs: list[dict] | None, width: int) -> tuple[str, int, int]:
    """The words outside all windows of the runs, joined by one space; how many words there were, and how many went."""
    words = text.encode().split()
    n = len(words)
    if runs:
        edge = np.zeros(n + 1, np.int64)
        first = np.array([r["first"] for r in runs])
        np.add.at(edge, first, 1)
        np.add.at(edge, first + np.array([r["count"] for r in runs]) - 1 + width, -1)
        words = list(compress(words, (np.cumsum(edge[:-1]) == 0).tolist()))
    return b" ".join(words).decode(), n, n - len(words)


def dedup(docs: DataFrame, key: str, text: str, width: int = 35) -> DataFrame:
    """Removes every word that lies in a window of `width` words whose words also start anywhere else.

    Returns key, n_words, n_removed and kept (the remaining words joined by one space) for each row. Words are runs
    without blank, tab and line end characters, unchanged. Null and empty texts and those shorter than a window lose nothing;
    of equal texts that are long enough all words go. Null and repeated keys are kept.
    """
    texts, runs = repeated_windows(docs, key, text, width)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, n_words, gone, kept, held = [], [], [], [], 0
            for id_, text_, runs_ in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                left, n, removed = _left(text_.as_py(), runs_, width)
                keys.append(id_)
                n_words.append(n)
                gone.append(removed)
                kept.append(left)
                held += len(kept[-1])
                if held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])
                    keys, n_words, gone, kept, held = [], [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])

    out = texts.join(runs, ["id", "th"], "left").select("id", "text", "runs").mapInArrow(cut, "id long, n_words long, n_removed long, kept string")
    return out.select(F.when(F.col("id") != _NULL_KEY, F.col("id")).alias(key), "n_words", "n_removed", "kept")


def cut_repeated(docs: DataFrame, key: str, text: str, width: int = 35) -> DataFrame:
    """`docs` without the words that dedup() removes: changed texts are their remaining words joined by one space, others stay as they are.

    All rows and columns stay, also those whose text is left empty.
    """
    carried = [c for c in docs.columns if c != text]
    _, runs = repeated_windows(docs, key, text, width)
    # names that the table does not have
    id_name, th, found = (free_name(docs, c) for c in ("_id", "_th", "_runs"))
    runs = runs.select(F.col("id").alias(id_name), F.col("th").alias(th), F.col("runs").alias(found))
    id_ = F.coalesce(F.col(key).cast("long"), F.lit(_NULL_KEY))
    marked = docs.join(runs, (id_ == F.col(id_name)) & (F.hash(F.col(text)) == F.col(th)), "left").select(*carried, F.col(text).alias(text), found)
    place = len(carried)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts_ = [t.as_py() if r is None else _left(t.as_py(), r, width)[0] for t, r in zip(b.column(place), b.column(place + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:place], pa.array(texts_, pa.string())], [*carried, text])

    return marked.mapInArrow(cut, docs.select(*carried, text).schema).select(*docs.columns)
