"""Periodic runs of words: stretches that repeat one block of words four times or more.

Words of a text are numbered, equal words alike. Short periods are found by comparing the words with themselves at each lag.
For longer ones there is a scale per power of two: blocks of 2 W words get names (two halves' names give a block's), and a
block is picked if its name is the smallest of W neighbours. A run of period q, W <= q < 2 W, has picked blocks exactly q
apart, as equal neighbourhoods pick alike, and none of that name in between: two equal blocks nearer than q would
give the run a smaller period. So neighbouring picks of equal name show the lags, and the words beside them the extents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.mph import mix

U = np.uint64
#: Periods below this are found by direct comparison; a power of two.
SCAN_BELOW = 8
#: A run has at least so many periods, and so many words.
LEAST_PERIODS, LEAST_WORDS = 4, 6
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

RUN = "struct<start:long,length:long,period:long>"


def _slide(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over each `width` neighbours x[i : i + width], for all i where they are there; two sweeps over blocks."""
    n = len(x)
    whole = np.concatenate([x, np.full(-n % width, x[-1])]).reshape(-1, width)
    ahead = op.accumulate(whole, axis=1).ravel()
    back = op.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], ahead[width - 1 : n])


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last places of the stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def _reach(ids: np.ndarray, a: int, lag: int, step: int) -> int:
    """How many places from a on (step 1) or before a (step -1) hold the word that stands `lag` further on."""
    done, size = 0, 64
    while True:
        if step > 0:
            x, y = ids[a + done : a + done + size], ids[a + done + lag : a + done + lag + size]
            x = x[: len(y)]
        else:
            lo, hi = max(0, a - done - size), max(0, a - done)
            x, y = ids[lo:hi][::-1], ids[lo + lag : hi + lag][::-1]
        differ = x != y
        if differ.any():
            return done + int(differ.argmax())
        done += len(x)
        if len(x) < size:
            return done
        size *= 2


def _seeds(ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, lags) of pairs of equal picked blocks of each scale, in `ids`, where a word of its own follows each text."""
    at, width = np.arange(len(ids)), SCAN_BELOW
    name, length = mix(ids), 1
    while True:
        long_enough = lengths >= LEAST_PERIODS * width
        if not long_enough.any():
            return
        if not long_enough.all():
            keep = np.repeat(long_enough, lengths + 1)
            at, name, lengths = at[keep], name[keep], lengths[long_enough]
        while length < 2 * width:
            after = np.concatenate([name[length:], mix(np.arange(min(length, len(name)), dtype=U), 1)])
            with np.errstate(over="ignore"):
                name = mix(name * U(0x9E3779B97F4A7C15) + after, 2)
            length *= 2
        low = _slide(np.maximum, np.pad(_slide(np.minimum, name, width), width - 1), width)
        picked = np.flatnonzero(low == name)
        order = np.argsort(name[picked], kind="stable")
        n, p = name[picked][order], at[picked][order]
        lag = p[1:] - p[:-1]
        found = (n[1:] == n[:-1]) & (lag >= width) & (lag < 2 * width)
        yield p[:-1][found], lag[found]
        width *= 2


def find_runs(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and then period.

    ids: numbers of the words of some texts, each text followed by a number that stands nowhere else; lengths: words of each text.
    """
    found = [np.zeros((0, 3), np.int64)]
    for lag in range(1, min(SCAN_BELOW, len(ids))):
        first, end = _stretches(ids[lag:] == ids[:-lag])
        keep = end - first + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag)
        found.append(np.stack([first[keep], end[keep] - first[keep] + lag, np.full(keep.sum(), lag)], axis=1))
    for places, lags in _seeds(ids, lengths):
        order, rows, last, past = np.lexsort((places, lags)), [], 0, 0
        for p, lag in zip(places[order].tolist(), lags[order].tolist(), strict=True):
            if lag == last and p < past:
                continue
            first, last, past = p - _reach(ids, p, lag, -1), lag, p + _reach(ids, p, lag, 1)
            if past - first + lag >= LEAST_PERIODS * lag:
                rows.append((first, past - first + lag, lag))
        found.append(np.array(rows, np.int64).reshape(-1, 3))
    runs = np.concatenate(found)
    # a stretch also repeats at multiples of its period: of equal stretches the smallest lag is the period
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, a = b.column(1), 0
        while a < len(b):
            words, size, z = [], 0, a
            while z < len(b) and (z == a or size < CHUNK_BYTES):
                text = texts[z].as_buffer()
                split = text.to_pybytes().split() if text is not None else []
                size += text.size if text is not None else 0
                words.append(split)
                z += 1
            yield _collapsed(b.column(0).slice(a, z - a), words)
            a = z


def _collapsed(keys: pa.Array, words: list[list[bytes]]) -> pa.RecordBatch:
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    flat = pa.array([x for w in words for x in w], pa.large_binary()).dictionary_encode().indices.to_numpy()
    ids = np.arange(starts[-1]) + len(flat)  # what stays of these numbers follows the texts
    inside = np.ones(starts[-1], bool)
    inside[starts[1:] - 1] = False
    ids[inside] = flat
    runs = find_runs(ids, lengths)
    of = np.searchsorted(starts, runs[:, 0], "right") - 1
    edge = np.zeros(starts[-1] + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    stay, kept = np.cumsum(edge) == 0, [b" ".join(w) for w in words]
    for k in set(of.tolist()):
        kept[k] = b" ".join(compress(words[k], stay[starts[k] : starts[k + 1] - 1].tolist()))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(words)))]), pa.int32())
    fields = [pa.array(x) for x in (runs[:, 0] - starts[of], runs[:, 1], runs[:, 2])]
    listed = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
    return pa.RecordBatch.from_arrays([keys, pa.array(lengths, pa.int64()), listed, pa.array(kept, pa.binary()).cast(pa.string())], ["key", "n_words", "runs", "collapsed"])


def collapse_runs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Finds every periodic run of words in whole texts and collapses each to its first period.

    Returns for each row: its key, n_words, runs (all of them by start, then period, words counted from 0) and collapsed, the
    words that no run contains after its own first `period` words, joined by one space. Words are `[^\\x20\\x09-\\x0D]+`,
    unchanged. A run is a stretch with smallest period q of at least four periods and six words that can't be extended.

    Null and empty texts have no word, no run and an empty result. Rows with null, equal or repeated keys stand for
    themselves; other columns are not looked at, whatever their names. Each text is worked on where it is read: nothing is
    shuffled, and a task holds a batch of texts and the numbers of about a megabyte of text or of one longer text.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_collapse, f"key {kind}, n_words long, runs array<{RUN}>, collapsed string").withColumnRenamed("key", key)
