"""Words of whole texts as 64-bit names, found on the bytes of an Arrow column with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from corpusgauge.llm.mph import mix

U = np.uint64
#: Odd factors of the polynomial names of words and of word sequences.
BYTE_BASE, WORD_BASE, WORD_BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Bytes of text that are worked on at once; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: One table of powers per base, which grows; a larger one than this is made for one use and not kept.
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
KEPT_POWERS = (1 << 20) + 1


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^(n-1) modulo 2^64, and their inverses."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = n if n > KEPT_POWERS else min(KEPT_POWERS, 1 << max(10, (n - 1).bit_length()))
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, U), np.full(size, pow(base, -1, 1 << 64), U)
            up[0] = down[0] = 1
            have = np.cumprod(up), np.cumprod(down)
        if size <= KEPT_POWERS:
            _POWERS[base] = have
    return have[0][:n], have[1][:n]


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A name of values[start:end] for each pair: its polynomial modulo 2^64. Equal sequences have equal names wherever they stand."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = powers(base, len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U), np.cumsum(values.astype(U) * up[:-1])])
        return (total[ends] - total[starts]) * down[starts]


def chunks(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, names of all words, where each text's words begin and the last ones' end) of chunks of a column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, n)
        buf, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        names, starts = _names(_LOWER[buf] if lower else buf, at)
        yield a, names, np.searchsorted(starts, at)
        a = b


def _names(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    seen = ~_BLANK[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = seen[:-1], seen[1:]
    before[at[:-1][at[:-1] < len(buf)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(seen & ~before), np.flatnonzero(seen & ~after) + 1
    with np.errstate(over="ignore"):
        raw = spans(buf.astype(U) + U(1), starts, ends, BYTE_BASE)
        return mix(raw + (ends - starts).astype(U) * U(WORD_BASE_2)), starts
