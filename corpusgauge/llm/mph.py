"""A minimal perfect hash over 64-bit keys: levels of bit arrays, built with numpy."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Places per key of a level.
LOAD = 2


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scrambles 64-bit values; other seeds give other, independent values."""
    with np.errstate(over="ignore"):
        x = x.astype(U) + U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class PerfectHash:
    """Places 0 .. n-1 for n distinct keys, about three bits each.

    In each level a key whose place no other key hits keeps it; the others go on to the next level. The place of a key is
    the number of bits set before its own. Keys outside the set get some place too, or none: compare fingerprints.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        bits = np.concatenate(levels) if levels else np.zeros(0, np.uint8)
        self.starts = np.cumsum([0, *[len(x) for x in levels]])
        self.bits, self.before = bits, np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, levels = keys.astype(U), []
        while len(keys):
            n = max(8, LOAD * len(keys))
            at = (mix(keys, len(levels)) % U(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(alone.astype(np.uint8))
            keys = keys[~alone[at]]
            if len(levels) > 64:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key; -1 if no level has one."""
        keys = keys.astype(U)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = (mix(keys[open_], k) % U(len(level))).astype(np.int64)
            hit = level[at] == 1
            out[open_[hit]] = self.before[self.starts[k] + at[hit]]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *[len(x) for x in self.levels]], "<i8").tobytes()
        return head + np.packbits(self.bits).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, "<i8", 1)[0])
        sizes = np.frombuffer(data, "<i8", n, 8)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 * (n + 1)), count=int(sizes.sum()))
        return cls(np.split(bits, np.cumsum(sizes)[:-1]) if n else [])


def fingerprints(keys: np.ndarray) -> np.ndarray:
    """32 bits of each key, independent of its place."""
    return (mix(keys, 1000) >> U(32)).astype(np.uint32)
