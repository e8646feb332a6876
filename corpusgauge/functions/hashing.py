"""Deterministic randomness: a value depends on (seed, key) and on nothing else.

The stable hash of a key is the first 64 bits of sha256("<seed>:<key>"), read as an unsigned
big-endian number. Its 16 hex digits sort like the number itself, so orderings use the text form
and only arithmetic needs digits turned into integers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MAX_MODULUS = 1 << 31


def stable_hex(key: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 16)


def stable_hash(key: Column, seed: int) -> Column:
    """The unsigned 64-bit value as DECIMAL(20,0); a BIGINT would flip its order."""
    return F.conv(stable_hex(key, seed), 16, 10).cast("decimal(20,0)")


def stable_mod(key: Column, seed: int, n: int) -> Column:
    """stable_hash % n in BIGINT arithmetic on the two 32-bit halves."""
    if not 0 < n <= _MAX_MODULUS:
        raise ValueError(f"modulus must be in 1..{_MAX_MODULUS}, got {n}")
    digits = stable_hex(key, seed)
    high = F.conv(F.substring(digits, 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(digits, 9, 8), 16, 10).cast("bigint")
    return ((high % n) * ((1 << 32) % n) + low) % n


def stable_uniform_int(key: Column, seed: int, low: int, high: int) -> Column:
    """Integer in [low, high], both ends included."""
    if low > high:
        raise ValueError(f"low ({low}) must be <= high ({high})")
    return F.lit(low).cast("bigint") + stable_mod(key, seed, high - low + 1)


def offline_quality(sha256: Column, seed: int = 42, low: int = 80, high: int = 95) -> Column:
    """Re-encoding quality drawn per file content."""
    return stable_uniform_int(sha256, seed, low, high)


def output_name(dataset: Column, split: Column, label: Column, sha256: Column, rel_path: Column) -> Column:
    """dataset/split/label/<sha16>_<path hash>.jpg: unique even when content repeats in a split."""
    suffix = F.lpad(stable_mod(rel_path, 0, 10**8).cast("string"), 8, "0")
    file = F.concat(F.substring(sha256, 1, 16), F.lit("_"), suffix, F.lit(".jpg"))
    return F.concat_ws("/", dataset, split, label, file)
