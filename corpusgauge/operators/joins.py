"""Joins that look up one row per key for a large table with crowded keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], sizes: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner join of `big` with `small` (one row per key), exact under any skew.

    `sizes` (keys, n) counts the rows of `big` per key. Keys above `hot_rows` are at most
    rows / hot_rows many, which bounds what is broadcast: their rows of `big` are joined where they
    are. Everything else is joined by shuffle, without the crowded keys in it. Without any crowded
    key this is a plain join (one small job on `sizes` finds out).
    """
    crowded = sizes.filter(F.col("n") > hot_rows).select(*keys)
    if crowded.isEmpty():
        return big.join(small, list(keys))
    hot = F.broadcast(crowded)
    in_place = big.join(F.broadcast(small.join(hot, list(keys), "left_semi")), list(keys))
    shuffled = big.join(hot, list(keys), "left_anti").join(small, list(keys))
    return in_place.unionByName(shuffled)
