"""Intermediate tables read more than once in a job: kept in memory or on executor disk, released together.

Persisted blocks carry their lineage, so a lost executor means recomputing its share and no more. A table that hundreds of
jobs read is written first: the driver remembers the whole plan of every job, and a written table's plan is its files.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame

from corpusgauge.session import work_folder

_kept: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """Persist a table that several parts of a plan read."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    _kept.append(kept)
    return kept


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Drop everything kept so far; call it when results have been written."""
    while _kept:
        _kept.pop().unpersist()
