"""Stored results: paging, ownership, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def history_page(history: DataFrame, user_id: int | str, limit: int = 20, offset: int = 0) -> DataFrame:
    """A user's rows, newest first, `limit` of them from `offset`, each with the user's `total`."""
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must be in 1..100 and offset not negative")
    mine = history.filter(F.col("user_id") == user_id)
    total = mine.agg(F.count(F.lit(1))).scalar()
    return mine.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset(offset).limit(limit).withColumn("total", total)


def owned_history(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of `wanted` (id, user_id) that belong to the asking user."""
    return history.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_semi")


def expire_images(history: DataFrame, cutoff: str) -> DataFrame:
    """Rows older than the cutoff lose their image and stay; `purged` marks them."""
    old = (F.col("created_at") < F.lit(cutoff).cast("timestamp")) & F.col("image_path").isNotNull()
    marked = history.withColumn("purged", old)
    return marked.withColumn("image_path", F.when(~F.col("purged"), F.col("image_path")))


def purge_count(expired: DataFrame) -> DataFrame:
    return expired.agg(F.count(F.when(F.col("purged"), 1)).alias("purged"))
