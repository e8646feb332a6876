"""Sliding-window request limits over a table of requests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as Over
from pyspark.sql import functions as F

RESULT_SCHEMA = "event_id bigint, key string, accepted boolean, retry_after int"


class Window:
    """Accepted times (microseconds) of one key, ascending, at most `limit` of them."""

    def __init__(self, limit: int, window_us: int, hits: list[int] | None = None) -> None:
        self.limit, self.window_us = limit, window_us
        self.hits = np.array(hits or [], dtype=np.int64)

    def offer_many(self, times: np.ndarray) -> np.ndarray:
        """Seconds to wait for each of the ascending times, 0 if accepted; rejected requests leave no trace.

        As many requests as there is room for are accepted at once; a full window rejects all until its oldest time has passed.
        """
        times = np.asarray(times, dtype=np.int64)
        waits = np.zeros(len(times), dtype=np.int64)
        i = 0
        while i < len(times):
            self.hits = self.hits[np.searchsorted(self.hits, times[i] - self.window_us, "right") :]
            room = self.limit - len(self.hits)
            if room > 0:
                self.hits = np.concatenate([self.hits, times[i : i + room]])
                i += room
                continue
            ends = self.hits[0] + self.window_us
            free = i + int(np.searchsorted(times[i:], ends))
            waits[i:free] = (ends - times[i:free]) // 1_000_000 + 1
            i = free
        return waits


def _islands(slots: DataFrame) -> DataFrame:
    """(key, starts) from (key, slots): first slots of all stretches of neighbouring slots, in lists of about the root of their number.

    `starts` is an array of (first, all) sorted by first, so that the stretch of a slot is found without walking through them all.
    Rows are one per key and stay where they are.
    """
    by_key = Over.partitionBy("key")
    each = slots.select("key", F.explode("slots").alias("slot"))
    begin = each.withColumn("before", F.lag("slot").over(by_key.orderBy("slot"))).filter("before is null or slot - before > 1")
    numbered = begin.withColumns({"nth": F.row_number().over(by_key.orderBy("slot")), "count": F.count(F.lit(1)).over(by_key)})
    lists = numbered.groupBy("key", F.floor((F.col("nth") - 1) / F.ceil(F.sqrt("count"))).alias("list")).agg(F.sort_array(F.collect_list("slot")).alias("all"))
    return lists.groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.col("all")[0].alias("first"), "all"))).alias("starts"))


def idle_sessions(requests: DataFrame, window_seconds: int) -> DataFrame:
    """Add `session`: a slot of time without a request empties a key's state, so what follows is independent.

    Time is cut into slots of one window. Where a slot is empty, two requests lie more than a window apart. A key's
    slots with requests are gathered first (one small row per key, folded map-side), their stretches are the sessions, and
    each request looks its own up: the requests are shuffled once for that, and a crowded key's share is split by AQE.
    """
    timed = requests.withColumn("at", F.unix_micros("ts")).withColumn("slot", F.floor(F.col("at") / (window_seconds * 1_000_000)))
    # a null key is a key of its own
    timed = timed.withColumnRenamed("key", "plain").withColumn("key", F.coalesce(F.concat(F.lit("="), "plain"), F.lit("")))
    islands = _islands(timed.groupBy("key").agg(F.collect_set("slot").alias("slots")))
    found = timed.join(islands, "key")
    nearest = F.element_at(F.filter("starts", lambda x: x["first"] <= F.col("slot")), -1)["all"]
    session = F.element_at(F.filter(nearest, lambda x: x <= F.col("slot")), -1)
    return found.withColumns({"session": session, "key": F.col("plain")}).drop("starts", "slot", "plain")


def sliding_rate_limit(requests: DataFrame, limit: int, window_seconds: int) -> DataFrame:
    """Decide every request (event_id, key, ts): accepted, or seconds to wait.

    Decisions depend on earlier decisions, so a busy stretch of one key is sequential by nature.
    Keys are cut at pauses into independent sessions; tasks walk sorted sessions batch by batch,
    hold no more than `limit` times, and jump over the rejections of a full window.
    """
    window_us = window_seconds * 1_000_000

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, Window(limit, window_us)
        for pdf in batches:
            if pdf.empty:
                continue
            keys, sessions, times = pdf["key"].to_numpy(), pdf["session"].to_numpy(), pdf["at"].to_numpy()
            turns = (keys[1:] != keys[:-1]) | (sessions[1:] != sessions[:-1])
            starts = [0, *(np.flatnonzero(turns) + 1), len(pdf)]
            waits = []
            for a, b in zip(starts, starts[1:], strict=False):
                if (keys[a], sessions[a]) != current:
                    current, state = (keys[a], sessions[a]), Window(limit, window_us)
                waits.append(state.offer_many(times[a:b]))
            wait = pd.Series(np.concatenate(waits), index=pdf.index)
            yield pd.DataFrame(
                {
                    "event_id": pdf["event_id"],
                    "key": pdf["key"],
                    "accepted": wait == 0,
                    "retry_after": wait.where(wait > 0).astype("Int32"),
                }
            )

    sessions = idle_sessions(requests, window_seconds).select("key", "session", "at", "event_id")
    ordered = sessions.repartition("key", "session").sortWithinPartitions("key", "session", "at", "event_id")
    return ordered.mapInPandas(walk, RESULT_SCHEMA)
