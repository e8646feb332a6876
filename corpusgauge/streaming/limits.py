"""The sliding-window limiter on a stream, one small state per client key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusgauge.operators.limits import RESULT_SCHEMA, Window

#: Decisions that leave together.
ROWS_OUT = 20_000


def _in_time_order(batches: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """Times and ids of a key's requests of one micro-batch, 16 bytes each; the chunks themselves are let go one by one."""
    kept = [(pdf["at"].to_numpy(np.int64), pdf["event_id"].to_numpy(np.int64)) for pdf in batches]
    at, event = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.lexsort((event, at))
    return at[order], event[order]


def limit_stream(requests: DataFrame, limit: int, window_seconds: int, evict: bool = True) -> DataFrame:
    """One decision for every request (event_id, key, ts), however late it comes.

    Within a micro-batch requests are decided in time order. One that is older than what its key has seen in earlier batches
    is decided as if it came at that time: there is no watermark, so nothing is left out. State is the accepted
    times, at most `limit` per key, and the newest time; with `evict` a timer by the clock, set anew by each batch that has the
    key, removes it once the key has been quiet for the window. A key that comes back later starts with an empty window. Such a
    stream never runs out of batches: turn it off for availableNow triggers. Bound a micro-batch at the source (maxFilesPerTrigger,
    maxBytesPerTrigger): the times and ids of its share of one key are sorted together.
    """
    window_us = window_seconds * 1_000_000

    def decide(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits, newest = state.get if state.exists else ([], None)
        window = Window(limit, window_us, list(hits))
        times, events = _in_time_order(batches)
        if newest is not None:
            times = times.clip(min=newest)
        waits = window.offer_many(times)
        state.update(([int(x) for x in window.hits], int(times[-1])))
        if evict:
            state.setTimeoutDuration(window_seconds * 1000)
        for a in range(0, len(waits), ROWS_OUT):
            wait = pd.Series(waits[a : a + ROWS_OUT])
            yield pd.DataFrame(
                {
                    "event_id": events[a : a + ROWS_OUT],
                    "key": key[0],
                    "accepted": wait == 0,
                    "retry_after": wait.where(wait > 0).astype("Int32").to_numpy(dtype=object, na_value=None),
                }
            )

    timed = requests.withColumn("at", F.unix_micros("ts"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout
    return timed.groupBy("key").applyInPandasWithState(decide, RESULT_SCHEMA, "hits array<bigint>, newest bigint", "append", timeout)
