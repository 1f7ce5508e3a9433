"""T4: rate-limit windows on a stream, with state that timers close and remove."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grantlens.streaming.limits import MAX_HITS, WINDOW_SECONDS, _micros

#: Timers and several kinds of state for a key need this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ClosedWindows(StatefulProcessor):
    """Of each key the open window (start, hits) and the times that the watermark hasn't passed yet.

    Times behind the watermark are final and are counted in their order; later ones wait, since an earlier event may still come
    and begin another window. A timer at the open window's end, or where a window over the first waiting time would end,
    wakes keys that have no more events. What is left of a key after its last window is nothing.
    """

    def __init__(self, key: str, width: int, limit: int):
        self.key, self.width, self.limit = key, width, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start bigint, hits bigint")
        self.waiting = handle.getListState("waiting", "t bigint")

    def _advance(self, key: tuple, new: list[int], watermark_ms: int) -> Iterator[pd.DataFrame]:
        passed, closed = watermark_ms * 1000, []
        start, hits = self.open.get() if self.open.exists() else (None, 0)
        times = sorted([r[0] for r in self.waiting.get()] + new)
        ready = 0
        while ready < len(times) and times[ready] <= passed:
            t = times[ready]
            if start is None or t >= start + self.width:
                if start is not None:
                    closed.append((start, hits))
                start, hits = t, 0
            hits += 1
            ready += 1
        if start is not None and start + self.width <= passed:
            closed.append((start, hits))
            start, hits = None, 0
        rest = times[ready:]
        if start is None:
            self.open.clear()
        else:
            self.open.update((start, hits))
        if rest:
            self.waiting.put([(t,) for t in rest])
        else:
            self.waiting.clear()
        if start is not None or rest:
            end = (rest[0] if start is None else start) + self.width
            self.handle.registerTimer(max(end // 1000, watermark_ms + 1))
        if closed:
            yield pd.DataFrame({self.key: [key[0]] * len(closed), "start": [s for s, _ in closed], "hits": [n for _, n in closed], "n_blocked": [max(n - self.limit, 0) for _, n in closed]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = [int(t) for batch in rows for t in batch["t"].to_numpy()]
        yield from self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        yield from self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def use_timers(spark: SparkSession) -> None:
    """Streams that this session starts from now on keep their state in the store that timers need."""
    spark.conf.set(*STATE_STORE)


def closed_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = WINDOW_SECONDS, limit: int = MAX_HITS, watermark: str = "10 minutes") -> DataFrame:
    """T4 on a stream: (key, window_start, hits, n_blocked) of every window anchored at a key's first event, once it has ended.

    A window has ended when the watermark has passed its end; its state goes then. Events may come in any order within the
    watermark's delay, and the result is that of the batch job over the events that weren't late. An event behind the watermark
    is late: Spark drops it and counts it in numRowsDroppedByWatermark. Rows without key or time are left out. Start the query in a
    session that has called use_timers().
    """
    kind = dict(events.dtypes)[key]
    at = F.col(ts).cast("timestamp")
    timed = events.select(F.col(key), at.alias("at"), F.unix_micros(at).alias("t")).filter(F.col(key).isNotNull() & F.col("t").isNotNull()).withWatermark("at", watermark)
    found = timed.groupBy(key).transformWithStateInPandas(ClosedWindows(key, seconds * 1_000_000, limit), f"{key} {kind}, start bigint, hits bigint, n_blocked bigint", "Append", "EventTime")
    return found.select(key, _micros(F.timestamp_micros("start")).alias("window_start"), "hits", "n_blocked")
