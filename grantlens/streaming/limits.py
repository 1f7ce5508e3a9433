"""Per-key rate limits and session rules, in batch and on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from grantlens.session import durable

# The service's own settings; every job takes them as parameters.
WINDOW_SECONDS, MAX_HITS = 15 * 60, 40
SESSION_SECONDS, MAX_USES = 15 * 60, 10
ROUTE_LIMIT, OVERALL_LIMIT = 10, 100


def _micros(ts):
    """Microseconds since 1970 by the calendar fields, the same for both timestamp types."""
    t = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(t), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = (days * 24 + F.hour(t)) * 60 + F.minute(t)
    return seconds * 60_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("bigint")


def _slots(events: DataFrame, width: int) -> DataFrame:
    """One row per (k, slot) with events: first and last time, and whether the first one is a start because a whole window before it is empty.

    `starts_1` and `starts_2`, `lo_2` say the same of the next two slots: null where they are empty. Slots are as wide as a
    window, so events less than a window apart are in the same slot or in neighbouring ones.
    """
    slots = events.groupBy("k", "slot").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by_time = Window.partitionBy("k").orderBy("slot")
    near = F.lag("slot").over(by_time) == F.col("slot") - 1
    slots = slots.withColumn("starts", ~F.coalesce(near & (F.col("lo") - F.lag("hi").over(by_time) < width), F.lit(False)))

    def ahead(column: str, n: int) -> Column:
        """A column of the slot n further, which is among the next n rows if it isn't empty."""
        return F.coalesce(*[F.when(F.lead("slot", i).over(by_time) == F.col("slot") + n, F.lead(column, i).over(by_time)) for i in range(1, n + 1)])

    return slots.select("k", "slot", "lo", "starts", ahead("starts", 1).alias("starts_1"), ahead("starts", 2).alias("starts_2"), ahead("lo", 2).alias("lo_2"))


def next_starts(times: DataFrame, slots: DataFrame, width: int) -> DataFrame:
    """(k, t, to): where the next window of the key would start if one started at t; no row where an empty window comes before that.

    A range lookup: the wanted time lies in the next slot, where it is sorted among the events. Where none
    follows it there, the first event of the slot after that is the next one.
    """
    asked = times.select("k", (F.col("slot") + 1).alias("slot"), (F.col("t") + width).alias("x"), F.col("t").alias("t"))
    held = times.select("k", "slot", F.col("t").alias("x"), F.lit(None).cast("long").alias("t"))
    ahead = Window.partitionBy("k", "slot").orderBy("x").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    found = asked.unionByName(held).withColumn("hit", F.min(F.when(F.col("t").isNull(), F.col("x"))).over(ahead)).filter("t is not null").dropDuplicates(["k", "slot", "t"])
    joined = found.select("k", (F.col("slot") - 1).alias("slot"), "t", "hit").join(slots, ["k", "slot"])
    later = F.when(~F.coalesce("starts_2", F.lit(True)), F.col("lo_2"))
    return joined.select("k", "t", F.when(F.coalesce("starts_1", F.lit(True)), None).otherwise(F.coalesce("hit", later)).alias("to")).filter("to is not null")


def window_starts(events: DataFrame, width: int) -> DataFrame:
    """(k, s): the starts of all windows of every key, from rows (k, slot, t). At most one start lies in a slot.

    Starts follow each other by next_starts(). Those after an empty window are known; the others are found by
    pointer doubling: the i-th table points 2 ** i windows ahead, and following the tables from the widest to the first
    reaches every start. Tables grow in number with the logarithm of the most windows without a gap,
    and a key of any length is dealt by (k, t).
    """
    slots = durable(_slots(events, width))
    tables = [durable(next_starts(events.select("k", "slot", "t"), slots, width))]
    while not tables[-1].isEmpty():
        last = tables[-1]
        onward = last.select(F.col("k").alias("k2"), F.col("t").alias("t2"), F.col("to").alias("further"))
        tables.append(durable(last.join(onward, (F.col("to") == F.col("t2")) & (F.col("k") == F.col("k2"))).select("k", "t", F.col("further").alias("to"))))
    starts = slots.filter("starts").select("k", F.col("lo").alias("s"))
    for jumps in reversed(tables[:-1]):
        starts = starts.join(jumps.withColumnRenamed("t", "s"), ["k", "s"], "left").select("k", F.explode(F.array_compact(F.array("s", "to"))).alias("s"))
    return starts


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = WINDOW_SECONDS, limit: int = MAX_HITS) -> DataFrame:
    """Windows anchored at a key's first event; events beyond `limit` in one are blocked.

    Event and window are in one slot or in neighbouring ones, so each event meets its slot's row alone, and hits are
    ranks within a window: a key that never pauses is spread over its slots. Rows without key or time have no
    window and are left out.
    """
    width = seconds * 1_000_000
    timed = events.select("event_id", F.col(key).alias("k"), _micros(ts).alias("t")).filter("k is not null and t is not null")
    timed = timed.withColumn("slot", F.floor(F.col("t") / width))
    at, none = F.floor(F.col("s") / width), F.lit(None).cast("long")
    both = window_starts(timed, width).select("k", F.inline(F.array(
        F.struct(at.alias("slot"), F.col("s").alias("own"), none.alias("earlier")), F.struct((at + 1).alias("slot"), none.alias("own"), F.col("s").alias("earlier")))))
    of_slot = both.groupBy("k", "slot").agg(F.max("own").alias("own"), F.max("earlier").alias("earlier"))
    placed = timed.join(of_slot, ["k", "slot"]).withColumn("window_start", F.when(F.col("t") >= F.col("own"), F.col("own")).otherwise(F.col("earlier")))
    hits = F.row_number().over(Window.partitionBy("k", "window_start").orderBy("t", "event_id"))
    return placed.select("event_id", F.col("k").alias(key), "window_start", hits.alias("hits")).withColumn("is_blocked", F.col("hits") > limit)


def route_limits(events: DataFrame, keys: list[str], ts: str = "ts", window: str = "15 minutes", limit: int = ROUTE_LIMIT, watermark: str | None = None) -> DataFrame:
    """Clock-aligned windows per key; with a watermark the same job runs on a stream (T4: state expires with it)."""
    source = events.withWatermark(ts, watermark) if watermark else events
    counted = source.groupBy(F.window(ts, window), *keys).agg(F.count(F.lit(1)).alias("hits"))
    return counted.select(_micros(F.col("window.start")).alias("window_start"), *keys, "hits", F.greatest(F.col("hits") - limit, F.lit(0)).alias("n_blocked"))


def session_validity(requests: DataFrame, sessions: DataFrame, seconds: int = SESSION_SECONDS, max_uses: int = MAX_USES) -> DataFrame:
    """Unknown / invalid / limit / ok for every request (request_id, token, ip, ts).

    The first bad attempt of a token ends its session, and its first `max_uses` good requests
    are a top-k per token: both shrink before the shuffle, so no token is sorted whole.
    """
    known = requests.join(sessions.select("token", F.col("ip").alias("s_ip"), "issued_at"), "token", "left")
    end = F.col("issued_at") + F.make_dt_interval(secs=F.lit(seconds))
    bad = F.col("issued_at").isNotNull() & ((F.col("ts") >= end) | (F.col("ip") != F.col("s_ip")))
    order = F.struct("ts", "request_id")
    judged = known.select("request_id", "token", "ts", F.col("issued_at").isNotNull().alias("known"), F.coalesce(bad, F.lit(False)).alias("bad"))
    first_bad = judged.filter("bad").groupBy("token").agg(F.min(order).alias("ended"))
    alive = judged.join(first_bad, "token", "left").withColumn("alive", F.col("known") & (F.col("ended").isNull() | (order < F.col("ended"))))
    ranked = alive.filter("alive").withColumn("use", F.row_number().over(Window.partitionBy("token").orderBy("ts", "request_id"))).filter(F.col("use") <= max_uses)
    granted = ranked.select("request_id", F.lit(True).alias("granted"))
    return alive.join(granted, "request_id", "left").select(
        "request_id", "token", F.when(~F.col("known"), "unknown").when(~F.col("alive"), "invalid").when(F.col("granted"), "ok").otherwise("limit").alias("verdict"))


def stream_rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", seconds: int = WINDOW_SECONDS, limit: int = MAX_HITS,
                      watermark: str = "10 minutes") -> DataFrame:
    """T1 and T4 on a stream: one (window start, count) per key, dropped once the window has passed.

    Input must arrive in event-time order per key, as a request log does.
    """
    width = seconds * 1_000_000
    kind = dict(events.dtypes)[key]

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        for batch in batches:
            batch = batch.sort_values(["_t", "event_id"])
            starts, counts = [], []
            for t in batch["_t"].to_numpy():
                if start is None or t >= start + width:
                    start, count = int(t), 0
                count += 1
                starts.append(start)
                counts.append(count)
            yield pd.DataFrame({"event_id": batch["event_id"], key: batch[key], "window_start": starts, "hits": counts, "is_blocked": [c > limit for c in counts]})
        if start is not None:
            state.update((int(start), int(count)))
            state.setTimeoutTimestamp(max((start + width) // 1000, state.getCurrentWatermarkMs() + 1))

    timed = events.select("event_id", key, ts).withColumn("_t", _micros(ts)).withWatermark(ts, watermark)
    return timed.groupBy(key).applyInPandasWithState(
        step, f"event_id bigint, {key} {kind}, window_start bigint, hits int, is_blocked boolean", "start bigint, hits int", "append", GroupStateTimeout.EventTimeTimeout)
