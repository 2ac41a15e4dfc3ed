"""Streaming twins of loop guard, taint and admission (K1-K3, K9): state by key, the same results as batch.

Events of one key are taken in the order of time within each batch. A key's state ends when the watermark
has passed all that it could still decide. Lateness is ours to choose: the source of these semantics has
no event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY, LATENESS = 256, "1 minute"


def _ordered(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")


def _until(state: GroupState, last_us: int, seconds: int) -> None:
    """The state ends when the watermark is past ``seconds`` after the last event."""
    state.setTimeoutTimestamp(max((last_us // 1_000_000 + seconds + 1) * 1000, state.getCurrentWatermarkMs() + 1))


def loop_guard(events: DataFrame, seconds: int, limit: int, lateness: str = LATENESS) -> DataFrame:
    """H6 by (user_id, event_type): the times of the calls in the window are the state."""

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches)
        times = list(state.get[0]) if state.exists else []
        counts = []
        for t in rows["ts"].astype("int64") // 1000:
            times = [x for x in times if x >= t - seconds * 1_000_000] + [int(t)]
            counts.append(len(times))
        state.update((times[-HISTORY:] if limit < HISTORY else times,))
        _until(state, times[-1], seconds)
        yield pd.DataFrame({"event_id": rows["event_id"], "identical": counts, "action": ["block" if n > limit else "allow" for n in counts]})

    return events.withWatermark("ts", lateness).groupBy("user_id", "event_type").applyInPandasWithState(step, "event_id long, identical long, action string", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def taint(events: DataFrame, ttl_seconds: int, bad: str = "error", lateness: str = LATENESS) -> DataFrame:
    """K1 by user: whether the session was tainted before each event, sticky until the session ends."""

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches)
        tainted, last = state.get if state.exists else (False, None)
        seen = []
        for t, kind in zip(rows["ts"].astype("int64") // 1000, rows["event_type"], strict=True):
            if last is not None and t - last > ttl_seconds * 1_000_000:
                tainted = False
            seen.append(tainted)
            tainted, last = tainted or kind == bad, int(t)
        state.update((tainted, last))
        _until(state, last, ttl_seconds)
        yield pd.DataFrame({"event_id": rows["event_id"], "tool_tainted": seen})

    return events.withWatermark("ts", lateness).groupBy("user_id").applyInPandasWithState(step, "event_id long, tool_tainted boolean", "tainted boolean, last long", "append", GroupStateTimeout.EventTimeTimeout)


def admissions(events: DataFrame, seconds: int, limit: int, lateness: str = LATENESS) -> DataFrame:
    """H3, K3 by user: greedy admission; the last admitted times are the state, ``limit`` at most."""

    def step(key, batches, state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = _ordered(batches)
        live = list(state.get[0]) if state.exists else []
        admitted = []
        for t in rows["ts"].astype("int64") // 1000:
            live = [x for x in live if x > t - seconds * 1_000_000]
            admitted.append(len(live) < limit)
            if admitted[-1]:
                live.append(int(t))
        state.update((live,))
        _until(state, int(t), seconds)
        yield pd.DataFrame({"event_id": rows["event_id"], "admitted": admitted})

    return events.withWatermark("ts", lateness).groupBy("user_id").applyInPandasWithState(step, "event_id long, admitted boolean", "live array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def usage(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Requests and cost in each user's day, final when the watermark has passed it."""
    from pyspark.sql import functions as F

    windows = events.withWatermark("ts", lateness).groupBy("user_id", F.window("ts", "1 day"))
    return windows.agg(F.count("*").alias("requests"), F.round(F.sum("value"), 6).alias("cost")).select("user_id", F.col("window.start").alias("bucket"), "requests", "cost")
