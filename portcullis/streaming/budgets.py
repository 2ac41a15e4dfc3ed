"""Stateful processors with timers: accounts and call histories by identity (K2, K3, K9), equal to batch.

They need the state store that keeps timers (``RocksDBStateStoreProvider``) and a watermark on ``ts``. Within
a batch an identity's events are taken in the order of time. A timer ends an identity's state when the
watermark has passed all that it could still decide: state doesn't grow with the identities ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from portcullis.operators.budgets import DECISION, REQUEST, Account, Limits

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(batches: Iterator[pd.DataFrame]) -> list[dict]:
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    rows["t"] = rows["ts"].astype("datetime64[us]").astype("int64")
    return rows.astype(object).where(rows.notna(), None).to_dict("records")


class _Lasting(StatefulProcessor):
    """State of one value, with one timer: when it rings and no later event has moved it, the state ends."""

    state = "packed string, ends long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("kept", self.state)

    def keep(self, packed: str, ends_s: float) -> None:
        """Keep the state until ``ends_s``; the timer before that goes."""
        ends = int(ends_s * 1000) + 1
        if self.kept.exists():
            self.handle.deleteTimer(self.kept.get()[1])
        self.kept.update((packed, ends))
        self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.kept.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Budget(_Lasting):
    def __init__(self, limits: Limits):
        self.limits = limits

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        account = Account.unpacked(self.kept.get()[0]) if self.kept.exists() else Account()
        made = [account.request(row["t"] / 1e6, row, self.limits) for row in _rows(rows)]
        self.keep(account.packed(), account.lapses(self.limits))
        yield pd.DataFrame(made, columns=["event_id", "refused", "retry_after_s", "tokens", "cost"]).astype({"retry_after_s": "Int64"})


class _Calls(_Lasting):
    state = "calls array<struct<t:long,tool:string>>, ends long"

    def __init__(self, ttl: int, history: int):
        self.ttl, self.history = ttl, history

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        calls = [tuple(c) for c in self.kept.get()[0]] if self.kept.exists() else []
        made = []
        for row in _rows(rows):
            if calls and row["t"] - calls[-1][0] > self.ttl * 1_000_000:
                calls = []  # the session is over, whether or not its timer has rung
            calls = [*calls, (row["t"], row["tool"])][-self.history :]
            made.append((row["event_id"], len(calls), ",".join(tool for _, tool in calls if tool is not None)))
        self.keep(calls, calls[-1][0] / 1e6 + self.ttl)
        yield pd.DataFrame(made, columns=["event_id", "calls", "recent"])


def reservations(events: DataFrame, identity: str, limits: Limits, lateness: str = "1 minute") -> DataFrame:
    """``operators.budgets.reservations`` over a stream of ``identity``, event_id, ts and the request's fields."""
    rows = events.withWatermark("ts", lateness).select(identity, "event_id", "ts", *REQUEST)
    return rows.groupBy(identity).transformWithStateInPandas(_Budget(limits), DECISION, "append", "eventTime")


def call_history(events: DataFrame, identity: str, tool: str, ttl_seconds: int, history: int = 256, lateness: str = "1 minute") -> DataFrame:
    """K2: ``operators.state.call_history`` over a stream."""
    rows = events.withWatermark("ts", lateness).selectExpr(f"`{identity}`", "event_id", "ts", f"`{tool}` AS tool")
    return rows.groupBy(identity).transformWithStateInPandas(_Calls(ttl_seconds, history), "event_id long, calls long, recent string", "append", "eventTime")
