"""Windows and folds over ordered events: loops, sessions, taint, admission, buckets."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from portcullis.operators.chunks import micros, running, sessions, with_recent

def loop_guard(calls: DataFrame, session: str, tool: list[str], seconds: int, limit: int) -> DataFrame:
    """H6: identical calls of a session in the last ``seconds``, both ends included; refused calls count too."""
    counted = with_recent(calls, [session, *tool], seconds, "identical", both_ends=True)
    return counted.withColumn("action", F.when(F.col("identical") > limit, "block").otherwise("allow"))


def session_cap(calls: DataFrame, session: str, cap: int, history: int = 256) -> DataFrame:
    """H7: the n-th call of a session, counted up to the length of the history."""
    numbered = running(calls, [session], ["ts", "event_id"], {"nth": (F.lit(1), "sum")}).withColumn("nth", F.least("nth", F.lit(history)).cast("int"))
    return numbered.withColumn("action", F.when(F.col("nth") > cap, "block").otherwise("allow"))


def taint(events: DataFrame, identity: str, untrusted: Column, ttl_seconds: int, own: bool) -> DataFrame:
    """K1: whether a session is tainted at an event: by the event itself too (``own``, chat), or only by
    those before it (tool calls). Taint ends with the session."""
    seen = running(sessions(events, identity, ttl_seconds), [identity, "session"], ["ts", "event_id"], {"tainted": (untrusted, "max")}, own)
    return seen.withColumn("tainted", F.coalesce("tainted", F.lit(False)))


def sliding_rate(events: DataFrame, identity: str, seconds: int, limit: int) -> DataFrame:
    """H3 without the gate: events in (t - seconds, t], the far end left out."""
    counted = with_recent(events, [identity], seconds, "recent", both_ends=False)
    return counted.withColumn("over", F.col("recent") > limit)


def in_turn(events: DataFrame, identity: str, order: list[str], schema: str, start: Callable[[], object], step: Callable[[object, dict], tuple]) -> DataFrame:
    """A fold over each identity's rows in their order: ``step`` gets the identity's state and a row and gives
    the row of the result. Rows are sorted by Spark (which spills), and a task holds one state at a time."""
    names = StructType.fromDDL(schema).names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if row[identity] != now:
                    now, state = row[identity], start()
                made.append(step(state, row))
            yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return events.repartition(identity).sortWithinPartitions(identity, *order).mapInArrow(run, schema)


def admissions(events: DataFrame, identity: str, seconds: int, limit: int) -> DataFrame:
    """H3: greedy admission; refused requests don't count against later ones. Returns (identity, ts, admitted)."""
    times = events.select(identity, micros().alias("t"), F.col("ts").cast("timestamp").alias("ts"))

    def step(live: deque, row: dict) -> tuple:
        while live and live[0] <= row["t"] - seconds * 1_000_000:
            live.popleft()
        admitted = len(live) < limit
        if admitted:
            live.append(row["t"])
        return row[identity], row["t"], admitted

    kind = events.schema[identity].dataType.simpleString()
    return in_turn(times, identity, ["t"], f"`{identity}` {kind}, t long, admitted boolean", deque, step).select(identity, F.timestamp_micros("t").alias("ts"), "admitted")


def call_history(calls: DataFrame, identity: str, tool: str, ttl_seconds: int, history: int = 256) -> DataFrame:
    """K2: at each call, itself counted, how many of the session the history holds (``calls``) and their tools in
    order (``recent``). A session ends after a longer gap than the ttl; its history keeps the latest only."""
    order = Window.partitionBy(identity, "session").orderBy("ts", "event_id").rowsBetween(1 - history, 0)
    kept = sessions(calls, identity, ttl_seconds)
    return kept.withColumns({"calls": F.count("*").over(order), "recent": F.array_join(F.collect_list(tool).over(order), ",")})


def usage(events: DataFrame, identity: str, cost: Column, unit: str) -> DataFrame:
    """Requests and cost in each aligned window (minute, hour, day) in UTC."""
    return events.groupBy(identity, F.date_trunc(unit, "ts").alias("bucket")).agg(F.count("*").alias("requests"), F.round(F.sum(cost), 6).alias("cost"))


def budget_order(events: DataFrame, identity: str, cost: Column, limit: float) -> DataFrame:
    """H5: what an identity used in its day before each event, and whether the event is refused: cost
    counts with the event itself and is refused above the limit."""
    days = events.withColumn("__day", F.to_date("ts"))
    spent = running(days, [identity, "__day"], ["ts", "event_id"], {"spent": (cost, "sum")}, width=3600).drop("__day")
    summed = spent.withColumn("spent", F.round("spent", 6))
    return summed.withColumn("refused", F.col("spent") > limit)


#: Steps of a time axis in milliseconds, from a second to thirty days.
STEPS = [1000, 5000, 15000, 60000, 300000, 900000, 1800000, 3600000, 10800000, 21600000, 43200000, 86400000, 604800000, 2592000000]


def bucket_step(first_ms: int, last_ms: int, most: int = 96) -> int:
    """H2: the smallest step that gives no more than ``most`` buckets."""
    return next((s for s in STEPS if (last_ms - first_ms) // s + 1 <= most), STEPS[-1])


def time_buckets(events: DataFrame, first_ms: int, last_ms: int, step: int, key: str) -> DataFrame:
    """H2: counts by bucket and key with zeros filled in; events out of the range are left out."""
    at = (F.floor(micros() / 1000 / step) * step).cast("long")
    counted = events.where(F.floor(micros() / 1000).between(first_ms, last_ms)).groupBy(at.alias("bucket_ms"), key).agg(F.count("*").alias("n"))
    every = F.sequence(F.lit(first_ms // step * step), F.lit(last_ms // step * step), F.lit(step)).cast("array<bigint>")
    spine = counted.select(key).distinct().withColumn("bucket_ms", F.explode(every))
    return spine.join(counted, ["bucket_ms", key], "left").withColumn("n", F.coalesce("n", F.lit(0)))
