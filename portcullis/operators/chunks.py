"""Running aggregates over an identity's events that spread a busy identity over tasks.

A window over an identity's events keeps that identity in one task. Here its events are cut into chunks
of time, each chunk is a group of its own, and what crosses chunks is a summary: one row for each chunk.
The summaries are scanned in the order of time, and what the chunks before one came to is put in front of
it as a row of its own, so a window over the chunk goes on from there. Rows are shuffled by (identity,
chunk) and met by no join; null identities are one identity like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a chunk.
WIDTH = 86_400

AGGREGATES = {"sum": F.sum, "max": F.max}


def micros(ts: str = "ts") -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def chunk_of(seconds: int) -> Column:
    return F.floor(micros() / (seconds * 1_000_000))


def _in_front(rows: DataFrame, front: DataFrame) -> DataFrame:
    """``rows`` and the rows ``front`` (identity, ``_chunk`` and carried columns), which sort before them."""
    return rows.withColumn("_own", F.lit(True)).unionByName(front.withColumn("_own", F.lit(False)), allowMissingColumns=True)


def running(events: DataFrame, keys: list[str], order: list[str], made: dict[str, tuple[Column, str]], own: bool = True, width: int = WIDTH) -> DataFrame:
    """``events`` with running aggregates of each key: name -> (value, ``sum`` or ``max``), with the row's own
    value or (not ``own``) without it; null where there is nothing yet. ``order`` begins with ``ts``."""
    rows = events.withColumns({"_chunk": chunk_of(width)} | {f"_v{i}": value for i, (value, _) in enumerate(made.values())})
    kinds = [AGGREGATES[kind] for _, kind in made.values()]
    names = [f"_v{i}" for i in range(len(made))]
    totals = rows.groupBy(*keys, "_chunk").agg(*[a(n).alias(n) for a, n in zip(kinds, names, strict=True)])
    # A chunk's total goes to the next chunk that the key has.
    later = Window.partitionBy(*keys).orderBy("_chunk")
    front = totals.select(*keys, F.lead("_chunk").over(later).alias("_next"), *[a(n).over(later).alias(n) for a, n in zip(kinds, names, strict=True)]).where("_next is not null").withColumnRenamed("_next", "_chunk")
    inside = Window.partitionBy(*keys, "_chunk").orderBy("_own", *order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    done = _in_front(rows, front).select("*", *[a(n).over(inside).alias(name) for a, n, name in zip(kinds, names, made, strict=True)])
    return done.where("_own").drop("_own", "_chunk", *names)


def sessions(events: DataFrame, identity: str, ttl_seconds: int, width: int = WIDTH) -> DataFrame:
    """H8: ``session`` numbers; a gap longer than the ttl starts a new one, a gap of just the ttl doesn't."""
    rows = events.withColumns({"_chunk": chunk_of(width), "_t": micros()})
    slim = rows.select(identity, "_chunk", "_t")
    new = lambda w: F.coalesce((F.col("_t") - F.lag("_t").over(w) > ttl_seconds * 1_000_000).cast("long"), F.lit(0))
    # Of each chunk: its ends, and the sessions that begin in it behind its first event.
    begun = slim.withColumn("_new", new(Window.partitionBy(identity, "_chunk").orderBy("_t"))).groupBy(identity, "_chunk").agg(F.min("_t").alias("first"), F.max("_t").alias("_t"), F.sum("_new").alias("n"))
    later = Window.partitionBy(identity).orderBy("_chunk")
    gap = F.coalesce((F.col("first") - F.lag("_t").over(later) > ttl_seconds * 1_000_000).cast("long"), F.lit(1))
    # In front of a chunk: the last event before it, and the sessions up to that one.
    front = begun.withColumn("n", F.col("n") + gap).select(identity, F.lead("_chunk").over(later).alias("_chunk"), "_t", F.sum("n").over(later).alias("_new")).where("_chunk is not null")
    whole = _in_front(rows, front)
    order = Window.partitionBy(identity, "_chunk").orderBy("_own", "_t", "event_id")
    counted = whole.withColumn("_new", F.coalesce("_new", (F.col("_t") - F.lag("_t").over(order) > ttl_seconds * 1_000_000).cast("long"), F.lit(1)))
    return counted.withColumn("session", F.sum("_new").over(order)).where("_own").drop("_own", "_chunk", "_t", "_new")


def with_recent(events: DataFrame, keys: list[str], seconds: int, name: str, both_ends: bool, width: int = WIDTH) -> DataFrame:
    """``events`` with the number of a key's events in the last ``seconds``, itself counted: from t - seconds on
    if ``both_ends``, else after it. What that looks at lies in the event's chunk and the one before, which an
    event's time alone also stands in."""
    width = max(width, seconds + 1)
    rows = events.withColumns({"_chunk": chunk_of(width), "_t": micros()})
    halo = rows.select(*keys, (F.col("_chunk") + 1).alias("_chunk"), "_t")
    near = Window.partitionBy(*keys, "_chunk").orderBy("_t").rangeBetween(-seconds * 1_000_000 + (0 if both_ends else 1), 0)
    return _in_front(rows, halo).withColumn(name, F.count(F.lit(1)).over(near)).where("_own").drop("_own", "_chunk", "_t")
