"""Which version of a policy a request met (K5): versions swap at once, invalid ones never come into force."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.operators.chunks import WIDTH, running


def in_force(requests: DataFrame, versions: DataFrame, valid: Column | None = None, width: int = WIDTH) -> DataFrame:
    """``requests`` (ts, event_id, ...) with ``version``: the last valid one of ``versions`` (ts, version) at or before
    each; null before the first. Of versions of one time the greatest counts.

    Requests and versions are one sequence in time, cut into chunks: what is in force at a chunk's beginning is a row
    in front of it, so neither side is broadcast and no task holds more than a chunk.
    """
    one = F.lit(0).alias("_all")
    good = versions.where(F.coalesce(valid, F.lit(False))) if valid is not None else versions
    new = good.where("ts is not null").select(one, "ts", F.struct("ts", "version").alias("_new"), F.lit(False).alias("_asks"))
    asked = requests.select("*", one, F.lit(True).alias("_asks"))
    met = running(asked.unionByName(new, allowMissingColumns=True), ["_all"], ["ts", "_asks", "event_id"], {"_met": (F.col("_new"), "max")}, width=width)
    return met.where("_asks").select(*requests.columns, F.col("_met.version").alias("version"))
