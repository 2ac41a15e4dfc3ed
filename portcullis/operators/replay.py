"""Replay of a candidate policy over stored decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portcullis.functions.columns import action_of, action_rank
from portcullis.operators.engine import effective


def replay(decisions: DataFrame, policy: DataFrame, key: str = "request", keep_flags: bool = False) -> DataFrame:
    """(request, original, candidate): a stored block, approval or redaction takes the candidate's action.

    Controls that the candidate lacks, disables or runs in shadow mode allow. Stored flags are left
    out unless ``keep_flags``: then a flag takes part like the others.
    """
    acted = ("block", "require_approval", "redact", *(("flag",) if keep_flags else ()))
    joined = decisions.join(policy.select("control_id", "enabled", F.col("shadow").alias("in_shadow"), F.col("action").alias("level")), "control_id", "left")
    fires = ~F.col("skipped") & F.col("action").isin(*acted) & F.coalesce(F.col("enabled") & ~F.col("in_shadow"), F.lit(False))
    new = F.when(fires, action_rank(F.col("level"))).otherwise(0)
    return joined.groupBy(key).agg(action_of(F.max(action_rank(effective()))).alias("original"), action_of(F.max(new)).alias("candidate"))


def last_requests(audit: DataFrame, n: int, key: str = "request_id") -> DataFrame:
    """The last ``n`` requests by time, of repeated ids the later."""
    later = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return audit.withColumn("__n", F.row_number().over(later)).where("__n = 1").drop("__n").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)
