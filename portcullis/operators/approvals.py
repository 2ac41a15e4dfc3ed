"""Approvals as a fold over their events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIFE = 900


def states(events: DataFrame, life: int = LIFE) -> DataFrame:
    """The state of each approval: the first verdict is final; the first use after an approval counts.

    ``events`` has approval_id, ts (seconds), kind (request, approve, reject, consume), identity, fingerprint.
    """
    first = lambda kind, column: F.min(F.when(F.col("kind") == kind, F.col(column)))
    verdict = F.min_by(F.when(F.col("kind").isin("approve", "reject"), F.col("kind")), F.when(F.col("kind").isin("approve", "reject"), F.col("ts")))
    return events.groupBy("approval_id").agg(
        first("request", "ts").alias("created"), first("request", "identity").alias("identity"), first("request", "fingerprint").alias("fingerprint"),
        verdict.alias("verdict"), F.min(F.when(F.col("kind").isin("approve", "reject"), F.col("ts"))).alias("decided"),
    ).withColumn("expires", F.col("created") + life)


def consumptions(events: DataFrame, life: int = LIFE) -> DataFrame:
    """For each attempt to use an approval, why it is refused (the first reason), or ``ok``."""
    known = states(events, life).select("approval_id", F.col("identity").alias("owner"), F.col("fingerprint").alias("wanted"), "verdict", "decided", "expires", "created")
    tries = events.where("kind = 'consume'").join(known, "approval_id", "left")
    reason = (
        F.when(F.col("created").isNull(), "unknown")
        .when(F.col("verdict").isNull() | (F.col("decided") > F.col("ts")), "pending")
        .when(F.col("verdict") == "reject", "rejected")
        .when(F.col("ts") >= F.col("expires"), "expired")
        .when(~F.equal_null("identity", "owner"), "other_identity")
        .when(~F.equal_null("fingerprint", "wanted"), "other_request")
    )
    marked = tries.withColumn("__reason", reason)
    before = Window.partitionBy("approval_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.max(F.col("__reason").isNull()).over(before), F.lit(False))
    return marked.withColumn("outcome", F.coalesce("__reason", F.when(used, "used").otherwise("ok"))).select("approval_id", "ts", "outcome")


def listed(events: DataFrame, now: int, status: str | None = None, life: int = LIFE) -> DataFrame:
    """Approvals as they stand at ``now`` (pending, approved, rejected, expired, used), newest first, all or
    those of one status. Events after ``now`` haven't happened."""
    known = events.where(F.col("ts") <= now)
    used = consumptions(known, life).where("outcome = 'ok'").select("approval_id", F.lit(True).alias("used")).distinct()
    stands = states(known, life).where("created is not null").join(used, "approval_id", "left")
    over = F.col("expires") <= now
    status_of = F.when(F.col("used"), "used").when(F.col("verdict") == "reject", "rejected").when(over, "expired").when(F.col("verdict") == "approve", "approved").otherwise("pending")
    found = stands.withColumn("status", status_of)
    return (found if status is None else found.where(F.col("status") == status)).orderBy(F.col("created").desc(), "approval_id")


def waiting(events: DataFrame, now: int, life: int = LIFE) -> DataFrame:
    """Pending approvals, newest first."""
    return listed(events, now, "pending", life)
