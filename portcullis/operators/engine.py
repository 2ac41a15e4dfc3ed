"""Selection and merging of control decisions.

Decisions have a row for each request and control: ``request``, ``control_id``, ``priority``,
``action``, ``severity``, ``risk``, ``shadow`` (the control is in shadow mode), ``skipped``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.functions.columns import action_of, action_rank

STOPPERS = ("block", "require_approval")
# Outcomes that callers see.
STATUS = {"allow": 200, "flag": 200, "redact": 200, "require_approval": 403, "block": 403, "error": 502}


def select_controls(controls: DataFrame, levels: DataFrame, stage: Column, profile: Column) -> DataFrame:
    """Controls that are enabled for the profile and run in the stage, in the order (priority, id)."""
    return (
        controls.join(levels.where(F.col("profile") == profile), "control_id")
        .where(F.col("enabled") & F.array_contains("stages", stage))
        .withColumn("ordinal", F.row_number().over(Window.partitionBy("profile").orderBy("priority", "control_id")))
    )


def missing_controls(policy: DataFrame, registered: DataFrame) -> DataFrame:
    """Enabled in the policy, but not registered."""
    return policy.where("enabled").join(registered.select("control_id"), "control_id", "left_anti")


def changed_controls(old: DataFrame, new: DataFrame) -> DataFrame:
    """(control_id, change): ``removed`` controls of the old policy, ``added`` ones of the new."""
    names = lambda policy, mark: policy.select("control_id", F.lit(mark).alias("mark"))
    sides = names(old, "removed").unionByName(names(new, "added")).groupBy("control_id").agg(F.min("mark").alias("change"), F.max("mark").alias("other"))
    return sides.where("change = other").select("control_id", "change")


def suppressed() -> Column:
    """A control in shadow mode that would act."""
    return F.col("shadow") & ~F.col("skipped") & (F.col("action") != "allow")


def effective() -> Column:
    """The action that counts: shadow controls and skipped ones allow."""
    return F.when(suppressed() | F.col("skipped"), "allow").otherwise(F.col("action"))


def in_order(key: str = "request") -> Window:
    return Window.partitionBy(key).orderBy("priority", "control_id")


def running(decisions: DataFrame, key: str = "request") -> DataFrame:
    """The risk that each control sees from those before it, and whether it is reached at all.

    A block or an approval stops what follows; a redaction doesn't.
    """
    before = in_order(key).rowsBetween(Window.unboundedPreceding, -1)
    stops = effective().isin(*STOPPERS)
    return decisions.withColumns(
        {
            "seen_risk": F.coalesce(F.max("risk").over(before), F.lit(0.0)),
            "reached": ~F.coalesce(F.max(stops).over(before), F.lit(False)),
        }
    )


def merge(decisions: DataFrame, key: str = "request") -> DataFrame:
    """The strongest effective action, what it would be without shadow mode (only if
    stronger), and the first control with the final action."""
    rank, would = action_rank(effective()), action_rank(F.when(F.col("skipped"), "allow").otherwise(F.col("action")))
    ranked = decisions.withColumns({"__rank": rank, "__would": would})
    first = F.struct(-F.col("__rank"), "priority", "control_id")
    merged = ranked.groupBy(key).agg(F.max("__rank").alias("final"), F.max("__would").alias("would"), F.min(first).alias("first"), F.max("risk").alias("risk"))
    return merged.select(
        key,
        action_of(F.col("final")).alias("final_action"),
        F.when(F.col("would") > F.col("final"), action_of(F.col("would"))).alias("would_have_action"),
        F.when(F.col("final") > 0, F.col("first.control_id")).alias("blocking_control"),
        "risk",
    )


def roll_up(stages: DataFrame, key: str = "request", approved: Column | None = None) -> DataFrame:
    """A request's action over its stages; an approved stage no longer asks for approval."""
    approved = F.lit(False) if approved is None else approved
    action = F.when(approved & (F.col("final_action") == "require_approval"), "allow").otherwise(F.col("final_action"))
    return stages.groupBy(key).agg(action_of(F.max(action_rank(action))).alias("final_action"))


def status_of(action: Column, blocking: Column) -> Column:
    """HTTP status; a refused budget is 429, a failed sign-in 401."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv]), action)
    return F.when((action == "block") & (blocking == "C-BUDGET"), 429).when((action == "block") & (blocking == "C-AUTH"), 401).otherwise(known)


def latency_by_control(decisions: DataFrame, key: str = "request") -> DataFrame:
    """Milliseconds of each control, summed over stages."""
    return decisions.groupBy(key, "control_id").agg(F.round(F.sum("latency_ms"), 3).alias("latency_ms"))


def by_entry(acting: DataFrame, entries: dict[str, list[str]]) -> DataFrame:
    """(entry, requests, decisions): by entry of a taxonomy the requests that have a decision of one of its
    controls, and those decisions; a control that names an entry twice counts twice.

    The taxonomy is a configuration of some dozens of entries, a column for each. Rows are dealt by request before
    they are summed, so a task holds its own requests alone, each once and not once for each entry.
    """
    names = sorted({e for of in entries.values() for e in of})
    if not names:
        return acting.select(F.lit("").alias("entry"), F.lit(0).cast("long").alias("requests"), F.lit(0).cast("long").alias("decisions")).limit(0)
    times = lambda name: F.coalesce(*[F.when(F.col("control_id") == c, of.count(name)) for c, of in entries.items() if name in of], F.lit(0))
    mine = acting.where(F.col("control_id").isin([c for c, of in entries.items() if of])).repartition("request")
    summed = mine.groupBy("request").agg(*[F.sum(times(name)).alias(f"_{i}") for i, name in enumerate(names)])
    # A null request has decisions and is none.
    whole = summed.agg(*[F.struct(F.count_if((F.col(f"_{i}") > 0) & F.col("request").isNotNull()).alias("requests"), F.sum(f"_{i}").alias("decisions")).alias(f"_{i}") for i in range(len(names))])
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("entry"), F.col(f"_{i}.requests").alias("requests"), F.col(f"_{i}.decisions").alias("decisions")) for i, name in enumerate(names)]))
    return whole.select(rows.alias("r")).select("r.*").where("decisions > 0")


def on_error(action: Column, failed: Column, mode: Column) -> tuple[Column, Column]:
    """(action, skipped) of a control that failed: fail_open allows and counts as skipped, fail_closed blocks."""
    return (
        F.when(failed & (mode == "fail_closed"), "block").when(failed, "allow").otherwise(action),
        failed & (mode != "fail_closed"),
    )
