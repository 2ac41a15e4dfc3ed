"""The registry of controls, and requests run through them.

A control is a function ``(segments, params) -> decisions``: segments have request, segment, text, norm,
origin, trust; decisions have request, action, severity, risk, reason, at most one row for a request.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portcullis.functions.columns import is_english, is_prose
from portcullis.operators import detectors, signatures
from portcullis.operators.engine import merge


@dataclass(frozen=True)
class Control:
    control_id: str
    stages: tuple[str, ...]
    priority: int
    transform: Callable[[DataFrame, dict], DataFrame]


REGISTRY: dict[str, Control] = {}


def control(control_id: str, stages: tuple[str, ...], priority: int):
    """L2: add a control; an id that is taken is an error."""

    def add(transform: Callable[[DataFrame, dict], DataFrame]) -> Callable[[DataFrame, dict], DataFrame]:
        if control_id in REGISTRY:
            raise ValueError(f"control {control_id} is registered twice")
        REGISTRY[control_id] = Control(control_id, stages, priority, transform)
        return transform

    return add


def _decision(found: DataFrame, action: Column, severity: Column, risk: Column, reason: Column) -> DataFrame:
    return found.select("request", action.alias("action"), severity.alias("severity"), risk.cast("double").alias("risk"), reason.alias("reason"))


@control("C-SIZE", ("ingress", "input"), 20)
def size(segments: DataFrame, params: dict) -> DataFrame:
    """The first limit that a request breaks."""
    sized = segments.groupBy("request").agg(F.count("*").alias("n"), F.max(F.length("text")).alias("longest"))
    reason = F.when(F.col("n") > params.get("messages", 200), "max_messages").when(F.col("longest") > params.get("chars", 100_000), "max_chars")
    broken = sized.withColumn("reason", reason).where("reason is not null")
    return _decision(broken, F.lit("block"), F.lit("medium"), F.lit(0.0), F.col("reason"))


@control("C-PII-OUT", ("output", "tool_result", "input"), 30)
def personal_data(segments: DataFrame, params: dict) -> DataFrame:
    """The profile's action where the detectors find something."""
    found = segments.withColumn("n", F.size(detectors.matches(F.col("text"), params.get("types", detectors.OUTBOUND)))).where("n > 0")
    summed = found.groupBy("request").agg(F.sum("n").alias("n"))
    return _decision(summed, F.lit(params.get("action", "redact")), F.lit("high"), F.lit(0.0), F.concat(F.col("n").cast("string"), F.lit(" matches")))


@control("C-SECRET-OUT", ("output", "tool_result", "input"), 32)
def secrets(segments: DataFrame, params: dict) -> DataFrame:
    """A secret that is encoded has no place in the text to redact, so it blocks."""
    number = lambda t: F.size(detectors.matches(t, list(detectors.SECRETS), detectors.SECRETS))
    hidden = F.aggregate("decoded", F.lit(0), lambda n, d: n + number(d["text"])) if "decoded" in segments.columns else F.lit(0)
    found = segments.withColumns({"n": number(F.col("text")), "hidden": F.coalesce(hidden, F.lit(0))}).where("n + hidden > 0")
    summed = found.groupBy("request").agg(F.sum(F.col("n") + F.col("hidden")).alias("n"), F.max("hidden").alias("hidden"))
    action = F.when(F.col("hidden") > 0, "block").otherwise(params.get("action", "redact"))
    return _decision(summed, action, F.lit("critical"), F.lit(0.0), F.concat(F.col("n").cast("string"), F.lit(" matches")))


@control("C-CODE-EXEC", ("tool_call", "output"), 35)
def code(segments: DataFrame, params: dict) -> DataFrame:
    """E16."""
    found = signatures.code_execution(segments, "request", params.get("feed", ()))
    return _decision(found, F.lit(params.get("action", "block")), F.lit("critical"), F.lit(1.0), F.array_join("families", ", "))


@control("C-INJ-PAT", ("input", "tool_result"), 22)
def injection_patterns(segments: DataFrame, params: dict) -> DataFrame:
    """E5."""
    found = signatures.pattern_control(segments, "request", params["signatures"], params.get("least", "low"))
    return found.select("request", F.when(F.col("action") == "block", params.get("action", "block")).otherwise("allow").alias("action"), "severity", "risk", "reason")


@control("C-CANARY", ("output", "tool_call"), 40)
def canaries(segments: DataFrame, params: dict) -> DataFrame:
    """E14."""
    found = signatures.canary(segments, params.get("tokens", [])).select("request").distinct()
    return _decision(found, F.lit("block"), F.lit("critical"), F.lit(1.0), F.lit("canary"))


def run(segments: DataFrame, stage: str, policy: dict[str, dict]) -> DataFrame:
    """The decisions of all controls that the policy has for the stage, in one table.

    ``policy`` has each control's parameters; ``shadow`` among them puts it in shadow mode.
    """
    chosen = sorted((c for c in REGISTRY.values() if c.control_id in policy and stage in c.stages), key=lambda c: (c.priority, c.control_id))
    unknown = policy.keys() - REGISTRY.keys()
    if unknown:
        raise ValueError(f"controls in the policy that don't exist: {sorted(unknown)}")
    parts = [
        c.transform(segments, policy[c.control_id]).withColumns(
            {"control_id": F.lit(c.control_id), "priority": F.lit(c.priority), "shadow": F.lit(bool(policy[c.control_id].get("shadow"))), "skipped": F.lit(False)}
        )
        for c in chosen
    ]
    return reduce(DataFrame.unionByName, parts)


def outcomes(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Every request's merged action; requests without a decision are allowed."""
    requests = segments.select("request").distinct()
    return requests.join(merge(decisions), "request", "left").withColumn("final_action", F.coalesce("final_action", F.lit("allow")))


def classifier_gate(segments: DataFrame, score: Column, block: float, grey: float, other_languages: str = "skip", corroborate: bool = True, least_risk: float = 0.3) -> DataFrame:
    """What a score means: texts that are no prose or not English are skipped (or passed on), and a
    block needs other evidence (``seen_risk``) or is held back with risk 0.8."""
    language = F.when(is_english(F.col("text")), "classify").otherwise(other_languages)
    banded = F.when(score >= block, "block").when(score >= grey, "grey").otherwise("clean")
    held = F.lit(corroborate) & (banded == "block") & (F.col("seen_risk") < least_risk)
    outcome = F.when(~is_prose(F.col("text")) | (language == "skip"), "skipped").when(language == "escalate", "grey").when(held, "held").otherwise(banded)
    return segments.withColumn("outcome", outcome).withColumn("risk", F.when(F.col("outcome") == "held", 0.8).when(F.col("outcome") == "grey", 0.5).otherwise(0.0))


def judged(segments: DataFrame, verdicts: DataFrame, threshold: float, low: float = 0.15, high: float = 0.85, cap: int = 3) -> DataFrame:
    """The judge's best score over a request's candidates; untrusted texts and those of middling
    risk are candidates, ``cap`` of them. A request whose judges all failed is blocked if its risk is 0.8."""
    gate = (F.col("trust") == "untrusted") | F.col("risk").between(low, high)
    order = Window.partitionBy("request").orderBy((F.col("trust") == "untrusted").desc(), F.col("segment").desc())
    asked = segments.where(gate).withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
    scored = asked.join(verdicts, ["request", "segment"], "left").groupBy("request").agg(F.max("score").alias("score"), F.max("risk").alias("risk"))
    action = F.when(F.col("score") >= threshold, "block").when(F.col("score").isNull() & (F.col("risk") >= 0.8), "block").otherwise("allow")
    return scored.withColumn("action", action)
