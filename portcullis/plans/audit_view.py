"""The events table as an audit log, and the small dimensions of the queries: one source for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.functions.columns import ACTIONS
from portcullis.sources.tables import table

ACTION_OF = {"view": "allow", "click": "flag", "signup": "redact", "purchase": "require_approval", "error": "block"}
SEVERITY_OF = {"view": "low", "click": "low", "signup": "medium", "purchase": "high", "error": "critical"}
#: (control, priority, every nth event decides, phase, severity)
CONTROLS = [
    ("C-MODEL-ALLOW", 10, 2, 0, "medium"),
    ("C-SIZE", 20, 3, 1, "low"),
    ("C-INJ-PAT", 22, 2, 1, "high"),
    ("C-SIG", 25, 5, 2, "medium"),
    ("C-TAINT", 40, 7, 3, "critical"),
    ("C-INJ-SEM", 500, 4, 0, "high"),
]
#: control -> threats, threat -> taxonomy entries
THREATS = {"C-MODEL-ALLOW": ["TH-10"], "C-SIZE": ["TH-11"], "C-INJ-PAT": ["TH-01", "TH-02"], "C-SIG": ["TH-02"], "C-TAINT": ["TH-06"], "C-INJ-SEM": ["TH-01"]}
TAXONOMY = {"TH-01": ["LLM01:2025", "ASI01"], "TH-02": ["LLM01:2025", "ASI01", "ASI06"], "TH-06": ["ASI02"], "TH-11": ["LLM10:2025"]}
NOW = "2024-01-31 00:00:00"


def values(rows: list[tuple]) -> str:
    """SQL VALUES of Python rows, the same in both engines."""
    text = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def _case(column: str, of: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


AUDIT_SQL = f"""audit AS (
  SELECT event_id, ts, CAST(user_id AS VARCHAR) AS identity, event_type AS endpoint, {_case("event_type", ACTION_OF)} AS final_action,
         {_case("event_type", SEVERITY_OF)} AS severity, value AS overhead_ms, event_type <> 'error' AS upstream_called, event_id % 11 = 0 AS shadow
  FROM events)"""
DECISIONS_SQL = f"""controls(control_id, priority, every, phase, severity) AS ({values(CONTROLS)}),
decisions AS (
  SELECT e.event_id AS request, e.ts, c.control_id, c.priority, c.severity,
         CASE (e.event_id + c.priority) % 5 {" ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS))} END AS action,
         (e.event_id * 7 + c.priority) % 100 / 100.0 AS risk, e.event_id % 11 = 0 AS shadow, (e.event_id + c.priority) % 13 = 0 AS skipped,
         round(e.value / (c.priority + 1), 3) AS latency_ms
  FROM events e, controls c WHERE e.event_id % c.every = c.phase % c.every),
effective AS (SELECT *, CASE WHEN skipped OR (shadow AND action <> 'allow') THEN 'allow' ELSE action END AS eff,
                     CASE WHEN skipped THEN 'allow' ELSE action END AS would FROM decisions)"""
RANK_SQL = "CASE {0} " + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(ACTIONS)) + " END"
NAME_SQL = "CASE {0} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS)) + " END"


def _map(of: dict) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in of.items() for x in kv])


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id",
        "ts",
        F.col("user_id").cast("string").alias("identity"),
        F.col("event_type").alias("endpoint"),
        F.element_at(_map(ACTION_OF), F.col("event_type")).alias("final_action"),
        F.element_at(_map(SEVERITY_OF), F.col("event_type")).alias("severity"),
        F.col("value").alias("overhead_ms"),
        (F.col("event_type") != "error").alias("upstream_called"),
        (F.col("event_id") % 11 == 0).alias("shadow"),
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some controls' decisions for each event, by fixed rules on the event's number."""
    controls = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("control_id", "priority", "every", "phase", "severity"), c, strict=True)]) for c in CONTROLS])
    e, c = F.col("event_id"), F.col("c.priority")
    return (
        table(spark, sf_dir, "events")
        .select("event_id", "ts", "value", F.explode(F.filter(controls, lambda x: F.col("event_id") % x["every"] == x["phase"] % x["every"])).alias("c"))
        .select(
            e.alias("request"),
            "ts",
            "c.control_id",
            "c.priority",
            "c.severity",
            F.element_at(F.array(*map(F.lit, ACTIONS)), ((e + c) % 5 + 1).cast("int")).alias("action"),
            ((e * 7 + c) % 100 / 100.0).alias("risk"),
            (e % 11 == 0).alias("shadow"),
            ((e + c) % 13 == 0).alias("skipped"),
            F.round(F.col("value") / (c + 1), 3).alias("latency_ms"),
        )
    )
