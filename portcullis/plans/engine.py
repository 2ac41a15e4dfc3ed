"""Engine queries over decisions derived from events."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.operators import engine as E
from portcullis.operators import replay as R
from portcullis.plans import register
from portcullis.plans.audit_view import DECISIONS_SQL, NAME_SQL, RANK_SQL, TAXONOMY, THREATS, audit, decisions, values

MERGED_SQL = f"""merged AS (SELECT request, max({RANK_SQL.format("eff")}) AS f, max({RANK_SQL.format("would")}) AS w, max(risk) AS risk FROM effective GROUP BY request),
blocking AS (SELECT e.request, first(e.control_id ORDER BY e.priority, e.control_id) AS control_id FROM effective e JOIN merged m ON m.request = e.request
  AND {RANK_SQL.format("e.eff")} = m.f GROUP BY e.request),
outcome AS (SELECT m.request, {NAME_SQL.format("m.f")} AS final_action, CASE WHEN m.w > m.f THEN {NAME_SQL.format("m.w")} END AS would_have_action,
  CASE WHEN m.f > 0 THEN b.control_id END AS blocking_control, m.risk FROM merged m JOIN blocking b USING (request))"""


@register("decision_merge", f"WITH {DECISIONS_SQL}, {MERGED_SQL} SELECT request, final_action, would_have_action, blocking_control, CAST(risk AS DOUBLE) AS risk FROM outcome")
def decision_merge(spark, sf_dir):
    """D7, D9, D10, D13."""
    return E.merge(decisions(spark, sf_dir))


@register(
    "running_risk_first_block",
    f"""WITH {DECISIONS_SQL} SELECT request, control_id, CAST(coalesce(max(risk) OVER before, 0) AS DOUBLE) AS seen_risk,
  NOT coalesce(bool_or(eff IN ('block', 'require_approval')) OVER before, false) AS reached FROM effective
WINDOW before AS (PARTITION BY request ORDER BY priority, control_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def running_risk_first_block(spark, sf_dir):
    """D4, D5."""
    return E.running(decisions(spark, sf_dir)).select("request", "control_id", "seen_risk", "reached")


@register(
    "first_block_merge",
    f"""WITH {DECISIONS_SQL}, run AS (SELECT *, NOT coalesce(bool_or(eff IN ('block', 'require_approval')) OVER (PARTITION BY request ORDER BY priority, control_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reached FROM effective)
SELECT {NAME_SQL.format("f")} AS final_action, evaluated, count(*) AS requests FROM (
  SELECT request, max({RANK_SQL.format("eff")}) AS f, count(*) AS evaluated FROM run WHERE reached GROUP BY request) GROUP BY ALL""",
)
def first_block_merge(spark, sf_dir):
    """D5 against D6: how many controls are evaluated if the first block ends a request."""
    reached = E.running(decisions(spark, sf_dir)).where("reached")
    merged = E.merge(reached).join(reached.groupBy("request").agg(F.count("*").alias("evaluated")), "request")
    return merged.groupBy("final_action", "evaluated").agg(F.count("*").alias("requests"))


@register(
    "request_status",
    f"""WITH {DECISIONS_SQL}, {MERGED_SQL} SELECT CAST(CASE WHEN final_action IN ('allow', 'flag', 'redact') THEN 200 ELSE 403 END AS INTEGER) AS status, count(*) AS requests FROM outcome GROUP BY 1""",
)
def request_status(spark, sf_dir):
    """D15."""
    merged = E.merge(decisions(spark, sf_dir))
    return merged.groupBy(E.status_of(F.col("final_action"), F.col("blocking_control")).alias("status")).agg(F.count("*").alias("requests"))


@register(
    "stage_rollup",
    f"""WITH {DECISIONS_SQL}, s AS (SELECT request % 1000 AS request, {RANK_SQL.format("eff")} AS r, request % 3 = 0 AS approved FROM effective)
SELECT request, {NAME_SQL.format("max(CASE WHEN approved AND r = 3 THEN 0 ELSE r END)")} AS final_action FROM s GROUP BY request""",
)
def stage_rollup(spark, sf_dir):
    """A thousand requests of several stages; every third stage was approved."""
    stages = decisions(spark, sf_dir).select((F.col("request") % 1000).alias("request"), (F.col("request") % 3 == 0).alias("approved"), E.effective().alias("final_action"))
    return E.roll_up(stages, approved=F.col("approved"))


@register("latency_per_control", f"WITH {DECISIONS_SQL} SELECT request % 100 AS request, control_id, round(sum(latency_ms), 3) AS latency_ms FROM decisions GROUP BY ALL")
def latency_per_control(spark, sf_dir):
    """D16."""
    return E.latency_by_control(decisions(spark, sf_dir).withColumn("request", F.col("request") % 100))


@register(
    "threat_taxonomy_counts",
    f"""WITH {DECISIONS_SQL}, t(control_id, threat_id) AS ({values([(c, t) for c, ts in THREATS.items() for t in ts])}),
x(threat_id, entry) AS ({values([(t, e) for t, es in TAXONOMY.items() for e in es])})
SELECT x.entry, count(DISTINCT request) AS requests, count(*) AS decisions FROM decisions JOIN t USING (control_id) JOIN x USING (threat_id)
WHERE NOT skipped AND (action <> 'allow' OR shadow) GROUP BY x.entry""",
)
def threat_taxonomy_counts(spark, sf_dir):
    """acting decisions by taxonomy entry; shadow decisions count as acting, skipped ones don't."""
    acting = decisions(spark, sf_dir).where(~F.col("skipped") & ((F.col("action") != "allow") | F.col("shadow"))).select("request", "control_id")
    return E.by_entry(acting, {c: [e for t in ts for e in TAXONOMY.get(t, [])] for c, ts in THREATS.items()})


CANDIDATE = [("C-MODEL-ALLOW", True, False, "block"), ("C-SIZE", False, False, "block"), ("C-INJ-PAT", True, False, "flag"), ("C-SIG", True, True, "block"), ("C-TAINT", True, False, "require_approval")]
REPLAY_SQL = f"""p(control_id, enabled, shadow, action) AS ({values(CANDIDATE)}), replayed AS (
  SELECT d.request, d.action AS stored, d.would AS w0, CASE WHEN d.skipped OR d.would IN ('allow', 'flag') OR p.control_id IS NULL OR NOT p.enabled OR p.shadow THEN 0 ELSE {RANK_SQL.format("p.action")} END AS c,
         {RANK_SQL.format("d.eff")} AS o FROM effective d LEFT JOIN p USING (control_id))"""


@register("policy_replay", f"WITH {DECISIONS_SQL}, {REPLAY_SQL} SELECT request, {NAME_SQL.format('max(o)')} AS original, {NAME_SQL.format('max(c)')} AS candidate FROM replayed GROUP BY request")
def policy_replay(spark, sf_dir):
    """K8: stored decisions under a candidate policy; stored flags don't count, as in the source of these semantics."""
    return R.replay(decisions(spark, sf_dir), spark.createDataFrame(CANDIDATE, "control_id string, enabled boolean, shadow boolean, action string"))


@register("policy_replay_counts", f"""WITH {DECISIONS_SQL}, {REPLAY_SQL}, r AS (SELECT request, {NAME_SQL.format('max(o)')} AS original, {NAME_SQL.format('max(c)')} AS candidate FROM replayed GROUP BY request)
SELECT original, candidate, original <> candidate AS changed, count(*) AS requests FROM r GROUP BY ALL""")
def policy_replay_counts(spark, sf_dir):
    """G16."""
    changed = (F.col("original") != F.col("candidate")).alias("changed")
    return policy_replay(spark, sf_dir).groupBy("original", "candidate", changed).agg(F.count("*").alias("requests"))
