"""Telemetry queries over the audit view."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions.columns import action_rank, severity_band
from portcullis.operators import metrics as M
from portcullis.operators.replay import last_requests
from portcullis.plans import register
from portcullis.plans.audit_view import AUDIT_SQL, DECISIONS_SQL, NOW, RANK_SQL, audit, decisions
from portcullis.sources.tables import table


@register("action_counts", f"WITH {AUDIT_SQL} SELECT final_action, count(*) AS n FROM audit GROUP BY 1")
def action_counts(spark, sf_dir):
    """G1, G5."""
    return M.counts(audit(spark, sf_dir), "final_action")


@register("action_pivot", f"WITH {AUDIT_SQL} SELECT identity, count(*) FILTER (final_action = 'block') AS block, count(*) FILTER (final_action = 'redact') AS redact, count(*) FILTER (final_action NOT IN ('block', 'redact')) AS other FROM audit GROUP BY 1")
def action_pivot(spark, sf_dir):
    """Known actions and the rest, a column each."""
    kind = F.when(F.col("final_action").isin("block", "redact"), F.col("final_action")).otherwise("other")
    return audit(spark, sf_dir).withColumn("kind", kind).groupBy("identity").pivot("kind", ["block", "redact", "other"]).count().na.fill(0)


@register("severity_counts", f"WITH {AUDIT_SQL} SELECT severity, final_action, count(*) AS n FROM audit WHERE final_action <> 'allow' GROUP BY ALL")
def severity_counts(spark, sf_dir):
    """Acting events by severity."""
    return M.counts(audit(spark, sf_dir).where("final_action <> 'allow'"), "severity", "final_action")


@register("metrics_grouping_sets", f"""WITH {AUDIT_SQL} SELECT final_action, endpoint, grouping(final_action) AS no_action, grouping(endpoint) AS no_endpoint, count(*) AS n, round(sum(overhead_ms), 6) AS cost
FROM audit GROUP BY GROUPING SETS ((final_action), (endpoint), ())""")
def metrics_grouping_sets(spark, sf_dir):
    """Several breakdowns in one pass."""
    audit(spark, sf_dir).createOrReplaceTempView("audit_for_sets")
    return spark.sql("""SELECT final_action, endpoint, CAST(grouping(final_action) AS BIGINT) AS no_action, CAST(grouping(endpoint) AS BIGINT) AS no_endpoint, count(*) AS n, round(sum(overhead_ms), 6) AS cost
        FROM audit_for_sets GROUP BY GROUPING SETS ((final_action), (endpoint), ())""")


@register("control_summary", f"""WITH {DECISIONS_SQL} SELECT control_id, count(*) AS evaluated, count(*) FILTER (skipped) AS skipped, count(*) FILTER (NOT skipped AND action <> 'allow') AS acted, count(DISTINCT request) AS requests,
max(ts) AS last_hit FROM decisions GROUP BY 1""")
def control_summary(spark, sf_dir):
    """What each control did; its last decision counts whatever it was."""
    return decisions(spark, sf_dir).groupBy("control_id").agg(
        F.count("*").alias("evaluated"), F.count_if("skipped").alias("skipped"), F.count_if(~F.col("skipped") & (F.col("action") != "allow")).alias("acted"),
        F.countDistinct("request").alias("requests"), F.max("ts").alias("last_hit"),
    )


@register("event_severity", f"""WITH {DECISIONS_SQL} SELECT CASE r WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, count(*) AS requests FROM (
SELECT request, max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS r FROM decisions WHERE NOT skipped AND (action <> 'allow' OR shadow) GROUP BY request) GROUP BY 1""")
def event_severity(spark, sf_dir):
    """The strongest severity of an event's acting decisions."""
    from portcullis.functions.columns import SEVERITIES, severity_rank

    acting = decisions(spark, sf_dir).where(~F.col("skipped") & ((F.col("action") != "allow") | F.col("shadow")))
    top = acting.groupBy("request").agg(F.max(severity_rank(F.col("severity"))).alias("r"))
    return top.groupBy(F.element_at(F.array(*map(F.lit, SEVERITIES)), F.col("r") + 1).alias("severity")).agg(F.count("*").alias("requests"))


@register("judge_usage", f"""WITH {DECISIONS_SQL}, e AS (SELECT e.event_id, coalesce(bool_or(NOT d.skipped), false) AS judged FROM events e LEFT JOIN decisions d ON d.request = e.event_id AND d.control_id = 'C-INJ-SEM' GROUP BY 1)
SELECT judged, count(*) AS events FROM e GROUP BY 1""")
def judge_usage(spark, sf_dir):
    """Events without the judge's decision count as not judged."""
    judge = decisions(spark, sf_dir).where("control_id = 'C-INJ-SEM'").groupBy(F.col("request").alias("event_id")).agg(F.bool_or(~F.col("skipped")).alias("judged"))
    every = table(spark, sf_dir, "events").select("event_id").join(judge, "event_id", "left")
    return every.groupBy(F.coalesce("judged", F.lit(False)).alias("judged")).agg(F.count("*").alias("events"))


@register("latency_percentiles_admin", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(CASE WHEN i = round_even(0.5 * (n - 1), 0) THEN round(value, 3) END) AS p50, max(CASE WHEN i = round_even(0.95 * (n - 1), 0) THEN round(value, 3) END) AS p95,
max(CASE WHEN i = round_even(0.99 * (n - 1), 0) THEN round(value, 3) END) AS p99 FROM r GROUP BY 1""")
def latency_percentiles_admin(spark, sf_dir):
    """G2."""
    return M.nearest_even_percentiles(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", (0.5, 0.95, 0.99))


@register("latency_percentiles_dashboard", "SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles_dashboard(spark, sf_dir):
    """G9."""
    return M.nearest_rank_percentiles(table(spark, sf_dir, "events"), "event_type", "value", (0.5, 0.95))


@register("latency_percentiles_stack", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, max(CASE WHEN i = greatest(0, least(n - 1, round_even(0.5 * n + 0.5, 0) - 1)) THEN value END) AS p50, max(CASE WHEN i = greatest(0, least(n - 1, round_even(0.95 * n + 0.5, 0) - 1)) THEN value END) AS p95 FROM r GROUP BY 1""")
def latency_percentiles_stack(spark, sf_dir):
    """G14."""
    return M.half_up_percentiles(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", (0.5, 0.95))


@register("timeout_suggestion", "SELECT event_type, median(value) AS median, CAST(ceil(quantile_cont(value, 0.95) * 1.5 / 100) * 100 AS BIGINT) AS timeout_ms FROM events GROUP BY 1")
def timeout_suggestion(spark, sf_dir):
    """A timeout of one and a half times the 95th percentile, in steps of 100 ms."""
    tail = F.percentile("value", 0.95)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.median("value").alias("median"), (F.ceil(tail * 1.5 / 100) * 100).cast("long").alias("timeout_ms"))


@register("top_identities_other", f"""WITH {AUDIT_SQL}, c AS (SELECT identity, count(*) AS n FROM audit GROUP BY 1), h AS (SELECT identity FROM c ORDER BY n DESC, identity LIMIT 9)
SELECT CASE WHEN identity IN (SELECT identity FROM h) THEN identity ELSE 'Other' END AS identity, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def top_identities_other(spark, sf_dir):
    """G10."""
    return M.top_and_other(M.counts(audit(spark, sf_dir), "identity"), "identity", 10)


@register("block_rate", f"WITH {AUDIT_SQL} SELECT endpoint, count(*) AS total, count(*) FILTER (final_action = 'block') AS blocked, round(count(*) FILTER (final_action = 'block') / nullif(count(*), 0), 6) AS rate FROM audit GROUP BY 1")
def block_rate(spark, sf_dir):
    """Null where there is nothing to divide by."""
    blocked = F.count_if(F.col("final_action") == "block")
    return audit(spark, sf_dir).groupBy("endpoint").agg(F.count("*").alias("total"), blocked.alias("blocked"), F.round(F.try_divide(blocked, F.count("*")), 6).alias("rate"))


@register("daily_change", """WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), p AS (SELECT day, n, lag(n) OVER (ORDER BY day) AS before FROM d)
SELECT CAST(day AS VARCHAR) AS day, n, n - before AS delta, round((n - before) / nullif(before, 0), 6) AS ratio FROM p""")
def daily_change(spark, sf_dir):
    """Against the day before; the daily counts are a row a day."""
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    before = daily.select(F.date_add("day", 1).alias("day"), F.col("n").alias("before"))
    delta = F.col("n") - F.col("before")
    return daily.join(before, "day", "left").select(F.col("day").cast("string"), "n", delta.alias("delta"), F.round(F.try_divide(delta, F.col("before")), 6).alias("ratio"))


@register("recent_filtered", f"WITH {AUDIT_SQL} SELECT event_id, identity, endpoint FROM audit WHERE final_action = 'block' AND ts >= TIMESTAMP '2024-01-15 00:00:00' ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_filtered(spark, sf_dir):
    """The newest fifty blocks since a day."""
    since = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return M.newest(M.filtered(audit(spark, sf_dir), since=since, action="block"), 50).select("event_id", "identity", "endpoint")


@register("dedupe_last_n", f"""WITH {AUDIT_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_id % 4000 ORDER BY ts DESC, event_id DESC) AS k FROM audit)
SELECT event_id % 4000 AS request_id, event_id, final_action FROM r WHERE k = 1 ORDER BY ts DESC, event_id DESC LIMIT 500""")
def dedupe_last_n(spark, sf_dir):
    """Of repeated request ids the later, then the last five hundred."""
    return last_requests(audit(spark, sf_dir).withColumn("request_id", F.col("event_id") % 4000), 500).select("request_id", "event_id", "final_action")


@register("stage_actions_ranked", f"WITH {DECISIONS_SQL} SELECT control_id, {RANK_SQL.format('action')} AS rank, count(*) AS n FROM decisions GROUP BY ALL")
def stage_actions_ranked(spark, sf_dir):
    """Decisions by control and rank of the action."""
    return decisions(spark, sf_dir).groupBy("control_id", action_rank(F.col("action")).alias("rank")).agg(F.count("*").alias("n"))


@register("severity_bands", f"WITH {DECISIONS_SQL} SELECT CASE WHEN risk >= 0.95 THEN 'critical' WHEN risk >= 0.85 THEN 'high' WHEN risk >= 0.65 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM decisions GROUP BY 1")
def severity_bands(spark, sf_dir):
    """C26."""
    return decisions(spark, sf_dir).groupBy(severity_band(F.col("risk")).alias("band")).agg(F.count("*").alias("n"))


@register("control_trend", f"""WITH {DECISIONS_SQL}, t AS (SELECT control_id FROM decisions WHERE action = 'block' GROUP BY 1 ORDER BY count(*) DESC, control_id LIMIT 3)
SELECT control_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n FROM decisions WHERE action = 'block' AND control_id IN (SELECT control_id FROM t) GROUP BY ALL""")
def control_trend(spark, sf_dir):
    """Daily blocks of the three controls that block most."""
    blocks = decisions(spark, sf_dir).where("action = 'block'")
    top = blocks.groupBy("control_id").count().orderBy(F.col("count").desc(), "control_id").limit(3)
    return blocks.join(F.broadcast(top.select("control_id")), "control_id", "left_semi").groupBy("control_id", F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"))


@register("duplicate_request_ids", "SELECT event_id % 9000 AS id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) > 1")
def duplicate_request_ids(spark, sf_dir):
    """J6."""
    return table(spark, sf_dir, "events").groupBy((F.col("event_id") % 9000).alias("id")).agg(F.count("*").alias("n")).where("n > 1")


@register("unflushed_events", "SELECT event_id FROM events WHERE event_id % 10 < 5 AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def unflushed_events(spark, sf_dir):
    """events in memory that the file doesn't have."""
    ids = table(spark, sf_dir, "events").select("event_id")
    return ids.where("event_id % 10 < 5").join(ids.where("event_id % 3 = 0"), "event_id", "left_anti")


@register("coverage_matrix", f"""WITH {DECISIONS_SQL}, seen AS (SELECT control_id, count(*) FILTER (action = 'block') AS blocked, count(*) FILTER (action = 'allow') AS allowed FROM decisions GROUP BY 1),
wanted(control_id, threat) AS (VALUES ('C-SIZE', 'TH-11'), ('C-TAINT', 'TH-06'), ('C-GHOST', 'TH-09'))
SELECT coalesce(s.control_id, w.control_id) AS control_id, w.threat, CASE WHEN s.control_id IS NULL THEN 'none' WHEN w.threat IS NULL THEN 'unmapped' WHEN s.blocked > 0 AND s.allowed > 0 THEN 'full' ELSE 'partial' END AS level
FROM seen s FULL OUTER JOIN wanted w ON s.control_id = w.control_id""")
def coverage_matrix(spark, sf_dir):
    """Controls against the threats they should cover."""
    seen = decisions(spark, sf_dir).groupBy("control_id").agg(F.count_if(F.col("action") == "block").alias("blocked"), F.count_if(F.col("action") == "allow").alias("allowed"), F.lit(True).alias("seen"))
    wanted = spark.createDataFrame([("C-SIZE", "TH-11"), ("C-TAINT", "TH-06"), ("C-GHOST", "TH-09")], "control_id string, threat string")
    level = F.when(F.col("seen").isNull(), "none").when(F.col("threat").isNull(), "unmapped").when((F.col("blocked") > 0) & (F.col("allowed") > 0), "full").otherwise("partial")
    return seen.join(wanted, "control_id", "full_outer").select("control_id", "threat", level.alias("level"))


@register("detection_quality", """WITH c AS (SELECT d.lang, CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'positive' END AS kind, length(d.text) > 2000 AS stopped FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
SELECT lang, count(*) FILTER (kind = 'negative') AS negatives, count(*) FILTER (kind = 'positive') AS positives, round(avg(CASE WHEN kind = 'negative' THEN CAST(stopped AS INTEGER) END), 6) AS detection_rate,
round(avg(CASE WHEN kind = 'positive' THEN CAST(stopped AS INTEGER) END), 6) AS false_positive_rate FROM c GROUP BY 1""")
def detection_quality(spark, sf_dir):
    """Rates by language, with the size limit as the control."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.length("text") > 2000).alias("stopped"))
    kind = F.when(F.col("toxic") == 1, "negative").otherwise("positive").alias("kind")
    return M.detection_report(docs.join(table(spark, sf_dir, "labels"), "doc_id").select("lang", kind, "stopped"), "lang")


@register("bypass_rates", """SELECT event_type AS strategy, count(*) AS attempts, count(*) FILTER (value < 5) AS bypasses, round(avg(CAST(value < 5 AS INTEGER)), 6) AS bypass_rate FROM events GROUP BY 1""")
def bypass_rates(spark, sf_dir):
    """Bypasses by strategy, in the report's names."""
    passed = (F.col("value") < 5).cast("int")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("strategy")).agg(F.count("*").alias("attempts"), F.sum(passed).cast("long").alias("bypasses"), F.round(F.avg(passed), 6).alias("bypass_rate"))


@register("policy_history", f"WITH {AUDIT_SQL} SELECT event_id, endpoint FROM audit WHERE endpoint = 'signup' AND ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND TIMESTAMP '{NOW}'")
def policy_history(spark, sf_dir):
    """Seven days of one event type, both ends included."""
    now = F.lit(NOW).cast("timestamp")
    return M.filtered(audit(spark, sf_dir), since=now - F.expr("INTERVAL 7 DAY"), until=now, endpoint="signup").select("event_id", "endpoint")
