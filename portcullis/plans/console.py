"""What a console shows and a test bench reports: filters, lists, the slowest, what caught what."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.operators import approvals as P
from portcullis.operators import metrics as M
from portcullis.plans import register
from portcullis.plans.audit_view import AUDIT_SQL, DECISIONS_SQL, THREATS, audit, decisions, values
from portcullis.sources.tables import table

#: Filters as a console sets them.
FILTERS = {
    "blocked": {"action": "block", "severity": "critical"},
    "control": {"control": "C-SIZE", "endpoint": "view", "identity": ""},
    "threat": {"threat": "TH-06", "type": "request"},
    "found": {"q": " REQ-12"},
    "odd": {"action": "unknown"},
    "identity": {"identity": "7", "policy_version": "v1"},
}


@register("console_filters", f"""WITH {AUDIT_SQL}, {DECISIONS_SQL}, t(control_id, threat_id) AS ({values([(c, t) for c, ts in THREATS.items() for t in ts])}),
i AS (SELECT request, list(DISTINCT d.control_id) AS controls, list(DISTINCT t.threat_id) AS threats FROM decisions d JOIN t USING (control_id) GROUP BY 1),
v AS (SELECT a.event_id, a.identity, a.endpoint, a.severity, CASE WHEN a.event_id % 37 = 0 THEN 'paused' ELSE a.final_action END AS final_action, 'req-' || a.event_id AS request_id, 's-' || a.identity AS session_id,
  CASE WHEN a.overhead_ms < 50 THEN 'v1' ELSE 'v2' END AS version, CASE WHEN a.event_id % 9 = 0 THEN 'policy' ELSE 'request' END AS type, coalesce(controls, []) AS controls, coalesce(threats, []) AS threats FROM audit a LEFT JOIN i ON i.request = a.event_id)
SELECT filter, count(*) AS events, min(event_id) AS first FROM (
  SELECT 'blocked' AS filter, event_id FROM v WHERE final_action = 'block' AND severity = 'critical' UNION ALL SELECT 'control', event_id FROM v WHERE list_contains(controls, 'C-SIZE') AND endpoint = 'view'
  UNION ALL SELECT 'threat', event_id FROM v WHERE list_contains(threats, 'TH-06') AND type = 'request' UNION ALL SELECT 'found', event_id FROM v WHERE contains(lower(request_id), 'req-12') OR contains(lower(session_id), 'req-12')
  UNION ALL SELECT 'odd', event_id FROM v WHERE final_action = 'paused' UNION ALL SELECT 'identity', event_id FROM v WHERE identity = '7' AND version = 'v1') GROUP BY 1""")
def console_filters(spark, sf_dir):
    """Events behind each of six settings of the console's filters."""
    threats = spark.createDataFrame([(c, t) for c, t in THREATS.items()], "control_id string, threats array<string>")
    ids = decisions(spark, sf_dir).join(threats, "control_id").groupBy(F.col("request").alias("event_id")).agg(F.collect_set("control_id").alias("control_ids"), F.array_distinct(F.flatten(F.collect_list("threats"))).alias("threat_ids"))
    shown = audit(spark, sf_dir).join(ids, "event_id", "left")
    view = shown.withColumns({
        "final_action": F.when(F.col("event_id") % 37 == 0, "paused").otherwise(F.col("final_action")), "request_id": F.concat(F.lit("req-"), "event_id"), "session_id": F.concat(F.lit("s-"), "identity"),
        "policy_version": F.when(F.col("overhead_ms") < 50, "v1").otherwise("v2"), "type": F.when(F.col("event_id") % 9 == 0, "policy").otherwise("request"),
    })
    behind = [M.console_filter(view, **wanted).select(F.lit(name).alias("filter"), "event_id") for name, wanted in FILTERS.items()]
    every = behind[0]
    for more in behind[1:]:
        every = every.unionByName(more)
    return every.groupBy("filter").agg(F.count("*").alias("events"), F.min("event_id").alias("first"))


@register("slowest_controls", f"""WITH {DECISIONS_SQL}, k AS (SELECT control_id || ' ' || action AS key, latency_ms FROM decisions)
SELECT key, n, p95 FROM (SELECT key, count(*) AS n, quantile_disc(latency_ms, 0.95) AS p95 FROM k GROUP BY 1) ORDER BY p95 DESC, key LIMIT 12""")
def slowest_controls(spark, sf_dir):
    """I8: the twelve pairs of control and action with the longest 95th percentile; the limit is the report's."""
    keyed = decisions(spark, sf_dir).select(F.concat_ws(" ", "control_id", "action").alias("key"), "latency_ms")
    return M.slowest(keyed, "key", "latency_ms")


CASES_SQL = """c AS (SELECT d.source AS category, d.lang, CASE WHEN l.toxic = 1 THEN 'block' ELSE 'allow' END AS expect,
  CASE WHEN length(d.text) % 41 = 0 THEN 'error' WHEN length(d.text) > 4000 OR regexp_matches(d.text, 'https?://') OR length(d.text) % 7 = 0 THEN 'block' ELSE 'allow' END AS outcome,
  CASE WHEN length(d.text) > 4000 THEN 'C-SIZE' WHEN regexp_matches(d.text, 'https?://') THEN 'C-SIG' ELSE 'C-INJ-SEM' END AS control FROM documents d JOIN labels l USING (doc_id) WHERE d.text IS NOT NULL)"""


def _cases(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").join(table(spark, sf_dir, "labels"), "doc_id")
    size, link = F.length("text"), F.col("text").rlike("https?://")
    outcome = F.when(size % 41 == 0, "error").when((size > 4000) | link | (size % 7 == 0), "block").otherwise("allow")
    control = F.when(size > 4000, "C-SIZE").when(link, "C-SIG").otherwise("C-INJ-SEM")
    return docs.select(F.col("source").alias("category"), "lang", F.when(F.col("toxic") == 1, "block").otherwise("allow").alias("expect"), outcome.alias("outcome"), control.alias("control"))


@register("stack_report", f"""WITH {CASES_SQL} SELECT category, lang, count(*) FILTER (expect = 'block') AS attacks, count(*) FILTER (expect = 'block' AND outcome = 'block') AS detected, count(*) FILTER (expect = 'allow') AS benign,
count(*) FILTER (expect = 'allow' AND outcome = 'block') AS false_positives, count(*) FILTER (outcome = 'error') AS errors FROM c GROUP BY GROUPING SETS ((category), (lang), ())""")
def stack_report(spark, sf_dir):
    """A stack's results by category, by language and in all, over labelled documents."""
    return M.stack_report(_cases(spark, sf_dir))


@register("caught_by", f"WITH {CASES_SQL} SELECT control, count(*) AS n FROM c WHERE outcome = 'block' GROUP BY 1")
def caught_by(spark, sf_dir):
    """Which control stopped how many."""
    return M.caught_by(_cases(spark, sf_dir))


NOW_S = 1705600000


@register("approvals_listed", f"""WITH e AS (SELECT user_id AS id, epoch_us(ts) // 1000000 AS t, event_type FROM events WHERE event_type <> 'error' AND epoch_us(ts) // 1000000 <= {NOW_S}),
s AS (SELECT id, min(t) FILTER (event_type = 'view') AS created, min_by(event_type, t) FILTER (event_type IN ('click', 'signup')) AS verdict, min(t) FILTER (event_type IN ('click', 'signup')) AS decided FROM e GROUP BY 1),
u AS (SELECT DISTINCT id FROM e JOIN s USING (id) WHERE event_type = 'purchase' AND verdict = 'click' AND decided <= t AND t < created + 500000)
SELECT id AS approval_id, created, CASE WHEN u.id IS NOT NULL THEN 'used' WHEN verdict = 'signup' THEN 'rejected' WHEN created + 500000 <= {NOW_S} THEN 'expired' WHEN verdict = 'click' THEN 'approved' ELSE 'pending' END AS status FROM s LEFT JOIN u USING (id) WHERE created IS NOT NULL""")
def approvals_listed(spark, sf_dir):
    """Approvals as they stand at a time: views ask, clicks approve, sign-ups reject, purchases use."""
    kinds = F.create_map(*[F.lit(x) for kv in {"view": "request", "click": "approve", "signup": "reject", "purchase": "consume"}.items() for x in kv])
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    log = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("approval_id"), seconds.alias("ts"), F.element_at(kinds, F.col("event_type")).alias("kind"), F.lit("i").alias("identity"), F.lit("f").alias("fingerprint"))
    return P.listed(log, NOW_S, life=500_000).select("approval_id", "created", "status")
