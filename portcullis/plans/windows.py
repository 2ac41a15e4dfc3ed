"""Window and state queries over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions.columns import budget_level, window_bucket, window_expiry
from portcullis.operators import state as S
from portcullis.plans import register
from portcullis.plans.audit_view import AUDIT_SQL, NOW, audit
from portcullis.sources.tables import table

DAY, HALF = 86400, 43200
FIRST, LAST = 1704067200000, 1706659200000
SESSIONS_SQL = """gaps AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER o <= 43200000000 THEN 0 ELSE 1 END AS new FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM gaps)"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


@register("loop_guard", """SELECT event_id, count(*) OVER w AS identical, CASE WHEN count(*) OVER w > 3 THEN 'block' ELSE 'allow' END AS action FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)""")
def loop_guard(spark, sf_dir):
    """H6, E20."""
    return S.loop_guard(_events(spark, sf_dir), "user_id", ["event_type"], DAY, 3).select("event_id", "identical", "action")


@register("session_cap", """SELECT event_id, CAST(least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 256) AS INTEGER) AS nth,
CASE WHEN least(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id), 256) > 25 THEN 'block' ELSE 'allow' END AS action FROM events""")
def session_cap(spark, sf_dir):
    """H7, E20."""
    return S.session_cap(_events(spark, sf_dir), "user_id", 25).select("event_id", "nth", "action")


@register("session_ttl", f"WITH {SESSIONS_SQL} SELECT user_id, session, count(*) AS events, min(event_id) AS first_event FROM numbered GROUP BY ALL")
def session_ttl(spark, sf_dir):
    """H8: sessions with a gap of twelve hours."""
    return S.sessions(_events(spark, sf_dir), "user_id", HALF).groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


@register("taint_propagation", f"""WITH {SESSIONS_SQL} SELECT event_id, bool_or(event_type = 'error') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chat_tainted,
coalesce(bool_or(event_type = 'error') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tool_tainted FROM numbered WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id)""")
def taint_propagation(spark, sf_dir):
    """K1, F16: chat requests see their own taint, tool calls that of events before."""
    events, bad = _events(spark, sf_dir), F.col("event_type") == "error"
    chat = S.taint(events, "user_id", bad, HALF, True).select("event_id", F.col("tainted").alias("chat_tainted"))
    return chat.join(S.taint(events, "user_id", bad, HALF, False).select("event_id", F.col("tainted").alias("tool_tainted")), "event_id")


@register("taint_verdicts", f"""WITH {SESSIONS_SQL}, t AS (SELECT *, coalesce(bool_or(event_type = 'error') OVER (PARTITION BY user_id, session ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS tainted FROM numbered)
SELECT CASE WHEN tainted AND event_type IN ('purchase', 'signup') THEN 'require_approval' ELSE 'allow' END AS action, event_type AS tool, count(*) AS calls FROM t GROUP BY ALL""")
def taint_verdicts(spark, sf_dir):
    """Tools of high privilege in a tainted session."""
    tainted = S.taint(_events(spark, sf_dir), "user_id", F.col("event_type") == "error", HALF, False)
    action = F.when(F.col("tainted") & F.col("event_type").isin("purchase", "signup"), "require_approval").otherwise("allow")
    return tainted.groupBy(action.alias("action"), F.col("event_type").alias("tool")).agg(F.count("*").alias("calls"))


@register("sliding_rate", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent,
count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) > 5 AS over FROM events""")
def sliding_rate(spark, sf_dir):
    """H3, the count that isn't gated."""
    return S.sliding_rate(_events(spark, sf_dir), "user_id", DAY, 5).select("event_id", "recent", "over")


@register("rpm_admission", """WITH RECURSIVE n AS (SELECT user_id, ts, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k FROM events),
f AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::TIMESTAMP AS ts, NULL::BOOLEAN AS admitted, []::BIGINT[] AS live FROM events
  UNION ALL
  SELECT user_id, k, ts, len(live) < 5, CASE WHEN len(live) < 5 THEN list_append(live, t) ELSE live END
  FROM (SELECT n.user_id, n.k, n.ts, n.t, list_filter(f.live, lambda x: x > n.t - 86400000000) AS live FROM f JOIN n ON n.user_id = f.user_id AND n.k = f.k + 1))
SELECT user_id, ts, admitted FROM f WHERE k > 0""")
def rpm_admission(spark, sf_dir):
    """H3, H4: five requests a day, greedily."""
    return S.admissions(_events(spark, sf_dir), "user_id", DAY, 5)


@register("budget_usage_day", "SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS bucket, count(*) AS requests, round(sum(value), 6) AS cost FROM events GROUP BY ALL")
def budget_usage_day(spark, sf_dir):
    """H1, G19."""
    return S.usage(_events(spark, sf_dir), "user_id", F.col("value"), "day")


@register("budget_refusals", """SELECT event_id, round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id), 6) AS spent,
round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id), 6) > 100 AS refused FROM events""")
def budget_refusals(spark, sf_dir):
    """H5: the running cost of a day against a limit of 100."""
    return S.budget_order(_events(spark, sf_dir), "user_id", F.col("value"), 100.0).select("event_id", "spent", "refused")


@register("budget_levels", """WITH u AS (SELECT o_custkey AS identity, strftime(o_orderdate, '%Y-%m') AS month, round(sum(o_totalprice), 2) AS used FROM orders GROUP BY ALL),
l AS (SELECT *, CASE WHEN identity % 7 = 0 THEN NULL WHEN identity % 11 = 0 THEN 0 ELSE 400000 END AS cap FROM u),
s AS (SELECT *, CASE WHEN cap = 0 THEN CASE WHEN used > 0 THEN 1.0 ELSE 0.0 END ELSE used / cap END AS share FROM l)
SELECT identity, month, used, CASE WHEN cap IS NULL THEN 'unlimited' WHEN share >= 1 THEN 'exceeded' WHEN share >= 0.9 THEN 'high' WHEN share >= 0.7 THEN 'warning' ELSE 'ok' END AS level FROM s""")
def budget_levels(spark, sf_dir):
    """Spending by month against limits; some have none, some have zero."""
    used = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("identity"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("o_totalprice"), 2).alias("used"))
    cap = F.when(F.col("identity") % 7 == 0, None).when(F.col("identity") % 11 == 0, 0).otherwise(400000)
    return used.withColumn("level", budget_level(F.col("used"), cap))


@register("action_time_buckets", f"""WITH {AUDIT_SQL}, s AS (SELECT unnest(range({FIRST} // 43200000, {LAST} // 43200000 + 1)) * 43200000 AS bucket_ms),
c AS (SELECT epoch_us(ts) // 1000 // 43200000 * 43200000 AS bucket_ms, final_action, count(*) AS n FROM audit WHERE epoch_us(ts) // 1000 BETWEEN {FIRST} AND {LAST} GROUP BY ALL)
SELECT s.bucket_ms, a.final_action, coalesce(c.n, 0) AS n FROM s CROSS JOIN (SELECT DISTINCT final_action FROM c) a LEFT JOIN c ON c.bucket_ms = s.bucket_ms AND c.final_action = a.final_action""")
def action_time_buckets(spark, sf_dir):
    """H2: 96 buckets at most, zeros filled in."""
    return S.time_buckets(audit(spark, sf_dir), FIRST, LAST, S.bucket_step(FIRST, LAST), "final_action")


@register("rebucketed_counts", f"""WITH {AUDIT_SQL} SELECT epoch_us(ts) // 1000 // 86400000 * 86400000 AS bucket_ms, final_action, count(*) AS n FROM audit WHERE epoch_us(ts) // 1000 BETWEEN {FIRST} AND {LAST} GROUP BY ALL""")
def rebucketed_counts(spark, sf_dir):
    """Half days summed to days."""
    fine = action_time_buckets(spark, sf_dir).where("n > 0")
    return fine.groupBy((F.floor(F.col("bucket_ms") / 86400000) * 86400000).cast("long").alias("bucket_ms"), "final_action").agg(F.sum("n").alias("n"))


@register("window_buckets", """SELECT event_id, 'hour:' || CAST(epoch_us(ts) // 3600000000 AS VARCHAR) AS bucket, (epoch_us(ts) // 3600000000 + 1) * 3600 AS expires FROM events""")
def window_buckets(spark, sf_dir):
    """C14, H13."""
    epoch = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    return _events(spark, sf_dir).select("event_id", window_bucket(epoch, "hour").alias("bucket"), window_expiry(epoch, "hour").alias("expires"))


@register("budget_resets", f"""SELECT user_id, max(date_trunc('day', ts)) + INTERVAL 1 DAY AS resets FROM events WHERE ts < TIMESTAMP '{NOW}' GROUP BY user_id""")
def budget_resets(spark, sf_dir):
    """When an identity's last daily bucket resets."""
    return _events(spark, sf_dir).where(F.col("ts") < F.lit(NOW).cast("timestamp_ntz")).groupBy("user_id").agg((F.max(F.date_trunc("day", "ts")) + F.expr("INTERVAL 1 DAY")).alias("resets"))


@register("compute_refusals", """WITH r AS (SELECT event_id, coalesce(round(sum(value) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6), 0) AS before FROM events)
SELECT event_id, before, before >= 60 AS refused FROM r""")
def compute_refusals(spark, sf_dir):
    """H5: compute seconds are refused at the limit, by what was used before the request."""
    from pyspark.sql import Window

    before = Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.round(F.sum("value").over(before), 6), F.lit(0.0))
    return _events(spark, sf_dir).select("event_id", used.alias("before")).withColumn("refused", F.col("before") >= 60)
