"""The audit log as a file: events written as lines, rotated, read again, and followed as a stream."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from portcullis.plans import register
from portcullis.plans.audit_view import ACTION_OF, SEVERITY_OF
from portcullis.sources import audit as L
from portcullis.sources.staging import fresh_path, release_shuffles
from portcullis.sources.tables import table

LIMIT = 900
#: Events that land at once and that one task writes, about: as audit events they are a hundred times what they are in the table.
LANDING, TASK = 500_000, 25_000
OVERLAP = timedelta(hours=2)


def audit_events(events):
    """Events as audit events: as many decisions, matches and words of reason as their values ask for."""
    of = lambda names: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("event_type"))
    # Under names of their own first: inside functions over arrays a new column's name would hide the old one's.
    rows = events.where("props is not null").select(
        F.col("ts").alias("_ts"), F.col("event_id").alias("_n"), F.col("user_id").alias("_user"), F.col("event_type").alias("_type"), of(ACTION_OF).alias("_action"), of(SEVERITY_OF).alias("_severity"),
        F.get_json_object("props", "$.k").cast("int").alias("_k"),
    )
    match = lambda i: F.struct(F.lit("word").alias("kind"), i.cast("int").alias("segment_idx"), F.concat(F.lit("m"), i).alias("masked"))
    decision = lambda i: F.struct(
        F.concat(F.lit("C-"), i).alias("control_id"), F.array(F.lit("TH-01")).alias("threat_ids"), F.col("_action").alias("action"), F.col("_severity").alias("severity"), F.lit(None).cast("double").alias("score"),
        F.repeat(F.lit("r"), F.col("_k") * 4).alias("reason"), F.transform(F.sequence(F.lit(1), (F.col("_n") % 6 + 1).cast("int")), match).alias("matches"), F.lit(None).cast("double").alias("latency_ms"),
        F.lit(None).cast("boolean").alias("skipped"), F.lit(None).cast("boolean").alias("shadow_suppressed"),
    )
    detail = F.concat(F.lit('{"args": {"k": '), "_k", F.lit('}, "user": '), "_user", F.lit("}"))
    made = {
        "ts": F.date_format("_ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "event_id": F.concat(F.lit("evt-"), "_n"), "type": F.lit("request"), "identity": F.concat(F.lit("u"), "_user"), "endpoint": F.col("_type"),
        "final_action": F.col("_action"), "decisions": F.transform(F.sequence(F.lit(1), (F.col("_user") % 3 + 1).cast("int")), decision), "detail": L.detail_without_content(detail),
    }
    fields = [f for f in L.audit_type() if f.name != L.CORRUPT]
    return rows.select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


_DECISION = "'{\"control_id\":\"C-' || i || '\",\"threat_ids\":[\"TH-01\"],\"action\":\"' || action || '\"'"
_MATCHES = "',\"matches\":[' || array_to_string(list_transform(range(1, {0} + 1), lambda j: '{{\"kind\":\"word\",\"segment_idx\":' || j || ',\"masked\":\"m' || j || '\"}}'), ',') || ']}}'"
_LINE = "'{{\"ts\":\"' || ts || '\",\"event_id\":\"evt-' || event_id || '\",\"type\":\"request\",\"endpoint\":\"' || event_type || '\",\"identity\":\"u' || user_id || '\",\"final_action\":\"' || action || '\",\"decisions\":[' || array_to_string(list_transform(range(1, n + 1), lambda i: {0}), ',') || ']'"
_NOTE = "',\"error\":\" [event truncated]\"'"


def _form(reason: str, matches: str, note: bool) -> str:
    decision = f"{_DECISION} || ',\"severity\":\"' || severity || '\",\"reason\":\"' || {reason} || '\"' || {_MATCHES.format(matches)}"
    return f"{_LINE.format(decision)} || {_NOTE + ' || ' if note else ''}',\"detail\":\"{{\\\"user\\\":' || user_id || '}}\"}}'"


def _case(of: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in of.items()) + " END"


LINES_SQL = f"""e AS (SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS ts, user_id, event_type, {_case(ACTION_OF)} AS action, {_case(SEVERITY_OF)} AS severity,
  CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k, event_id % 6 + 1 AS m, user_id % 3 + 1 AS n FROM events),
f AS (SELECT event_id, action, {_form("repeat('r', k * 4)", "m", False)} AS l0, {_form("repeat('r', k * 4)", "1", True)} AS l1, {_form("left(repeat('r', k * 4), 200)", "1", True)} AS l2, {_LINE.format(_DECISION + " || '}}'").replace("}}'", "}'")} || {_NOTE} || '}}' AS l3 FROM e),
lines AS (SELECT event_id, action, CASE WHEN strlen(l0) <= {LIMIT} THEN 0 WHEN strlen(l1) <= {LIMIT} THEN 1 WHEN strlen(l2) <= {LIMIT} THEN 2 ELSE 3 END AS step,
  CASE WHEN strlen(l0) <= {LIMIT} THEN l0 WHEN strlen(l1) <= {LIMIT} THEN l1 WHEN strlen(l2) <= {LIMIT} THEN l2 ELSE l3 END AS line FROM f)"""


@register("audit_lines", f"WITH {LINES_SQL} SELECT event_id, step, md5(line) AS line_md5 FROM lines")
def audit_lines(spark, sf_dir):
    """A4, A5: events as lines of at most 900 bytes, and what each gave up for that."""
    lines = L.bounded(audit_events(table(spark, sf_dir, "events")), LIMIT)
    return lines.select(F.substring("event_id", 5, 20).cast("long").alias("event_id"), "step", F.md5("line").alias("line_md5"))


@register("audit_log_read", f"""WITH {LINES_SQL}, r AS (SELECT action AS final_action, step, n FROM lines JOIN (SELECT event_id, n, event_id % 50 = 0 AS broken FROM e JOIN lines USING (event_id)) USING (event_id) WHERE NOT broken)
SELECT final_action, step > 0 AS truncated, count(*) AS events, CAST(sum(n) AS BIGINT) AS decisions FROM r GROUP BY ALL UNION ALL SELECT 'unreadable', false, count(*), 0 FROM e WHERE event_id % 50 = 0""")
def audit_log_read(spark, sf_dir):
    """The log written in rotated files of a thousand lines and read again; every fiftieth line is cut off in the middle."""
    lines = L.bounded(audit_events(table(spark, sf_dir, "events")), LIMIT)
    cut = F.substring("event_id", 5, 20).cast("long") % 50 == 0
    path = fresh_path(spark, "audit-log")
    L.write_lines(lines.withColumn("line", F.when(cut, F.left("line", F.floor(F.length("line") / 2).cast("int"))).otherwise(F.col("line"))), path, 1000)
    # One scan: Spark reads the corrupt column only beside another.
    read = L.scan(spark, path)
    whole = F.col(L.CORRUPT).isNull()
    action, truncated = F.when(whole, F.col("final_action")).otherwise("unreadable"), whole & F.coalesce(F.contains("error", F.lit("[event truncated]")), F.lit(False))
    counted = read.groupBy(action.alias("final_action"), truncated.alias("truncated"))
    return counted.agg(F.count("*").alias("events"), F.coalesce(F.sum(F.when(whole, F.size("decisions"))), F.lit(0)).cast("long").alias("decisions"))


@register("followed_events", "SELECT event_type AS endpoint, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1")
def followed_events(spark, sf_dir):
    """The log as a stream. It lands in four batches or more, each of which repeats the last two hours of
    the one before; a listener drops the repeats by id and appends what is new to a log of its own, which is read at the end."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    bounds = events.agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n")).first()  # one row
    log, copy, checkpoint = (fresh_path(spark, name) for name in ("landed", "followed", "position"))
    if bounds.first is None:
        return events.groupBy(F.col("event_type").alias("endpoint")).agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))
    number = batches(bounds.n, bounds.last - bounds.first)
    step = (bounds.last - bounds.first) / number
    for n in range(number):
        after, until = F.lit(bounds.first + n * step), F.lit(bounds.first + (n + 1) * step)
        landing = events.where((F.col("ts") >= after - F.lit(OVERLAP)) & ((F.col("ts") < until) | F.lit(n == number - 1)))
        # Dealt as rows of the table: an input file of few MB holds more events than one task can sort as audit events.
        L.append(audit_events(landing.repartitionByRange(-(-landing.count() // TASK) or 1, "ts", "event_id")), log)
        # Each call takes what has landed since the last one, as one batch, from where the checkpoint says.
        L.follow(L.tail(spark, log, "3 hours", clean=True).drop("at"), copy, checkpoint).start().awaitTermination()
        release_shuffles(spark)
    return L.events(L.scan(spark, copy)).groupBy("endpoint").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


def batches(events: int, time: timedelta) -> int:
    """Batches of ``LANDING`` events, about, four at least; none is shorter than what the next one repeats, if they are more."""
    return max(4, min(-(-events // LANDING), time // OVERLAP))


@register("audit_projection", """SELECT event_id, 'u' || user_id AS identity, user_id % 3 + 1 AS decisions, CAST((user_id % 3 + 1) * (event_id % 6 + 1) AS BIGINT) AS matches, 0 AS masked, '{"user":' || user_id || '}' AS detail FROM events""")
def audit_projection(spark, sf_dir):
    """Events without content: matches stay, what matched goes, and so do arguments."""
    events = audit_events(table(spark, sf_dir, "events")).withColumn("decisions", L.without_content(F.col("decisions")))
    matches = F.flatten(F.col("decisions.matches"))
    return events.select(
        F.substring("event_id", 5, 20).cast("long").alias("event_id"), "identity", F.size("decisions").cast("long").alias("decisions"), F.size(matches).cast("long").alias("matches"),
        F.size(F.filter(matches, lambda m: m["masked"].isNotNull())).alias("masked"), "detail",
    )
