"""The audit log: JSON lines in, JSON lines out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MATCH = "array<struct<kind: string, segment_idx: int, masked: string>>"
_DECISION = (
    f"array<struct<control_id: string, threat_ids: array<string>, action: string, severity: string, score: double, reason: string, matches: {_MATCH}, "
    "latency_ms: double, skipped: boolean, shadow_suppressed: boolean>>"
)
AUDIT_SCHEMA = (
    "ts string, event_id string, type string, request_id string, session_id string, endpoint string, identity string, role string, profile string, policy_version string, "
    f"feed_version string, model string, final_action string, would_have_action string, shadow boolean, upstream_called boolean, decisions {_DECISION}, "
    "latency_ms struct<total_overhead: double, upstream: double, per_control: map<string, double>>, "
    "usage struct<prompt_tokens: bigint, completion_tokens: bigint, cost_usd: double, compute_seconds: double>, error string, detail string"
)
CORRUPT = "_corrupt"


def audit_type() -> T.StructType:
    return T.StructType.fromDDL(f"{AUDIT_SCHEMA}, {CORRUPT} string")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All lines of the log and its rotations; lines that don't parse are kept apart in ``_corrupt``."""
    return spark.read.schema(audit_type()).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def events(lines: DataFrame) -> DataFrame:
    """The lines that parse, with the time as a timestamp beside its text."""
    return lines.where(F.col(CORRUPT).isNull() & F.col("event_id").isNotNull()).drop(CORRUPT).withColumn("at", F.to_timestamp("ts"))


def tail(spark: SparkSession, path: str, lateness: str = "2 seconds", clean: bool = False) -> DataFrame:
    """A stream of new events; batches of lines land as new files. Repeats within the lateness
    (ours: the source of these semantics has none) are dropped by id. With ``clean``, files that a batch before the
    last one has read are deleted."""
    lines = spark.readStream.schema(audit_type()).option("columnNameOfCorruptRecord", CORRUPT).option("cleanSource", "delete" if clean else "off").json(path)
    return events(lines).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def append(df: DataFrame, path: str, lines_per_file: int = 100_000) -> None:
    """One file for so many events at most, oldest first in each; compressed, as lines repeat one another's words."""
    df.sortWithinPartitions("ts", "event_id").write.mode("append").option("maxRecordsPerFile", lines_per_file).option("compression", "gzip").json(path)


def follow(stream: DataFrame, path: str, checkpoint: str):
    """Append each batch of a stream; returns the query's writer, not started."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: append(batch, path)).trigger(availableNow=True)


def retained(files: DataFrame, keep: int) -> DataFrame:
    """A3: rotated files to delete: all but the newest ``keep``. ``files`` has path, modified."""
    return files.withColumn("nth", F.row_number().over(Window.orderBy(F.col("modified").desc(), "path"))).where(F.col("nth") > keep).drop("nth")


# Fixed value: what of an approval a log without content keeps.
APPROVAL_KEYS = ("approval_id", "status", "decided_by", "control_id")


def without_content(decisions: Column) -> Column:
    """Decisions without what matched."""
    return F.transform(decisions, lambda d: d.withField("matches", F.transform(d["matches"], lambda m: m.withField("masked", F.lit(None).cast("string")))))


def detail_without_content(detail: Column) -> Column:
    """A5: an event's detail (JSON text) without arguments, and of an approval four keys; what is no object stays."""
    as_map = lambda v: F.call_function("try_variant_get", v, F.lit("$"), F.lit("map<string,variant>"))
    members = as_map(F.try_parse_json(detail))
    kept = F.map_filter(members, lambda k, _: k != "args")
    short = lambda v: F.parse_json(F.to_json(F.map_filter(as_map(v), lambda k, _: k.isin(*APPROVAL_KEYS))))
    shown = F.transform_values(kept, lambda k, v: F.when((k == "approval") & as_map(v).isNotNull(), short(v)).otherwise(v))
    return F.when(members.isNotNull(), F.to_json(shown)).otherwise(detail)


def bounded(df: DataFrame, limit: int) -> DataFrame:
    """A4: events as JSON lines of at most ``limit`` bytes where that can be, with ``step``, what was given up
    for it: 0 nothing, 1 all matches but one of each decision, 2 reasons beyond 200 characters, 3 all of the
    decisions but three fields, and the detail. A shortened line says so in its error. The shortest form is the
    last resort, whatever its size.

    Each form is made only if the one before is too long, in the order of ``CASE``.
    """
    columns = [c for c in df.columns if c != "at"]
    note = F.concat(F.coalesce(F.col("error"), F.lit("")), F.lit(" [event truncated]"))

    def line(decisions: Column, **over: Column) -> Column:
        return F.to_json(F.struct(*[over.get(c, decisions if c == "decisions" else F.col(c)).alias(c) for c in columns]))

    one = F.transform("decisions", lambda d: d.withField("matches", F.slice(d["matches"], 1, 1)))
    short = F.transform(one, lambda d: d.withField("reason", F.substring(d["reason"], 1, 200)))
    three = F.transform("decisions", lambda d: F.struct(d["control_id"].alias("control_id"), d["threat_ids"].alias("threat_ids"), d["action"].alias("action")))
    forms = [line(F.col("decisions")), line(one, error=note), line(short, error=note), line(three, detail=F.lit(None).cast("string"), error=note)]
    chosen = F.struct(F.lit(3).alias("step"), forms[3].alias("line"))
    for step in (2, 1, 0):
        chosen = F.when(F.octet_length(forms[step]) <= limit, F.struct(F.lit(step).alias("step"), forms[step].alias("line"))).otherwise(chosen)
    # A generated row is a barrier: the optimizer would make the forms anew for each of the two columns.
    return df.select("*", F.explode(F.array(chosen)).alias("__x")).select(*df.columns, "__x.step", "__x.line")


def write_lines(df: DataFrame, path: str, lines_per_file: int = 100_000) -> None:
    """The column ``line`` appended as a log, in files of so many lines at most, in the order of time."""
    df.sortWithinPartitions("ts", "event_id").select("line").write.mode("append").option("maxRecordsPerFile", lines_per_file).option("compression", "gzip").text(path)


def flat_decisions(audit: DataFrame) -> DataFrame:
    """A row for each decision of each event."""
    return audit.select("event_id", "request_id", "at", F.posexplode("decisions").alias("nth", "d")).select("event_id", "request_id", "at", "nth", "d.*")


def case_coverage(cases: DataFrame) -> DataFrame:
    """Cases by control and kind."""
    return cases.select(F.explode("controls").alias("control_id"), "kind").groupBy("control_id").pivot("kind", ["negative", "positive", "edge"]).count().na.fill(0)
