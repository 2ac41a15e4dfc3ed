"""Grants and limits as joins: models, tools, namespaces, delegation, sign-in, supply chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions.text import let
from portcullis.operators.schemas import argument_error, as_type, kind_of

def sign_in(requests: DataFrame, keys: DataFrame) -> DataFrame:
    """The key's identity; a claimed agent must be it, except for admins."""
    joined = requests.join(keys, "key_hash", "left")
    outcome = (
        F.when(F.col("identity").isNull(), "unknown_key")
        .when(F.col("claimed").isNotNull() & (F.col("claimed") != F.col("identity")) & (F.col("role") != "admin"), "agent_mismatch")
        .otherwise("ok")
    )
    return joined.withColumns({"outcome": outcome, "acting_as": F.when(outcome == "ok", F.coalesce("claimed", "identity"))})


def granted(calls: DataFrame, grants: DataFrame, role: str, what: str) -> DataFrame:
    """calls whose role has a grant for the thing or for ``*``."""
    grants = grants.select(F.col("role").alias(role), F.col("grant"))
    everything = grants.where("grant = '*'").select(role).distinct()
    named = grants.where("grant <> '*'").withColumnRenamed("grant", what).distinct()
    marked = calls.join(everything.withColumn("__all", F.lit(True)), role, "left").join(named.withColumn("__one", F.lit(True)), [role, what], "left")
    return marked.withColumn("granted", F.coalesce("__all", F.lit(False)) | F.coalesce("__one", F.lit(False))).drop("__all", "__one")


def check_grant(calls: DataFrame, grants: DataFrame, declared: DataFrame, role: str, what: str) -> DataFrame:
    """The thing must be declared, then granted; without a role nothing is."""
    known = declared.select(F.col("name").alias(what)).distinct().withColumn("__declared", F.lit(True))
    joined = granted(calls, grants, role, what).join(known, what, "left")
    reason = F.when(F.col(what).isNull(), None).when(F.col("__declared").isNull(), "undeclared").when(~F.col("granted"), "not_granted")
    return joined.withColumns({"reason": reason, "action": F.when(reason.isNotNull(), "block").otherwise("allow")}).drop("__declared", "granted")


def widening(pairs: DataFrame, grants: DataFrame) -> DataFrame:
    """Grants that the target role has and the caller lacks; ``*`` covers all."""
    sets = grants.groupBy("role").agg(F.array_sort(F.collect_set("grant")).alias("grants"))
    none = F.array().cast("array<string>")
    joined = pairs.join(sets.select(F.col("role").alias("caller"), F.col("grants").alias("has")), "caller", "left").join(
        sets.select(F.col("role").alias("target"), F.col("grants").alias("wants")), "target", "left"
    )
    missing = F.when(F.array_contains(F.coalesce("has", none), "*"), none).otherwise(F.array_except(F.coalesce("wants", none), F.coalesce("has", none)))
    return joined.select("caller", "target", F.array_join(F.array_sort(missing), ",").alias("missing"), (F.size(missing) > 0).alias("widens"))


def delegation(calls: DataFrame, limit: int) -> DataFrame:
    """The depth is one more than the session's, or what the call claims if that is more."""
    depth = F.greatest(F.col("session_depth") + 1, F.coalesce(F.col("claimed_depth").try_cast("int"), F.lit(0)))
    return calls.withColumn("depth", depth).withColumn("action", F.when(F.col("depth") > limit, "block").otherwise("allow"))


def supply_chain(items: DataFrame, banned: DataFrame, text: str) -> DataFrame:
    """Banned models as part of the text, banned packages as whole words; one row for each hit.

    The list is a configuration of some dozens of terms, so it is made into literals of one expression.
    """
    terms = [(r["kind"], r["term"]) for r in banned.select("kind", "term").distinct().orderBy("kind", "term").collect()]
    none = F.lit(None).cast("struct<kind:string,term:string>")

    def hit(kind: str, term: str) -> Column:
        word = F.col(text).rlike(r"(?<![\p{L}\p{N}_])\Q" + term + r"\E(?![\p{L}\p{N}_])")
        return F.when(word if kind == "package" else F.contains(F.col(text), F.lit(term)), F.struct(F.lit(kind).alias("kind"), F.lit(term).alias("term"))).otherwise(none)

    hits = F.filter(F.array(*[hit(*t) for t in terms]) if terms else F.array().cast("array<struct<kind:string,term:string>>"), lambda x: x.isNotNull())
    return items.withColumn("__hit", F.explode(hits)).withColumns({"kind": F.col("__hit.kind"), "term": F.col("__hit.term")}).drop("__hit")


# Addresses that no argument may lead to, and keys that name a namespace.
METADATA, SCHEMES = ("169.254.169.254", "metadata.google.internal", "metadata.azure.com"), ("file://", "gopher://", "dict://")
NAMESPACE_KEYS = ("namespace", "memory_namespace", "ns")


def forbidden_target(args: Column) -> Column:
    """The first key with url or uri in its name whose value, a text, leads to cloud metadata or has a forbidden scheme."""
    members = as_type(F.try_parse_json(args), "map<string,variant>")
    entries = F.map_entries(F.coalesce(members, F.create_map().cast("map<string,variant>")))

    def bad(e: Column) -> Column:
        hit = lambda value: F.array_contains(F.array(*[F.contains(value, F.lit(x)) for x in METADATA], *[F.startswith(value, F.lit(x)) for x in SCHEMES]), True)
        return F.lower(e["key"]).rlike("url|uri") & (kind_of(e["value"]) == "STRING") & let(F.trim(F.lower(as_type(e["value"], "string"))), hit)

    return F.try_element_at(F.filter(entries, bad), F.lit(1))["key"]


def tool_calls(calls: DataFrame, grants: DataFrame, schemas: dict[str, dict], role: str = "role", tool: str = "tool", args: str = "args") -> DataFrame:
    """Grant, then arguments against the tool's schema, then targets; ``action``, ``severity``, ``reason`` of each call.

    A role without grants has none; a call without a tool is allowed.
    """
    broken = F.coalesce(*[F.when(F.col(tool) == name, argument_error(F.col(args), schema)) for name, schema in schemas.items()], F.lit(None).cast("string"))
    target = forbidden_target(F.col(args))
    marked = granted(calls, grants, role, tool)
    # Each is worked out once, and only where the ones before it are null.
    reason = F.when(F.col(tool).isNotNull(), F.coalesce(F.when(~F.col("granted"), "not_granted"), broken, F.concat(F.lit("target in "), target)))
    severity = F.when(F.col("reason") == "not_granted", "high").when(F.startswith("reason", F.lit("target")), "critical").when(F.col("reason").isNotNull(), "medium").otherwise("low")
    action = F.when(F.col("reason").isNotNull(), "block").otherwise("allow")
    return marked.withColumn("reason", reason).withColumns({"severity": severity, "action": action}).drop("granted")


def memory_access(calls: DataFrame, grants: DataFrame, namespaces: DataFrame, role: str = "role", args: str = "args") -> DataFrame:
    """The namespace is the first of its keys that is a text in the arguments; it must exist and be granted.
    Calls without one are allowed, also those of memory tools."""
    members = as_type(F.try_parse_json(F.col(args)), "map<string,variant>")

    def text(value: Column) -> Column:
        return F.when(kind_of(value) == "STRING", F.nullif(as_type(value, "string"), F.lit("")))

    named = calls.withColumn("namespace", let(members, lambda m: F.coalesce(*[let(F.try_element_at(m, F.lit(key)), text) for key in NAMESPACE_KEYS])))
    return check_grant(named, grants, namespaces, role, "namespace")


def retrieved_namespaces(segments: DataFrame, grants: DataFrame, request: str, role: str = "role") -> DataFrame:
    """Retrieved segments (origin, namespace) against the namespaces that the role may read: ``action``, the
    namespaces that it may not, in order, and the segments from them. Segments without a namespace, or from
    elsewhere, are no matter; requests without any are allowed."""
    asked = segments.withColumn("__in", F.when((F.col("origin") == "retrieved") & (F.col("namespace") != ""), F.col("namespace")))
    marked = granted(asked.drop("namespace").withColumnRenamed("__in", "namespace"), grants, role, "namespace")
    denied = F.col("namespace").isNotNull() & ~F.col("granted")
    found = marked.groupBy(request).agg(F.array_sort(F.collect_set(F.when(denied, F.col("namespace")))).alias("namespaces"), F.array_sort(F.collect_list(F.when(denied, F.col("segment")))).alias("segments"))
    return found.withColumn("action", F.when(F.size("namespaces") > 0, "block").otherwise("allow"))


def tickets(issued: DataFrame, used: DataFrame) -> DataFrame:
    """K4: a session opened with a ticket has the depth that the ticket carries, if it is more than its own, and is
    tainted if the one that issued it was. Unknown tickets change nothing."""
    carried = issued.select("ticket", F.col("depth").alias("__depth"), F.col("tainted").alias("__tainted"))
    joined = used.join(carried, "ticket", "left")
    return joined.withColumns({"depth": F.greatest("depth", F.coalesce("__depth", F.lit(0))), "tainted": F.col("tainted") | F.coalesce("__tainted", F.lit(False))}).drop("__depth", "__tainted")
