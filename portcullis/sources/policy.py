"""Policies as small dimension tables."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _named(section: object, key: str) -> list[tuple[str, dict]]:
    """Entries of a section, which is a map by name or a list of maps with a name."""
    if isinstance(section, dict):
        return [(k, v or {}) for k, v in section.items()]
    return [(v.get(key), v) for v in section or ()]


#: Kinds of grants by the names that a role's lists have.
GRANTS = {"models": "models", "tools": "tools", "memory_namespaces": "namespaces", "namespaces": "namespaces", "may_delegate_to": "roles"}


def load(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """The tables of a YAML policy, and its version."""
    import yaml

    policy = yaml.safe_load(text) or {}
    version = hashlib.sha256(text.encode()).hexdigest()[:12]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    roles = _named(policy.get("roles"), "id")
    controls = _named(policy.get("controls"), "id")
    text_of = lambda m: {k: str(v) for k, v in (m or {}).items()}
    names = lambda section, key="name": frame([(n,) for n, _ in _named(section, key)], "name string")
    return {
        "version": frame([(version,)], "version string"),
        "identities": frame([(k, v.get("role"), v.get("profile")) for k, v in _named(policy.get("identities"), "id")], "identity string, role string, profile string"),
        "roles": frame([(r, v.get("budget")) for r, v in roles], "role string, budget string"),
        "grants": frame([(r, kind, g) for r, v in roles for name, kind in GRANTS.items() for g in v.get(name, [])], "role string, kind string, grant string"),
        "tools": frame([(k, v.get("privilege"), v.get("backend_url_env"), v.get("mcp_server")) for k, v in _named(policy.get("tools"), "name")], "name string, privilege string, backend string, server string"),
        "models": names(policy.get("models")),
        "servers": names(policy.get("mcp_servers")),
        "budgets": names(policy.get("budgets")),
        "namespaces": names((policy.get("memory") or {}).get("namespaces")),
        "controls": frame([(v.get("id", k), v.get("priority", 100), v.get("stages", []), text_of(v.get("params")) | ({"mode": v["mode"]} if "mode" in v else {})) for k, v in controls], "control_id string, priority int, stages array<string>, params map<string,string>"),
        "levels": frame([(v.get("id", k), p, text_of(x)) for k, v in controls for p, x in v.get("levels", {}).items()], "control_id string, profile string, level map<string,string>"),
    }


def _unknown(owners: DataFrame, owner: str, name: str, known: DataFrame, what: str) -> DataFrame:
    """References of ``owners`` that lead to nothing; ``*`` leads to all, null to none."""
    wanted = owners.where(F.col(name).isNotNull() & (F.col(name) != "*")).select(F.col(owner).alias("owner"), F.col(name).alias("name"))
    return wanted.join(known.toDF("name").distinct(), "name", "left_anti").select(F.lit(f"unknown {what}").alias("problem"), "owner", "name")


def _twice(rows: DataFrame, name: str, what: str) -> DataFrame:
    again = rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")
    return again.select(F.lit(f"duplicate {what}").alias("problem"), F.lit(None).cast("string").alias("owner"), F.col(name).alias("name"))


def problems(tables: dict[str, DataFrame]) -> DataFrame:
    """(problem, owner, name): what in a policy leads nowhere, stands there twice, or contradicts itself, each
    by an anti join or a count over the policy's tables. Tables that a policy lacks have no entries."""
    spark = next(iter(tables.values())).sparkSession
    schemas = {
        "identities": "identity string, role string", "roles": "role string, budget string", "grants": "role string, kind string, grant string", "tools": "name string, backend string, server string",
        "models": "name string", "servers": "name string", "budgets": "name string", "namespaces": "name string", "controls": "control_id string",
    }
    t = {name: tables[name] if name in tables else spark.createDataFrame([], schema) for name, schema in schemas.items()}
    roles = t["roles"].select("role")
    of = lambda kind: t["grants"].where(F.col("kind") == kind)
    found = [
        _unknown(t["identities"], "identity", "role", roles, "role"),
        t["identities"].where("role is null").select(F.lit("unknown role").alias("problem"), F.col("identity").alias("owner"), "role").toDF("problem", "owner", "name"),
        _unknown(t["roles"], "role", "budget", t["budgets"].select("name"), "budget"),
        _unknown(of("roles"), "role", "grant", roles, "role"),
        _unknown(of("tools"), "role", "grant", t["tools"].select("name"), "tool"),
        _unknown(of("models"), "role", "grant", t["models"].select("name"), "model"),
        _unknown(t["tools"].where("backend is null"), "name", "server", t["servers"].select("name"), "server"),
        _twice(t["identities"], "identity", "identity"), _twice(t["models"], "name", "model"), _twice(t["controls"], "control_id", "control"),
    ]
    if "namespaces" in tables:
        found.append(_unknown(of("namespaces"), "role", "grant", t["namespaces"].select("name"), "namespace"))
    alone = t["tools"].select(F.col("name").alias("owner"), "backend", "server")
    found.append(alone.where("(backend is null) = (server is null)").select(F.lit("one of backend and server").alias("problem"), "owner", F.col("server").alias("name")))
    wrong = (F.col("backend").isNull()) & F.col("server").isNotNull() & ~F.startswith("owner", F.concat("server", F.lit(".")))
    named = alone.where(wrong).join(t["servers"].select(F.col("name").alias("server")).distinct(), "server", "left_semi")
    found.append(named.select(F.lit("name of a server's tool").alias("problem"), "owner", F.col("server").alias("name")))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def resolved(controls: DataFrame, levels: DataFrame, profile: str, mode: str = "enforce", on_error: str = "fail_closed") -> DataFrame:
    """A control's parameters under a profile: the level's win; none if it is missing or disabled."""
    level = levels.where(F.col("profile") == profile).select("control_id", "level")
    merged = F.map_concat(F.map_filter("params", lambda k, _: ~F.map_contains_key(F.col("level"), k)), F.col("level"))
    joined = controls.join(level, "control_id").withColumn("config", merged)
    value = lambda key, default: F.coalesce(F.element_at("config", key), F.lit(default))
    return joined.where(value("enabled", "true") != "False").select("control_id", "priority", "stages", "config", value("mode", mode).alias("mode"), value("on_error", on_error).alias("on_error"))


def resolve_profile(requests: DataFrame, identities: DataFrame, active: str) -> DataFrame:
    """D3: the identity's own profile, or the active one."""
    own = identities.select("identity", F.col("profile").alias("__own"))
    return requests.join(own, "identity", "left").withColumn("profile", F.coalesce("__own", F.lit(active))).drop("__own")


def corpus_problems(examples: DataFrame) -> DataFrame:
    """A10: ids that occur twice, and labels that are missing."""
    twice = examples.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate id").alias("problem"), F.col("id").cast("string").alias("name"))
    labels = examples.sparkSession.createDataFrame([("attack",), ("benign",)], "label string").join(examples.select("label").distinct(), "label", "left_anti")
    return twice.unionByName(labels.select(F.lit("no example").alias("problem"), F.col("label").alias("name")))


def missing_vectors(examples: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Examples without a cached vector for the model and their text."""
    digest: Column = F.sha2("text", 256)
    held = cache.where(F.col("model") == model).select("id", F.col("digest"))
    return examples.withColumn("digest", digest).join(held, ["id", "digest"], "left_anti")
