"""Policies, feeds and case files that the tables make: parts are a catalogue of tools, brands are controls, types are
profiles, customers are identities, nations are roles, documents are cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.operators import engine as E
from portcullis.operators import signatures as G
from portcullis.plans import register
from portcullis.sources import audit as L
from portcullis.sources import policy as Y
from portcullis.sources.tables import table

SEVERITY_SQL = "CASE WHEN p_size < 15 THEN 'low' WHEN p_size < 30 THEN 'medium' WHEN p_size < 40 THEN 'high' ELSE 'critical' END"
#: Brands as controls: stages are the types of their parts, parameters what their sizes are.
CONTROLS_SQL = "c AS (SELECT p_brand AS control_id, CAST(min(p_size) AS INTEGER) AS priority, list(DISTINCT p_type) AS stages, CAST(max(p_size) AS VARCHAR) AS size, CASE WHEN count(*) % 2 = 0 THEN 'shadow' ELSE 'enforce' END AS mode FROM part WHERE p_partkey % 4 < 3 GROUP BY 1)"
LEVELS_SQL = "l AS (SELECT p_brand AS control_id, p_type AS profile, count(*) % 3 > 0 AS enabled, CASE WHEN count(*) % 3 = 0 THEN 'False' ELSE 'True' END AS said, CAST(min(p_size) AS VARCHAR) AS size, CASE WHEN count(*) % 4 = 0 THEN 'shadow' END AS mode FROM part GROUP BY ALL)"


def _controls(spark, sf_dir):
    made = table(spark, sf_dir, "part").where("p_partkey % 4 < 3").groupBy(F.col("p_brand").alias("control_id"))
    mode = F.when(F.count("*") % 2 == 0, "shadow").otherwise("enforce")
    return made.agg(F.min("p_size").cast("int").alias("priority"), F.collect_set("p_type").alias("stages"), F.create_map(F.lit("size"), F.max("p_size").cast("string"), F.lit("mode"), mode).alias("params"))


def _levels(spark, sf_dir):
    n = F.count("*")
    made = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("control_id"), F.col("p_type").alias("profile"))
    own = F.map_filter(F.create_map(F.lit("size"), F.min("p_size").cast("string"), F.lit("mode"), F.when(n % 4 == 0, "shadow"), F.lit("enabled"), F.when(n % 3 == 0, "False").otherwise("True")), lambda _, v: v.isNotNull())
    return made.agg((n % 3 > 0).alias("enabled"), own.alias("level"))


@register("merged_feeds", f"SELECT id, feed, severity FROM (SELECT p_name AS id, p_brand AS feed, {SEVERITY_SQL} AS severity, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS k FROM part) WHERE k = 1")
def merged_feeds(spark, sf_dir):
    """Brands as feeds of signatures, with names that several of them have."""
    severity = F.when(F.col("p_size") < 15, "low").when(F.col("p_size") < 30, "medium").when(F.col("p_size") < 40, "high").otherwise("critical")
    feeds = table(spark, sf_dir, "part").select(F.col("p_name").alias("id"), F.col("p_brand").alias("feed"), F.col("p_partkey").alias("place"), severity.alias("severity"))
    return G.merge_feeds(feeds, ("feed", "place")).select("id", "feed", "severity")


@register("case_coverage", """WITH c AS (SELECT d.doc_id, unnest([d.source, d.lang]) AS control_id, CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive' ELSE 'edge' END AS kind FROM documents d JOIN labels l USING (doc_id))
SELECT control_id, count(*) FILTER (kind = 'negative') AS negative, count(*) FILTER (kind = 'positive') AS positive, count(*) FILTER (kind = 'edge') AS edge FROM c GROUP BY 1""")
def case_coverage(spark, sf_dir):
    """Labelled documents as cases of their source's and language's controls."""
    cases = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    kind = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("edge")
    return L.case_coverage(cases.select(F.col("doc_id").alias("id"), F.array("source", "lang").alias("controls"), kind.alias("kind")))


@register("level_configs", f"WITH {CONTROLS_SQL}, {LEVELS_SQL} SELECT c.control_id, l.profile, coalesce(l.mode, c.mode) AS mode, l.size AS value FROM c JOIN l USING (control_id) WHERE l.profile IN ('ECONOMY', 'SMALL') AND l.said <> 'False'")
def level_configs(spark, sf_dir):
    """Controls under two profiles: the level's parameters win, disabled levels have none."""
    controls, levels = _controls(spark, sf_dir), _levels(spark, sf_dir)
    under = lambda p: Y.resolved(controls, levels, p).select("control_id", F.lit(p).alias("profile"), "mode", F.col("config")["size"].alias("value"))
    return under("ECONOMY").unionByName(under("SMALL"))


@register("control_selection", f"""WITH {CONTROLS_SQL}, {LEVELS_SQL} SELECT control_id, CAST(row_number() OVER (ORDER BY priority, control_id) AS INTEGER) AS ordinal FROM c JOIN l USING (control_id)
WHERE profile = 'SMALL' AND enabled AND list_contains(stages, 'ECONOMY')""")
def control_selection(spark, sf_dir):
    """Controls that a profile enables in a stage, in their order."""
    return E.select_controls(_controls(spark, sf_dir), _levels(spark, sf_dir), F.lit("ECONOMY"), F.lit("SMALL")).select("control_id", "ordinal")


@register("missing_controls", "SELECT p_brand AS control_id, p_type AS profile FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE length(p_brand) = 8) GROUP BY ALL HAVING count(*) % 3 > 0")
def missing_controls(spark, sf_dir):
    """Levels that are enabled for controls that aren't registered: brands with a number of one digit."""
    registered = table(spark, sf_dir, "part").where("length(p_brand) = 8").select(F.col("p_brand").alias("control_id"))
    return E.missing_controls(_levels(spark, sf_dir), registered).select("control_id", "profile")


@register("controls_removed", """WITH o AS (SELECT p_brand || ' ' || p_name AS control_id FROM part WHERE p_size < 25 GROUP BY 1), n AS (SELECT p_brand || ' ' || p_name AS control_id FROM part WHERE p_size >= 25 GROUP BY 1)
SELECT coalesce(o.control_id, n.control_id) AS control_id, CASE WHEN n.control_id IS NULL THEN 'removed' WHEN o.control_id IS NULL THEN 'added' END AS change FROM o FULL JOIN n USING (control_id) WHERE o.control_id IS NULL OR n.control_id IS NULL""")
def controls_removed(spark, sf_dir):
    """Controls of an old policy (small parts) that the new one (large parts) lacks, and the other way."""
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("control_id"), "p_size")
    return E.changed_controls(parts.where("p_size < 25"), parts.where("p_size >= 25"))


POLICY_SQL = """identities AS (SELECT 'c' || (c_custkey % 900) AS identity, CASE WHEN c_custkey % 50 > 0 THEN 'r' || c_nationkey END AS role FROM customer),
roles AS (SELECT 'r' || n_nationkey AS role, 'b' || n_regionkey AS budget FROM nation WHERE n_nationkey % 6 < 5),
grants AS (SELECT 'r' || s_nationkey AS role, 'tools' AS kind, CASE WHEN s_suppkey % 20 = 0 THEN '*' ELSE 'n' || (s_suppkey % 7) || '.tool' || (s_suppkey % 90) END AS grant FROM supplier
  UNION ALL SELECT 'r' || s_nationkey, 'models', CAST(s_suppkey % 8 AS VARCHAR) FROM supplier UNION ALL SELECT 'r' || s_nationkey, 'roles', 'r' || (s_suppkey % 30) FROM supplier UNION ALL SELECT 'r' || s_nationkey, 'namespaces', 'm' || (s_suppkey % 4) FROM supplier),
tools AS (SELECT 'n' || (p_partkey % 7) || '.tool' || (p_partkey % 90) AS name, max(CASE WHEN p_partkey % 11 = 0 THEN 'URL' END) AS backend, max(CASE WHEN p_partkey % 13 > 0 THEN 'n' || (p_partkey % 7 % 6) END) AS server FROM part WHERE p_partkey < 500 GROUP BY 1)"""


@register("policy_problems", f"""WITH {POLICY_SQL}, servers AS (SELECT 'n' || i AS name FROM range(0, 5) t(i)), models AS (SELECT CAST(i AS VARCHAR) AS name FROM range(0, 6) t(i)),
budgets AS (SELECT 'b' || r_regionkey AS name FROM region WHERE r_regionkey < 4), namespaces AS (SELECT 'm' || i AS name FROM range(0, 3) t(i))
SELECT DISTINCT 'unknown role' AS problem, identity AS owner, role AS name FROM identities WHERE role IS NULL OR role NOT IN (SELECT role FROM roles)
UNION SELECT 'unknown budget', role, budget FROM roles WHERE budget NOT IN (SELECT name FROM budgets)
UNION SELECT 'unknown tool', role, grant FROM grants WHERE kind = 'tools' AND grant <> '*' AND grant NOT IN (SELECT name FROM tools)
UNION SELECT 'unknown model', role, grant FROM grants WHERE kind = 'models' AND grant NOT IN (SELECT name FROM models)
UNION SELECT 'unknown role', role, grant FROM grants WHERE kind = 'roles' AND grant NOT IN (SELECT role FROM roles)
UNION SELECT 'unknown namespace', role, grant FROM grants WHERE kind = 'namespaces' AND grant NOT IN (SELECT name FROM namespaces)
UNION SELECT 'unknown server', name, server FROM tools WHERE backend IS NULL AND server IS NOT NULL AND server NOT IN (SELECT name FROM servers)
UNION SELECT 'one of backend and server', name, server FROM tools WHERE (backend IS NULL) = (server IS NULL)
UNION SELECT 'name of a server''s tool', name, server FROM tools WHERE backend IS NULL AND server IN (SELECT name FROM servers) AND NOT starts_with(name, server || '.')
UNION SELECT 'duplicate identity', NULL, identity FROM identities GROUP BY identity HAVING count(*) > 1""")
def policy_problems(spark, sf_dir):
    """Cross-references of a policy that the tables make: what leads nowhere, stands twice or contradicts itself."""
    word = lambda mark, n: F.concat(F.lit(mark), n)
    suppliers, parts = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "part").where("p_partkey < 500")
    n = F.col("s_suppkey")
    tool = lambda k: F.concat(F.lit("n"), k % 7, F.lit(".tool"), k % 90)
    role = word("r", F.col("s_nationkey")).alias("role")
    grant = lambda kind, what: suppliers.select(role, F.lit(kind).alias("kind"), what.alias("grant"))
    grants = grant("tools", F.when(n % 20 == 0, "*").otherwise(tool(n))).unionByName(grant("models", (n % 8).cast("string"))).unionByName(grant("roles", word("r", n % 30))).unionByName(grant("namespaces", word("m", n % 4)))
    key = F.col("p_partkey")
    names = lambda mark, count: spark.range(count).select(word(mark, F.col("id")).alias("name"))
    return Y.problems({
        "identities": table(spark, sf_dir, "customer").select(word("c", F.col("c_custkey") % 900).alias("identity"), F.when(F.col("c_custkey") % 50 > 0, word("r", F.col("c_nationkey"))).alias("role")),
        "roles": table(spark, sf_dir, "nation").where("n_nationkey % 6 < 5").select(word("r", F.col("n_nationkey")).alias("role"), word("b", F.col("n_regionkey")).alias("budget")),
        "grants": grants,
        "tools": parts.groupBy(tool(key).alias("name")).agg(F.max(F.when(key % 11 == 0, "URL")).alias("backend"), F.max(F.when(key % 13 > 0, word("n", key % 7 % 6))).alias("server")),
        "models": names("", 6), "servers": names("n", 5), "namespaces": names("m", 3),
        "budgets": table(spark, sf_dir, "region").where("r_regionkey < 4").select(word("b", F.col("r_regionkey")).alias("name")),
    })


@register("uncached_examples", """SELECT doc_id AS id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL AND NOT (doc_id % 3 = 0 OR (doc_id % 3 = 1 AND length(text) % 2 = 0))""")
def uncached_examples(spark, sf_dir):
    """Examples whose vector isn't cached under their text: some never were, others have changed since."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    changed = F.when(F.length("text") % 2 == 1, F.concat(F.lit("old "), "text")).otherwise(F.col("text"))
    cache = docs.where("id % 3 < 2").select("id", F.sha2(F.when(F.col("id") % 3 == 1, changed).otherwise(F.col("text")), 256).alias("digest"), F.lit("m").alias("model"))
    return Y.missing_vectors(docs, cache, "m").select("id", "digest")
