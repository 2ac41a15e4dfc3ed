"""Access, segment, signature and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.operators import access as A
from portcullis.operators import segments as S
from portcullis.operators import signatures as G
from portcullis.operators import vectors as V
from portcullis.plans import register
from portcullis.plans.audit_view import values
from portcullis.sources.tables import table

GRANTS = [("MACHINERY", "1-URGENT"), ("MACHINERY", "2-HIGH"), ("BUILDING", "*"), ("AUTOMOBILE", "3-MEDIUM"), ("FURNITURE", "2-HIGH"), ("FURNITURE", "3-MEDIUM")]
TOOLS = [("1-URGENT",), ("2-HIGH",), ("3-MEDIUM",), ("5-LOW",)]
KEYS = [(str(i), f"agent-{i}", "admin" if i % 10 == 0 else "member") for i in range(0, 120)]
BANNED = [("package", "thon"), ("package", "event-stream"), ("model", "tionble")]
SIGNATURES = [
    {"id": "S-1", "severity": "low", "pattern": "(?i)the and"},
    {"id": "S-2", "severity": "medium", "pattern": "(?i)of to"},
    {"id": "S-3", "severity": "high", "pattern": "(?i)that is"},
    {"id": "S-4", "severity": "critical", "pattern": "(?i)and in the"},
]
GRANT_SQL = f"g(role, tool) AS ({values(GRANTS)}), t(tool) AS ({values(TOOLS)}), calls AS (SELECT o.o_orderkey, c.c_mktsegment AS role, o.o_orderpriority AS tool FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey)"
MESSAGES_SQL = "m AS (SELECT conv_id, turn, role, text, CASE WHEN turn % 2 = 0 THEN 'name-' || role END AS name FROM conversations)"


def _grants(spark):
    return spark.createDataFrame(GRANTS, "role string, grant string")


def _calls(spark, sf_dir):
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, orders.o_custkey == customers.c_custkey, "left").select("o_orderkey", F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("tool"))


@register("tool_acl_violations", f"""WITH {GRANT_SQL} SELECT o_orderkey, CASE WHEN tool NOT IN (SELECT tool FROM t) THEN 'undeclared' ELSE 'not_granted' END AS reason FROM calls
WHERE tool NOT IN (SELECT tool FROM t) OR NOT EXISTS (SELECT 1 FROM g WHERE g.role = calls.role AND g.tool IN (calls.tool, '*'))""")
def tool_acl_violations(spark, sf_dir):
    """E15, E2, E18, F3."""
    declared = spark.createDataFrame(TOOLS, "name string")
    return A.check_grant(_calls(spark, sf_dir), _grants(spark), declared, "role", "tool").where("action = 'block'").select("o_orderkey", "reason")


@register("tool_listing", f"WITH {GRANT_SQL} SELECT role, count(*) AS visible FROM (SELECT DISTINCT role FROM calls WHERE role IS NOT NULL) r, t WHERE EXISTS (SELECT 1 FROM g WHERE g.role = r.role AND g.tool IN (t.tool, '*')) GROUP BY role")
def tool_listing(spark, sf_dir):
    """The declared tools that each role sees."""
    roles = _calls(spark, sf_dir).select("role").where("role is not null").distinct()
    listed = roles.withColumn("tool", F.explode(F.array(*[F.lit(t) for (t,) in TOOLS])))
    return A.granted(listed, _grants(spark), "role", "tool").where("granted").groupBy("role").agg(F.count("*").alias("visible"))


@register("grant_widening", f"""WITH g(role, tool) AS ({values(GRANTS)}), r AS (SELECT DISTINCT c_mktsegment AS role FROM customer),
p AS (SELECT a.role AS caller, b.role AS target FROM r a, r b WHERE a.role <> b.role),
m AS (SELECT p.caller, p.target, g.tool FROM p JOIN g ON g.role = p.target WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.role = p.caller AND h.tool IN (g.tool, '*')))
SELECT p.caller, p.target, coalesce(string_agg(m.tool, ',' ORDER BY m.tool), '') AS missing, count(m.tool) > 0 AS widens FROM p LEFT JOIN m ON m.caller = p.caller AND m.target = p.target GROUP BY ALL""")
def grant_widening(spark, sf_dir):
    """What a role would gain by delegating to another."""
    roles = [r["role"] for r in table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("role")).distinct().collect()]  # a handful of roles
    pairs = spark.createDataFrame([(a, b) for a in roles for b in roles if a != b], "caller string, target string")
    return A.widening(pairs, _grants(spark))


@register("sign_in_outcomes", f"""WITH k(key, identity, role) AS ({values(KEYS)}), r AS (SELECT event_id, CAST(user_id AS VARCHAR) AS key, CASE WHEN event_id % 4 = 0 THEN 'agent-' || (event_id % 60) END AS claimed FROM events)
SELECT CASE WHEN identity IS NULL THEN 'unknown_key' WHEN claimed <> identity AND role <> 'admin' THEN 'agent_mismatch' ELSE 'ok' END AS outcome, count(*) AS n FROM r LEFT JOIN k USING (key) GROUP BY 1""")
def sign_in_outcomes(spark, sf_dir):
    """E1, F1."""
    claimed = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("agent-"), (F.col("event_id") % 60).cast("string")))
    requests = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key_hash"), claimed.alias("claimed"))
    return A.sign_in(requests, spark.createDataFrame(KEYS, "key_hash string, identity string, role string")).groupBy("outcome").agg(F.count("*").alias("n"))


@register("delegation_depth", """SELECT event_id, CAST(greatest(event_id % 3 + 1, coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 6, 0)) AS BIGINT) AS depth,
CASE WHEN greatest(event_id % 3 + 1, coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER) % 6, 0)) > 3 THEN 'block' ELSE 'allow' END AS action FROM events""")
def delegation_depth(spark, sf_dir):
    """Depth from the session and from the arguments (JSON)."""
    claimed = (F.get_json_object("props", "$.k").try_cast("int") % 6).cast("string")
    calls = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 3).alias("session_depth"), claimed.alias("claimed_depth"))
    return A.delegation(calls, 3).select("event_id", "depth", "action")


@register("supply_chain_hits", """SELECT doc_id, 'model' AS kind, 'tionble' AS term FROM documents WHERE contains(text, 'tionble')
UNION ALL SELECT doc_id, 'package', 'thon' FROM documents WHERE regexp_matches(text, '(?:^|[^\\p{L}\\p{N}_])thon(?:[^\\p{L}\\p{N}_]|$)')
UNION ALL SELECT doc_id, 'package', 'event-stream' FROM documents WHERE regexp_matches(text, '(?:^|[^\\p{L}\\p{N}_])event-stream(?:[^\\p{L}\\p{N}_]|$)')""")
def supply_chain_hits(spark, sf_dir):
    """E17, F6."""
    return A.supply_chain(table(spark, sf_dir, "documents").select("doc_id", "text"), spark.createDataFrame(BANNED, "kind string, term string"), "text").select("doc_id", "kind", "term")


@register("role_origin_trust", """SELECT CASE role WHEN 'system' THEN 'system' WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'tool' THEN 'tool_result' END AS origin,
CASE WHEN role = 'tool' THEN 'untrusted' ELSE 'trusted' END AS trust, count(*) AS n FROM conversations GROUP BY ALL""")
def role_origin_trust(spark, sf_dir):
    """B2, B3."""
    origin = S.origin_of(F.col("role"))
    return table(spark, sf_dir, "conversations").groupBy(origin.alias("origin"), S.trust_of(origin).alias("trust")).agg(F.count("*").alias("n"))


def _segments(spark, sf_dir):
    messages = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "role", "text", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("name-"), "role")).alias("name"))
    return S.flatten(messages, "conv_id")


@register("flattened_segments", f"""WITH {MESSAGES_SQL}, f AS (SELECT conv_id, turn, 0 AS field, text FROM m UNION ALL SELECT conv_id, turn, 1, name FROM m WHERE name IS NOT NULL)
SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY field, turn) - 1 AS INTEGER) AS segment, md5(text) AS text_md5 FROM f WHERE text IS NOT NULL AND trim(text) <> ''""")
def flattened_segments(spark, sf_dir):
    """B1, B11."""
    return _segments(spark, sf_dir).select("conv_id", "segment", F.md5("text").alias("text_md5"))


@register("rejoined_messages", "SELECT conv_id, md5(string_agg(text, chr(30) ORDER BY turn)) AS text_md5, count(*) AS messages FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id")
def rejoined_messages(spark, sf_dir):
    """B13."""
    return S.rejoin(_segments(spark, sf_dir), "conv_id").select("conv_id", F.md5(F.array_join("messages", "\x1e")).alias("text_md5"), F.size("messages").cast("long").alias("messages"))


@register("overflow_segments", """WITH r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn DESC) AS k FROM conversations)
SELECT conv_id, CAST(k AS INTEGER) AS segment, md5(text) AS text_md5 FROM r WHERE k <= 4 UNION ALL SELECT conv_id, 0, md5(string_agg(text, chr(10) ORDER BY k DESC)) FROM r WHERE k > 4 GROUP BY conv_id""")
def overflow_segments(spark, sf_dir):
    """The four longest stay."""
    leaves = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("leaf"), "text")
    return S.overflow(leaves, "conv_id", 4).select("conv_id", "segment", F.md5("text").alias("text_md5"))


@register("token_estimate_by_conversation", "SELECT conv_id, CAST(sum(length(text) // 4) AS BIGINT) AS at_ingress, CAST(sum(length(text)) // 4 AS BIGINT) AS afterwards FROM conversations GROUP BY 1")
def token_estimate_by_conversation(spark, sf_dir):
    """Floored for each segment, or once."""
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.floor(F.length("text") / 4)).cast("long").alias("at_ingress"), F.floor(F.sum(F.length("text")) / 4).cast("long").alias("afterwards"))


@register("usage_costs", """WITH u AS (SELECT conv_id, sum(length(text)) FILTER (role <> 'assistant') // 4 AS prompt, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) // 4 AS completion FROM conversations GROUP BY 1)
SELECT conv_id, CAST(prompt AS BIGINT) AS prompt, CAST(completion AS BIGINT) AS completion, round(prompt / 1000 * 0.15 + completion / 1000 * 0.6, 8) AS cost_usd FROM u""")
def usage_costs(spark, sf_dir):
    """B15."""
    size = F.length("text")
    chars = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.sum(F.when(F.col("role") != "assistant", size)).alias("prompt_chars"), F.coalesce(F.sum(F.when(F.col("role") == "assistant", size)), F.lit(0)).alias("completion_chars")
    )
    requests = chars.withColumns({"prompt_tokens": F.lit(0), "completion_tokens": F.lit(None).cast("int")})
    return S.usage(requests, 0.15, 0.6).select("conv_id", "prompt", "completion", "cost_usd")


@register("judge_candidates", """WITH o AS (SELECT conv_id, text, max(turn) AS turn, max(CAST(role = 'user' AS INTEGER)) AS untrusted FROM conversations GROUP BY ALL)
SELECT conv_id, CAST(k AS INTEGER) AS place, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY untrusted DESC, turn DESC) AS k FROM o) WHERE k <= 3""")
def judge_candidates(spark, sf_dir):
    """I4, I5, with the users' turns as the untrusted ones."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "text", F.col("turn").alias("segment"), F.when(F.col("role") == "user", "untrusted").otherwise("trusted").alias("trust"))
    return S.judge_candidates(rows, "conv_id").select("conv_id", "place", F.md5("text").alias("text_md5"))


SIGNATURE_SQL = "\n UNION ALL ".join(f"SELECT doc_id, '{s['id']}' AS id, {('low', 'medium', 'high', 'critical').index(s['severity'])} AS r, {G.RISK[s['severity']]} AS risk FROM documents WHERE regexp_matches(text, '{s['pattern']}')" for s in SIGNATURES)


@register("signature_control", f"""WITH h AS ({SIGNATURE_SQL}), g AS (SELECT doc_id, least(1.0, round(sum(risk), 6)) AS risk, max(r) AS r, list(id ORDER BY r DESC, id) AS ids FROM h GROUP BY 1)
SELECT doc_id, CAST(risk AS DOUBLE) AS risk, CASE r WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity, 'TH-02' AS threat,
array_to_string(ids[1:3], ', ') || CASE WHEN len(ids) > 3 THEN ' +' || (len(ids) - 3) || ' more' ELSE '' END AS reason, CASE WHEN r >= 1 THEN 'block' ELSE 'allow' END AS action FROM g""")
def signature_control(spark, sf_dir):
    """Retrieved documents against a feed of patterns."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("norm"), F.lit("retrieved").alias("origin"))
    return G.pattern_control(docs, "doc_id", SIGNATURES, "medium")


@register("canary_hits", "SELECT doc_id FROM documents WHERE contains(text, 'Apache License') OR contains(text, 'GNU General')")
def canary_hits(spark, sf_dir):
    """E14, with license names as the planted tokens."""
    return G.canary(table(spark, sf_dir, "documents"), ["Apache License", "GNU General"]).select("doc_id")


@register("weighted_patterns", "SELECT doc_id, greatest(CASE WHEN regexp_matches(text, 'the and') THEN 0.3 ELSE 0.0 END, CASE WHEN regexp_matches(text, 'that is') THEN 0.9 ELSE 0.0 END) > 0.5 AS judged FROM documents")
def weighted_patterns(spark, sf_dir):
    """E23."""
    score = G.weighted_score(F.col("text"), {"the and": 0.3, "that is": 0.9})
    return table(spark, sf_dir, "documents").select("doc_id", (score > 0.5).alias("judged"))


# Queries and examples are parts of one table here: vectors with a number divisible by 5 are examples.
DOT = "round(list_sum(list_transform(range(1, 65), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(e.embedding[i] AS DOUBLE))), 6)"


def _margin_sql(query: str, exclude: str) -> str:
    return f"""s AS (SELECT q.vec_id AS query, q.label AS query_label, CASE WHEN e.label < 5 THEN 'attack' ELSE 'benign' END AS label, e.vec_id AS example, {DOT} AS score
  FROM embeddings q JOIN embeddings e ON e.vec_id % 5 = 0 WHERE {query} AND NOT ({exclude})),
t AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY score DESC, example) AS k FROM s),
m AS (SELECT query, any_value(query_label) AS query_label, round(avg(score) FILTER (label = 'attack'), 6) AS attack, round(avg(score) FILTER (label = 'benign'), 6) AS benign, max(example) FILTER (label = 'attack' AND k = 1) AS nearest FROM t WHERE k <= 3 GROUP BY query),
r AS (SELECT *, round(attack - benign, 6) AS margin FROM m)"""


def _vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    examples = rows.where("vec_id % 5 = 0").select(F.when(F.col("label") < 5, "attack").otherwise("benign").alias("label"), F.col("vec_id").alias("example"), F.col("embedding").alias("example_vector"), F.col("label").alias("group"))
    return rows.select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"), F.col("label").alias("query_group")), examples


@register("embedding_topk_margin", f"WITH {_margin_sql('q.vec_id % 5 <> 0', 'false')} SELECT query, attack, benign, nearest, margin FROM r")
def embedding_topk_margin(spark, sf_dir):
    """Means of the three nearest examples with either label."""
    queries, examples = _vectors(spark, sf_dir)
    return V.margins(queries.where("query % 5 <> 0"), examples)


@register("embedding_verdict", f"WITH {_margin_sql('q.vec_id % 5 <> 0', 'false')} SELECT CASE WHEN attack >= 0.4 AND margin >= 0.07 THEN 'block' WHEN attack >= 0.3 AND margin >= 0.03 THEN 'grey' ELSE 'clean' END AS verdict, count(*) AS n FROM r GROUP BY 1")
def embedding_verdict(spark, sf_dir):
    """E7."""
    return V.verdict(embedding_topk_margin(spark, sf_dir), 0.4, 0.07, 0.3, 0.03).groupBy("verdict").agg(F.count("*").alias("n"))


@register("leave_group_out", f"WITH {_margin_sql('q.vec_id % 5 = 0', 'e.vec_id = q.vec_id OR e.label = q.label')} SELECT query, attack, benign, nearest, margin FROM r")
def leave_group_out(spark, sf_dir):
    """F8: examples against the others, their own group left out."""
    queries, examples = _vectors(spark, sf_dir)
    return V.margins(queries.where("query % 5 = 0"), examples, leave_out=True)


# All pairs of the reference grid; what reaches either pair of thresholds is counted anew here, point by point.
CALIBRATE_SQL = f"""WITH {_margin_sql('q.vec_id % 5 <> 0', 'false')},
g AS (SELECT CAST(s AS DOUBLE) / 100 AS sim, CAST(m AS DOUBLE) / 100 AS gap FROM range(40, 96) a(s), range(0, 41) b(m)),
p AS (SELECT query_label < 5 AS is_attack, attack, margin, count(*) AS n FROM r GROUP BY ALL),
z AS (SELECT CAST(sum(n) FILTER (is_attack) AS DOUBLE) AS attacks, CAST(sum(n) FILTER (NOT is_attack) AS DOUBLE) AS benigns FROM p),
x AS (SELECT sim, gap, coalesce(sum(n) FILTER (is_attack), 0) / any_value(z.attacks) AS recall, coalesce(sum(n) FILTER (NOT is_attack), 0) / any_value(z.benigns) AS rate FROM g CROSS JOIN z LEFT JOIN p ON p.attack >= sim AND p.margin >= gap GROUP BY sim, gap),
b AS (SELECT * FROM x WHERE rate <= 0.02 ORDER BY recall DESC, sim + gap DESC, sim DESC, gap DESC LIMIT 1),
y AS (SELECT g.sim, g.gap, coalesce(sum(n) FILTER (is_attack), 0) / any_value(z.attacks) AS recall, coalesce(sum(n) FILTER (NOT is_attack), 0) / any_value(z.benigns) AS rate
  FROM g JOIN b ON g.sim <= b.sim CROSS JOIN z LEFT JOIN p ON (p.attack >= g.sim AND p.margin >= g.gap) OR (p.attack >= b.sim AND p.margin >= b.gap) GROUP BY g.sim, g.gap),
j AS (SELECT * FROM y WHERE rate <= 0.1 ORDER BY recall DESC, sim + gap DESC, sim DESC, gap DESC LIMIT 1)
SELECT b.sim AS sim_block, b.gap AS margin_block, j.sim AS sim_grey, j.gap AS margin_grey, round(b.recall, 6) AS block_recall, round(b.rate, 6) AS block_rate, round(j.recall, 6) AS total_recall, round(j.rate, 6) AS escalation FROM b, j"""


@register("calibrate_grid", CALIBRATE_SQL)
def calibrate_grid(spark, sf_dir):
    """Thresholds to block at 2 % of benign texts, and to ask a judge at 10 %, on the whole grid of 56 x 41."""
    scored = embedding_topk_margin(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query"), F.when(F.col("label") < 5, "attack").otherwise("benign").alias("label")), "query")
    return V.calibrate(scored, 0.02, 0.1)
