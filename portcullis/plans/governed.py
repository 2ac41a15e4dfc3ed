"""Documents and requests through the registered controls, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from portcullis.functions import text as T
from portcullis.operators import controls as K
from portcullis.operators import history as H
from portcullis.operators import scorers as M
from portcullis.plans import register
from portcullis.plans.access import SIGNATURE_SQL, SIGNATURES
from portcullis.plans.detection import ENGLISH_SQL, FOUND_SQL, PROSE_SQL
from portcullis.sources.tables import table

POLICY = {"C-SIZE": {"chars": 5000}, "C-PII-OUT": {"types": ("email", "credit_card", "ip_address")}, "C-INJ-PAT": {"signatures": SIGNATURES, "least": "high", "shadow": True}}


def _documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("request"), F.lit(0).alias("segment"), "text", F.col("text").alias("norm"), F.lit("retrieved").alias("origin"), F.lit("untrusted").alias("trust"), "lang")


@register(
    "governed_documents",
    f"""WITH {FOUND_SQL}, h AS ({SIGNATURE_SQL}), s AS (SELECT doc_id, max(r) AS r FROM h GROUP BY 1),
d AS (SELECT doc_id, lang, CASE WHEN length(text) > 5000 THEN 4 WHEN doc_id IN (SELECT doc_id FROM found) THEN 2 ELSE 0 END AS f,
  CASE WHEN doc_id IN (SELECT doc_id FROM s WHERE r >= 2) THEN 4 ELSE 0 END AS w FROM documents)
SELECT lang, CASE f WHEN 4 THEN 'block' WHEN 2 THEN 'redact' ELSE 'allow' END AS final_action, CASE WHEN w > f THEN 'block' END AS would_have_action, count(*) AS documents FROM d GROUP BY ALL""",
)
def governed_documents(spark, sf_dir):
    """Three controls, one of them in shadow mode, merged and counted by language."""
    segments = _documents(spark, sf_dir)
    merged = K.outcomes(segments, K.run(segments, "input", POLICY))
    return merged.join(segments.select("request", "lang"), "request").groupBy("lang", "final_action", "would_have_action").agg(F.count("*").alias("documents"))


@register("classifier_outcomes", f"""WITH g AS (SELECT {PROSE_SQL} AS prose, {ENGLISH_SQL} AS english, doc_id * 7 % 100 / 100.0 AS score, doc_id % 2 AS seen FROM documents)
SELECT CASE WHEN NOT prose OR NOT english THEN 'skipped' WHEN score >= 0.8 AND seen < 0.3 THEN 'held' WHEN score >= 0.8 THEN 'block' WHEN score >= 0.3 THEN 'grey' ELSE 'clean' END AS outcome, count(*) AS n FROM g GROUP BY 1""")
def classifier_outcomes(spark, sf_dir):
    """The gate over a score that stands in for a model's (a fixed rule on the number)."""
    segments = _documents(spark, sf_dir).withColumn("seen_risk", (F.col("request") % 2).cast("double"))
    gated = K.classifier_gate(segments, (F.col("request") * 7 % 100) / 100.0, 0.8, 0.3)
    return gated.groupBy("outcome").agg(F.count("*").alias("n"))


@register("judged_requests", """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS u, (conv_id * 3 + turn) % 10 / 10.0 AS risk, (conv_id + turn * 7) % 11 / 10.0 AS score FROM conversations),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY u DESC, turn DESC) AS k FROM c WHERE u = 1 OR risk BETWEEN 0.15 AND 0.85),
m AS (SELECT conv_id, max(CASE WHEN conv_id % 4 <> 0 THEN score END) AS score, max(risk) AS risk FROM g WHERE k <= 3 GROUP BY 1)
SELECT conv_id AS request, CASE WHEN score >= 0.7 THEN 'block' WHEN score IS NULL AND risk >= 0.8 THEN 'block' ELSE 'allow' END AS action FROM m""")
def judged_requests(spark, sf_dir):
    """Scores that stand in for a judge's; every fourth request has none."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("segment"), F.when(F.col("role") == "user", "untrusted").otherwise("trusted").alias("trust"), ((F.col("conv_id") * 3 + F.col("turn")) % 10 / 10.0).alias("risk"))
    verdicts = turns.where("request % 4 <> 0").select("request", "segment", ((F.col("request") + F.col("segment") * 7) % 11 / 10.0).alias("score"))
    return K.judged(turns, verdicts, 0.7).select("request", "action")


def _vowels():
    """A stand-in for a model: the share of vowels among a text's letters a to z; it fails on none."""

    def score(texts):
        return [(sum(c in "aeiou" for c in t) / max(1, sum("a" <= c <= "z" for c in t)), "vowels" if t[:1] in "aeiou" else "other") for t in texts]

    return score


@register("model_scores", """WITH v AS (SELECT doc_id, text, length(regexp_replace(text, '[^aeiou]', '', 'g')) / greatest(1, length(regexp_replace(text, '[^a-z]', '', 'g'))) AS score FROM documents)
SELECT doc_id, round(score, 9) AS score, CASE WHEN text IS NULL THEN NULL WHEN regexp_matches(text, '^[aeiou]') THEN 'vowels' WHEN text = '' THEN 'vowels' ELSE 'other' END AS label, CASE WHEN text IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM v""")
def model_scores(spark, sf_dir):
    """L3: a score and a label for each document from a scorer that is plugged in."""
    scored = M.scored(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _vowels)
    return scored.select("doc_id", F.round("score", 9).alias("score"), F.col("score_label").alias("label"), F.col("score_status").alias("status"))


@register("policy_in_force", """WITH r AS (SELECT event_id, ts FROM events WHERE event_type <> 'signup'), v AS (SELECT event_id AS version, ts FROM events WHERE event_type = 'signup' AND value < 90),
b AS (SELECT r.event_id, v.version, row_number() OVER (PARTITION BY r.event_id ORDER BY v.ts DESC NULLS LAST, v.version DESC) AS k FROM r ASOF LEFT JOIN v ON r.ts >= v.ts)
SELECT event_id, version FROM b WHERE k = 1""")
def policy_in_force(spark, sf_dir):
    """K5: sign-ups are new versions of a policy, valid unless their value is 90 or more; what each other event met."""
    events = table(spark, sf_dir, "events")
    versions = events.where("event_type = 'signup'").select("ts", F.col("event_id").alias("version"), (F.col("value") < 90).alias("good"))
    return H.in_force(events.where("event_type <> 'signup'").select("event_id", "ts"), versions, F.col("good")).select("event_id", "version")


@register("encoded_secrets", """WITH t AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'plain' WHEN length(text) % 3 = 1 THEN 'none' ELSE 'coded' END AS way FROM conversations WHERE text IS NOT NULL)
SELECT conv_id || '-' || turn AS request, CASE way WHEN 'plain' THEN 'redact' WHEN 'coded' THEN 'block' END AS action FROM t WHERE way <> 'none'""")
def encoded_secrets(spark, sf_dir):
    """A key in a turn is redacted; one that is hidden as base64 or hex can't be, and blocks."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    size, key = F.length("text"), F.concat(F.lit("key AKIA"), F.lpad((F.col("conv_id") * 7919 + F.col("turn")).cast("string"), 16, "Q"))
    raw = F.encode(key, "UTF-8")
    hidden = F.when(F.col("turn") % 2 == 0, F.base64(raw)).otherwise(F.lower(F.hex(raw)))
    said = F.when(size % 3 == 0, key).when(size % 3 == 1, F.lit("nothing to see")).otherwise(hidden)
    segments = T.segments(turns.select(F.concat_ws("-", "conv_id", "turn").alias("request"), said.alias("text"), F.lit("output").alias("origin")))
    return K.REGISTRY["C-SECRET-OUT"].transform(segments, {}).select("request", "action")
