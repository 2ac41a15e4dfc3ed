"""Requests to text segments and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Roles of messages and where their text comes from.
ORIGINS = {"system": "system", "developer": "system", "user": "user", "assistant": "assistant", "tool": "tool_result", "function": "tool_result"}


def origin_of(role: Column) -> Column:
    """B2: null for a role that isn't known (the request is then in error)."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv]), role)


def trust_of(origin: Column) -> Column:
    """Tool results and retrieved texts are untrusted."""
    return F.when(origin.isin("tool_result", "retrieved"), "untrusted").otherwise("trusted")


def part_text(parts: Column) -> Column:
    """The texts and refusals of content parts, a line each."""
    said = F.transform(parts, lambda p: F.coalesce(p["text"], p["refusal"]))
    return F.array_join(F.filter(said, lambda t: t.isNotNull()), "\n")


def data_url_text(url: Column, limit: int = 100_000) -> Column:
    """The text of a textual data: address, base64 or percent-encoded; null otherwise."""
    head = F.regexp_extract(url, r"^data:(text/[a-z.+-]+|application/(?:json|xml))(?:;[a-z0-9=-]+)*?(;base64)?,", 0)
    body = F.substring(url, F.length(head) + 1, F.length(url))
    decoded = F.when(F.contains(head, F.lit(";base64,")), F.decode(F.try_to_binary(body, F.lit("base64")), "UTF-8")).otherwise(F.try_url_decode(body))
    return F.when(F.length(head) > 0, F.substring(decoded, 1, limit))


def flatten(messages: DataFrame, request: str) -> DataFrame:
    """B1: a segment for each message, then for each name, then for each tool description, numbered on.

    ``messages`` has idx, role, text, name; all of a request's segments in one order.
    """
    fields = F.array(F.struct(F.lit(0).alias("field"), F.col("text").alias("value")), F.struct(F.lit(1).alias("field"), F.col("name").alias("value")))
    rows = messages.withColumn("x", F.explode(F.filter(fields, lambda f: f["value"].isNotNull() & (F.trim(f["value"]) != "")))).select(request, "idx", "role", "x.field", F.col("x.value").alias("text"))
    order = Window.partitionBy(request).orderBy("field", "idx")
    numbered = rows.withColumn("segment", F.row_number().over(order) - 1).withColumn("origin", origin_of(F.col("role")))
    return numbered.withColumn("trust", trust_of(F.col("origin")))


def overflow(leaves: DataFrame, request: str, keep: int) -> DataFrame:
    """The longest ``keep`` leaves stay; the shorter ones are joined, by length, into segment 0."""
    order = Window.partitionBy(request).orderBy(F.length("text").desc(), F.col("leaf").desc())
    ranked = leaves.withColumn("rank", F.row_number().over(order))
    kept = ranked.where(F.col("rank") <= keep).select(request, F.col("rank").alias("segment"), "text")
    rest = F.expr("listagg(text, '\n') WITHIN GROUP (ORDER BY rank DESC)")
    joined = ranked.where(F.col("rank") > keep).groupBy(request).agg(rest.alias("text")).select(request, F.lit(0).alias("segment"), "text")
    return kept.unionByName(joined)


def usage(requests: DataFrame, prompt_price: float, completion_price: float) -> DataFrame:
    """Reported tokens, or a quarter of the characters; cost by price per thousand, to 8 places."""
    prompt = F.coalesce(F.nullif(F.col("prompt_tokens"), F.lit(0)), F.floor(F.col("prompt_chars") / 4))
    completion = F.coalesce(F.nullif(F.col("completion_tokens"), F.lit(0)), F.floor(F.col("completion_chars") / 4))
    return requests.withColumns({"prompt": prompt.cast("long"), "completion": completion.cast("long")}).withColumn(
        "cost_usd", F.round(F.col("prompt") / 1000 * prompt_price + F.col("completion") / 1000 * completion_price, 8)
    )


def rejoin(segments: DataFrame, request: str) -> DataFrame:
    """Redacted segments back to messages: of each request, its messages' texts in order."""
    order = F.array_sort(F.collect_list(F.struct("segment", "text")))
    return segments.where("field = 0").groupBy(request).agg(F.transform(order, lambda s: s["text"]).alias("messages"))


def judge_candidates(segments: DataFrame, request: str, cap: int = 3) -> DataFrame:
    """I4: distinct texts, untrusted ones first, later ones first."""
    once = segments.groupBy(request, "text").agg(F.max("segment").alias("segment"), F.max((F.col("trust") == "untrusted").cast("int")).alias("untrusted"))
    order = Window.partitionBy(request).orderBy(F.col("untrusted").desc(), F.col("segment").desc())
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)
