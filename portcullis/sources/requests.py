"""Recorded requests: parsing, leaves of JSON documents, verdicts of judges."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_CHAT = "model string, messages array<struct<role: string, content: string, name: string>>"


def parse_chat(body: Column) -> tuple[Column, Column]:
    """(request, error): an object with a model and at least one message."""
    parsed = F.from_json(body, _CHAT)
    error = (
        F.when(F.try_parse_json(body).isNull() | ~F.startswith(F.ltrim(body), F.lit("{")), "not a JSON object")
        .when(parsed["model"].isNull(), "model")
        .when(F.coalesce(F.size(parsed["messages"]), F.lit(0)) < 1, "messages")
        .when(F.exists(parsed["messages"], lambda m: m["role"].isNull()), "messages.role")
    )
    return F.when(error.isNull(), parsed), error


def parse_tool(body: Column) -> tuple[Column, Column]:
    """(tool, arguments as JSON text): arguments that are no object go under ``_value``."""
    arguments = F.get_json_object(body, "$.arguments")
    plain = F.when(F.startswith(F.ltrim(arguments), F.lit("{")), arguments).otherwise(F.concat(F.lit('{"_value":'), F.coalesce(F.when(F.try_parse_json(arguments).isNotNull(), arguments), F.to_json(F.array(arguments))), F.lit("}")))
    return F.get_json_object(body, "$.tool"), F.when(arguments.isNotNull(), plain).otherwise(F.lit("{}"))


def parse_rpc(body: Column) -> Column:
    """A JSON-RPC call's method; ``batch`` and ``invalid`` are refused."""
    version = F.get_json_object(body, "$.jsonrpc")
    return F.when(F.startswith(F.ltrim(body), F.lit("[")), "batch").when((version == "2.0") & F.get_json_object(body, "$.method").isNotNull(), F.get_json_object(body, "$.method")).otherwise("invalid")


def parse_verdict(reply: Column) -> Column:
    """A judge's answer from a lenient reply: fences are cut, the first object counts; a missing
    score is 0.9 for an injection and 0 otherwise; scores stay within 0 and 1."""
    inner = F.regexp_extract(F.regexp_replace(reply, r"```(?:json)?", ""), r"(?s)(\{.*?\})", 1)
    said = F.lower(F.coalesce(F.get_json_object(inner, "$.injection"), F.lit("false")))
    injection = said.isin("true", "yes", "1")
    score = F.coalesce(F.get_json_object(inner, "$.score").try_cast("double"), F.when(injection, 0.9).otherwise(0.0))
    return F.when(F.length(inner) > 0, F.struct(injection.alias("injection"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score")))


def proposed_calls(message: Column) -> Column:
    """Tool calls and the older single call; arguments that don't parse go under ``_unparsed``."""
    one = "struct<name: string, arguments: string>"
    calls = F.transform(F.from_json(F.get_json_object(message, "$.tool_calls"), f"array<struct<function: {one}>>"), lambda c: c["function"])
    legacy = F.from_json(F.get_json_object(message, "$.function_call"), one)
    every = F.concat(F.coalesce(calls, F.array().cast(f"array<{one}>")), F.when(legacy.isNotNull(), F.array(legacy)).otherwise(F.array().cast(f"array<{one}>")))
    parsed = lambda a: F.when(F.try_parse_json(a).isNotNull(), a).otherwise(F.to_json(F.struct(a.alias("_unparsed"))))
    return F.transform(every, lambda c: c.withField("arguments", parsed(c["arguments"])))


def _leaves(value: object, path: str, pointer: str) -> Iterator[tuple[str, str, str]]:
    if isinstance(value, str):
        if value.strip():
            yield path, value, pointer
    elif isinstance(value, dict):
        for key, below in value.items():
            yield from _leaves(below, f"{path}.{key}" if path else key, f"{pointer}/{key.replace('~', '~0').replace('/', '~1')}")
    elif isinstance(value, list):
        for i, below in enumerate(value):
            yield from _leaves(below, f"{path}[{i}]", f"{pointer}/{i}")


@F.udtf(returnType=T.StructType([T.StructField(n, T.StringType()) for n in ("path", "text", "pointer")]))
class JsonLeaves:
    """Every string of a JSON document that isn't blank, with its path, in order, and its
    pointer, which no key can confuse; text that is no JSON is one leaf without either."""

    def eval(self, document: str) -> Iterator[tuple[str | None, str, str | None]]:
        if document is None:
            return
        try:
            value = json.loads(document)
        except ValueError:
            if document.strip():
                yield None, document, None
            return
        yield from _leaves(value, "", "")


def _put(value: object, pointer: str, text: str) -> bool:
    """Write a text where a pointer leads, in place; False where there is nothing."""
    steps = [step.replace("~1", "/").replace("~0", "~") for step in pointer.split("/")[1:]]
    for n, step in enumerate(steps, 1):
        if isinstance(value, list) and step.isdigit() and int(step) < len(value):
            step = int(step)
        elif not (isinstance(value, dict) and step in value):
            return False
        if n == len(steps):
            value[step] = text
            return True
        value = value[step]
    return False


def _written(document: str | None, edits: list, keep: list[str]) -> tuple[str | None, int]:
    """The document with the edits, and the number of those that couldn't be written."""
    if document is None:
        return None, len(edits)
    try:
        value, original = json.loads(document), json.loads(document)
    except ValueError:  # one leaf, without a pointer
        whole = [e for e in edits if e["pointer"] is None]
        return (whole[-1]["text"] if whole else document), len(edits) - len(whole)
    lost = 0
    for edit in edits:
        if edit["pointer"] == "" and isinstance(value, str):
            value = edit["text"]
        elif not edit["pointer"] or not _put(value, edit["pointer"], edit["text"]):
            lost += 1
    if isinstance(value, dict):
        value |= {k: original[k] for k in keep if k in original}
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")), lost


def write_back(document: Column, edits: Column, keep: list[str] | None = None) -> Column:
    """struct<document, unwritable>: JSON text with new texts at the pointers of its leaves, all in one
    pass. ``edits`` is array<struct<pointer, text>>; top-level names in ``keep`` stay as they were. What can't be
    written is counted: a redaction that isn't carried out has to become a block."""
    kept = list(keep or ())

    @F.pandas_udf(T.StructType([T.StructField("document", T.StringType()), T.StructField("unwritable", T.IntegerType())]))
    def written(documents, edits):
        import pandas as pd

        return pd.DataFrame([_written(d, [] if e is None else list(e), kept) for d, e in zip(documents, edits, strict=True)], columns=["document", "unwritable"])

    return written(document, edits)


def redact_arguments(calls: DataFrame, key: str, args: str, redact: Callable[[Column], tuple[Column, Column]], keep: list[str] | None = None) -> DataFrame:
    """``calls`` with what a redaction makes of the strings in their arguments: ``redacted``
    (JSON text), ``n_redacted`` and ``action``: allow, redact, or block where a text can't be redacted in place.

    ``redact`` gives a text's redacted form and whether that can be done. Calls are known by ``key``.
    """
    leaves = calls.select(key, args).lateralJoin(JsonLeaves(F.col(args).outer()))
    text, possible = redact(F.col("text"))
    changed = leaves.select(key, "pointer", text.alias("now"), possible.alias("possible"), "text").where("now <> text or not possible")
    edits = changed.groupBy(key).agg(
        F.collect_list(F.when(F.col("possible"), F.struct("pointer", F.col("now").alias("text")))).alias("__edits"), F.count(F.when(~F.col("possible"), 1)).alias("__stuck")
    )
    found = calls.join(edits, key, "left").withColumn("__made", F.when(F.size("__edits") > 0, write_back(F.col(args), F.col("__edits"), keep)))
    stuck = F.coalesce("__stuck", F.lit(0)) + F.coalesce("__made.unwritable", F.lit(0))
    n = F.coalesce(F.size("__edits"), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    action = F.when(stuck > 0, "block").when(n > 0, "redact").otherwise("allow")
    return found.withColumns({"redacted": F.coalesce("__made.document", args), "n_redacted": n, "action": action}).drop("__edits", "__stuck", "__made")


def is_description(path: Column) -> Column:
    """Leaves whose last key describes or titles something."""
    return F.regexp_extract(path, r"([^.\[\]]+)(?:\[\d+\])*$", 1).isin("description", "title")


@F.pandas_udf(T.StringType())
def arguments_hash(arguments):
    """SHA-256 of the arguments with sorted keys, whatever their order and spacing."""
    canonical = lambda a: hashlib.sha256(json.dumps(json.loads(a), sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    return arguments.map(canonical, na_action="ignore")
