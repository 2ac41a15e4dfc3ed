"""Arguments against JSON Schemas, compiled to column expressions over VARIANT.

A schema is turned into one expression that gives the first rule broken, as ``rule at path``, or null.
Objects and arrays are taken apart by maps and arrays of variants, so keys may hold any character and
rules for items run as higher-order functions; no row leaves the JVM and nothing is parsed twice.
Keywords that aren't listed here are no rules, as in the standard. References must be local and not go
round in a circle; a schema that can't be compiled raises before any row is read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from portcullis.functions.text import let

NUMBERS = r"^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT|SMALLINT|TINYINT)"


def as_type(value: Column, kind: str) -> Column:
    return F.call_function("try_variant_get", value, F.lit("$"), F.lit(kind))


def _number(value: Column) -> Column:
    return as_type(value, "double")


def kind_of(value: Column) -> Column:
    return F.call_function("schema_of_variant", value)


def is_type(value: Column, kind: Column, name: str) -> Column:
    """Whether a variant of this kind has a type of JSON Schema; whole numbers are integers however they are written."""
    if name == "integer":
        return kind.rlike(NUMBERS) & (_number(value) == F.floor(_number(value)))
    simple = {"string": kind == "STRING", "number": kind.rlike(NUMBERS), "boolean": kind == "BOOLEAN", "null": kind == "VOID", "object": F.startswith(kind, F.lit("OBJECT")), "array": F.startswith(kind, F.lit("ARRAY"))}
    if name not in simple:
        raise ValueError(f"unknown type {name}")
    return simple[name]


def _equal(value: Column, wanted: object) -> Column:
    """Whether a variant is this value; numbers are equal by value."""
    if isinstance(wanted, bool):
        return (kind_of(value) == "BOOLEAN") & (as_type(value, "boolean") == wanted)
    if isinstance(wanted, (int, float)):
        return kind_of(value).rlike(NUMBERS) & (_number(value) == float(wanted))
    if isinstance(wanted, str):
        return (kind_of(value) == "STRING") & (as_type(value, "string") == wanted)
    if wanted is None:
        return kind_of(value) == "VOID"
    return F.to_json(value) == json.dumps(wanted, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _among(value: Column, kind: Column, wanted: list) -> Column:
    """Whether a variant of this kind is one of these values; numbers and texts are looked up as a whole."""
    numbers = [float(x) + 0.0 for x in wanted if isinstance(x, (int, float)) and not isinstance(x, bool)]
    texts = [x for x in wanted if isinstance(x, str)]
    others = [_equal(value, x) for x in wanted if isinstance(x, bool) or not isinstance(x, (int, float, str))]
    # A zero is added so that a negative one is found as well.
    among = ([kind.rlike(NUMBERS) & (_number(value) + 0.0).isin(numbers)] if numbers else []) + ([(kind == "STRING") & as_type(value, "string").isin(texts)] if texts else [])
    return _any(among + others)


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _resolve(schema: dict, root: dict, seen: tuple) -> tuple[dict, tuple]:
    ref = schema["$ref"]
    if not ref.startswith("#") or ref in seen:
        raise ValueError(f"reference {ref}")
    found: object = root
    for step in ref[1:].strip("/").split("/") if ref != "#" else []:
        found = found[step.replace("~1", "/").replace("~0", "~")]
    return found, (*seen, ref)


def first_error(value: Column, schema: dict | bool, at: str = "$", root: dict | None = None, seen: tuple = ()) -> Column:
    """The first rule of ``schema`` that a variant breaks; null if it breaks none."""
    none = F.lit(None).cast("string")
    if isinstance(schema, bool):
        return none if schema else F.lit(f"nothing is allowed at {at}")
    root = schema if root is None else root
    if "$ref" in schema:
        schema, seen = _resolve(schema, root, seen)
    deeper = lambda v, s, where: first_error(v, s, where, root, seen)

    def checked(kind: Column, members: Column) -> Column:
        return F.coalesce(*_checks(value, kind, members, schema, at, deeper), none)

    members = lambda kind: F.when(F.startswith(kind, F.lit("OBJECT")), as_type(value, "map<string,variant>"))
    return let(kind_of(value), lambda kind: let(members(kind), lambda m: checked(kind, m)))


def _checks(value: Column, kind: Column, members: Column, schema: dict, at: str, deeper: Callable[[Column, dict | bool, str], Column]) -> list[Column]:
    """What each rule of a schema says about a variant of this kind, and with these members if it is an object."""
    says = lambda broken, rule: F.when(F.coalesce(broken, F.lit(False)), F.lit(f"{rule} at {at}"))
    checks: list[Column] = []
    if "type" in schema:
        names = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        checks.append(says(~F.coalesce(_any([is_type(value, kind, n) for n in names]), F.lit(False)), "type"))
    if "const" in schema:
        checks.append(says(~F.coalesce(_equal(value, schema["const"]), F.lit(False)), "const"))
    if "enum" in schema:
        checks.append(says(~F.coalesce(_among(value, kind, schema["enum"]), F.lit(False)), "enum"))
    text = F.when(kind == "STRING", as_type(value, "string"))
    checks += [says(broken(text, schema[rule]), rule) for rule, broken in TEXT_RULES.items() if rule in schema]
    is_number = kind.rlike(NUMBERS)
    checks += [says(is_number & broken(_number(value), float(schema[rule])), rule) for rule, broken in NUMBER_RULES.items() if rule in schema]
    items = F.when(F.startswith(kind, F.lit("ARRAY")), as_type(value, "array<variant>"))
    checks += [says(broken(items, schema[rule]), rule) for rule, broken in ITEM_RULES.items() if rule in schema]
    if "items" in schema:
        errors = F.filter(F.transform(items, lambda x: deeper(x, schema["items"], f"{at}[]")), lambda e: e.isNotNull())
        checks.append(F.try_element_at(errors, F.lit(1)))
    for key in schema.get("required", ()):
        checks.append(F.when(~F.map_contains_key(members, key), F.lit(f"required {key} at {at}")))
    checks += [says(broken(F.map_keys(members), schema[rule]), rule) for rule, broken in MEMBER_RULES.items() if rule in schema]
    for key, below in schema.get("properties", {}).items():
        checks.append(let(F.try_element_at(members, F.lit(key)), _member(below, f"{at}.{key}", deeper)))
    if (more := schema.get("additionalProperties", True)) is not True:
        own = F.array(*map(F.lit, schema.get("properties", {}))).cast("array<string>")
        others = F.map_filter(members, lambda k, _: ~F.array_contains(own, k))
        if more is False:
            checks.append(F.when(F.size(others) > 0, F.concat(F.lit("additional "), F.try_element_at(F.map_keys(others), F.lit(1)), F.lit(f" at {at}"))))
        else:
            errors = F.filter(F.transform(F.map_values(others), lambda x: deeper(x, more, f"{at}.*")), lambda e: e.isNotNull())
            checks.append(F.try_element_at(errors, F.lit(1)))
    checks += [deeper(value, each, at) for each in schema.get("allOf", ())]
    passed = lambda name: [deeper(value, each, at).isNull() for each in schema[name]]
    if "anyOf" in schema:
        checks.append(says(~_any(passed("anyOf")), "anyOf"))
    if "oneOf" in schema:
        checks.append(says(reduce(lambda a, b: a + b, [p.cast("int") for p in passed("oneOf")]) != 1, "oneOf"))
    if "not" in schema:
        checks.append(says(deeper(value, schema["not"], at).isNull(), "not"))
    return checks


def _member(schema: dict | bool, at: str, deeper: Callable[[Column, dict | bool, str], Column]) -> Callable[[Column], Column]:
    return lambda member: F.when(member.isNotNull(), deeper(member, schema, at))


TEXT_RULES = {
    "minLength": lambda text, n: F.length(text) < n,
    "maxLength": lambda text, n: F.length(text) > n,
    "pattern": lambda text, p: ~text.rlike(p),
}
NUMBER_RULES = {
    "minimum": lambda number, n: number < n,
    "maximum": lambda number, n: number > n,
    "exclusiveMinimum": lambda number, n: number <= n,
    "exclusiveMaximum": lambda number, n: number >= n,
    "multipleOf": lambda number, n: number / n != F.floor(number / n),
}
ITEM_RULES = {
    "minItems": lambda items, n: F.size(items) < n,
    "maxItems": lambda items, n: F.size(items) > n,
    "uniqueItems": lambda items, wanted: F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items) if wanted else F.lit(False),
}
MEMBER_RULES = {"minProperties": lambda keys, n: F.size(keys) < n, "maxProperties": lambda keys, n: F.size(keys) > n}


def argument_error(args: Column, schema: dict) -> Column:
    """What of a tool's schema its arguments (JSON text) break first; null arguments are an empty object."""
    judged = lambda parsed: F.when(parsed.isNull(), F.lit("not JSON")).otherwise(first_error(parsed, schema))
    return let(F.try_parse_json(F.coalesce(args, F.lit("{}"))), judged)
