"""Personal-data and secret detectors, and span redaction, without UDFs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portcullis.functions import checksums
from portcullis.functions.columns import mask

_digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
#: Account numbers of each country in groups of four, as long as that country's are: a word that follows isn't taken in.
IBAN = "|".join(f"{country}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for country, n in checksums.IBAN_LENGTHS.items())
#: kind -> (candidate pattern with one group, check of a candidate). Our own detector specification.
PERSONAL: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "email": (r"([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", None),
    "phone_pl": (r"(\+48[ -]?[0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{3}(?![0-9])|(?<![0-9 -])[0-9]{3}[ -][0-9]{3}[ -][0-9]{3}(?![0-9]|[ -][0-9]))", None),
    "pesel": (r"(?<![0-9])([0-9]{11})(?![0-9])", checksums.pesel),
    "nip": (r"(?<![0-9])([0-9]{10})(?![0-9])", checksums.nip),
    "regon": (r"(?<![0-9])([0-9]{9})(?![0-9])", checksums.regon),
    "id_card_pl": (r"(?<![A-Z0-9])([A-Z]{3}[0-9]{6})(?![0-9])", checksums.id_card),
    "iban": (rf"(?<![A-Z0-9])({IBAN})(?![A-Z0-9])", checksums.iban),
    "credit_card": (r"(?<![0-9-])([3-6](?:[ -]?[0-9]){12,18})(?![0-9-])", lambda c: checksums.luhn(_digits(c))),
    "ip_address": (r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9.])", checksums.ip_address),
}
SECRETS: dict[str, tuple[str, Callable[[Column], Column] | None]] = {
    "aws_access_key": (r"(?<![A-Z0-9])((?:AKIA|ASIA)[0-9A-Z]{16})(?![A-Z0-9])", None),
    "api_key_generic": (r"((?:api_key|token|secret)[\"']? ?[=:] ?[\"']?[A-Za-z0-9_-]{16,})", lambda c: ~F.contains(c, F.lit("canary"))),
    "private_key_block": (r"(-----BEGIN [A-Z ]*PRIVATE KEY-----)", None),
    "jwt": (r"(eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,})", None),
    "password_assignment": (r"([Pp]assword ?[=:] ?[^ \n]+)", None),
    "password_phrase": (r"([Pp]assword is [^ \n]+)", None),
}
INBOUND = ("email", "phone_pl", "pesel", "iban", "credit_card", "id_card_pl", "nip", "regon")
OUTBOUND = (*INBOUND, "ip_address")


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _valid(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda value: F.coalesce(check(value), F.lit(False))


def matches(text: Column, kinds: tuple[str, ...] | list[str], of: dict = PERSONAL) -> Column:
    """array<struct<kind, value>>: what the detectors find, each pattern in the order of the text."""
    found = []
    for kind in kinds:
        pattern, check = of[kind]
        values = F.regexp_extract_all(text, F.lit(pattern), 1)
        valid = F.filter(values, _valid(check)) if check else values
        found.append(F.transform(valid, _of_kind(kind)))
    return F.coalesce(F.concat(*found), F.array().cast("array<struct<kind:string,value:string>>"))


def located(text: Column, kinds: tuple[str, ...] | list[str], of: dict = PERSONAL) -> Column:
    """array<struct<kind, value, start, end>>: the matches with their places (from 0, end exclusive).

    The pattern itself cuts the text, so a place is where the detector matched: the lengths of what is left
    between the matches and of the matches before, summed.
    """
    return F.concat(*[_located(text, kind, *of[kind]) for kind in kinds])


def _located(text: Column, kind: str, pattern: str, check: Callable[[Column], Column] | None) -> Column:
    none = F.array().cast("array<struct<kind:string,value:string,start:int,end:int>>")

    def add(state: Column, one: Column) -> Column:
        start = (state["at"] + F.length(one["gap"])).cast("int")
        end = (start + F.length(one["value"])).cast("int")
        match = F.struct(F.lit(kind).alias("kind"), one["value"].alias("value"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(match)).alias("out"))

    values, gaps = F.regexp_extract_all(text, F.lit(pattern), 1), F.split(text, pattern, -1)
    pairs = F.zip_with(values, gaps, lambda value, gap: F.struct(value.alias("value"), gap.alias("gap")))
    matched = F.filter(F.when(text.rlike(pattern), pairs), lambda p: p["value"].isNotNull())  # the last gap has no match after it
    placed = F.coalesce(F.aggregate(matched, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda s: s["out"]), none)
    return F.filter(placed, lambda m: F.coalesce(check(m["value"]), F.lit(False))) if check else placed


def spans(found: Column) -> Column:
    """array<struct<start, end, kind>> of located matches, in the order of the text."""
    return F.array_sort(F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["kind"].alias("kind"))))


def merged_spans(found: Column) -> Column:
    """Overlapping spans as one, with the kind of the first; spans that only touch stay apart."""
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(done) > 0) & (span["start"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(
            F.concat(done, F.array(span))
        )

    return F.aggregate(F.array_sort(found), empty, add)


def redacted(text: Column, found: Column) -> Column:
    """The text with ``[REDACTED:kind]`` for each merged span."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def add(state: Column, span: Column) -> Column:
        before = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        return F.struct(F.concat(state["out"], before, F.lit("[REDACTED:"), span["kind"], F.lit("]")).alias("out"), span["end"].alias("at"))

    return F.aggregate(merged_spans(found), start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


PLACEHOLDER = r"[ \t]*<[A-Z0-9_]+>"
EVERY = {**PERSONAL, **SECRETS}


def labelled(text: Column, kinds: tuple[str, ...] | list[str] = tuple(EVERY), of: dict = EVERY) -> Column:
    """The text with ``<KIND>`` for what the detectors find. Of matches that overlap the first counts, of
    those that begin together the longest; the others leave no trace."""
    begin = lambda m: F.struct(m["start"].alias("start"), (-(m["end"] - m["start"])).alias("order"), m["end"].alias("end"), m["kind"].alias("kind"))
    ordered = F.array_sort(F.transform(located(text, kinds, of), begin))

    def add(state: Column, one: Column) -> Column:
        before = F.substring(text, state["at"] + 1, one["start"] - state["at"])
        return F.when(one["start"] < state["at"], state).otherwise(F.struct(F.concat(state["out"], before, F.lit("<"), F.upper(one["kind"]), F.lit(">")).alias("out"), one["end"].alias("at")))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(ordered, start, add, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def stripped(text: Column, kinds: tuple[str, ...] | list[str] = tuple(EVERY), of: dict = EVERY) -> Column:
    """The text without what the detectors find, the labels cut out with the blanks before them."""
    return F.regexp_replace(labelled(text, kinds, of), PLACEHOLDER, "")


def unredactable(found: Column, length: Column) -> Column:
    """Whether a redact decision can't be carried out: no match, one without a span, one out of bounds."""
    return (F.size(found) == 0) | F.exists(found, lambda s: s["start"].isNull() | s["end"].isNull() | (s["start"] < 0) | (s["end"] > length) | (s["start"] >= s["end"]))


def scan(segments: DataFrame, text_column: str, kinds: tuple[str, ...] | list[str], of: dict = PERSONAL) -> DataFrame:
    """A row for each match in each segment: the segment's columns, ``kind``, ``value``, ``masked``."""
    exploded = segments.withColumn("__match", F.explode(matches(F.col(text_column), kinds, of)))
    return exploded.withColumns({"kind": F.col("__match.kind"), "value": F.col("__match.value"), "masked": mask(F.col("__match.value"))}).drop("__match")
