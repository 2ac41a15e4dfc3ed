"""Folding and decoding of texts.

The compatibility form has no built-in, so texts beyond ASCII go through an Arrow UDF for it; all else is
column expressions. Decoding is a table of codecs, each from a text to the array of texts that it may
stand for, and two rounds of it under one budget.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portcullis.functions.columns import ROT13_HINTS, ROTATED, rot13

# Look-alike letters and what they stand for (after case folding).
LOOK_ALIKES = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ї": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ϲ": "c",
}
# Characters without a glyph, digits that stand for letters, limits of decoding.
INVISIBLE = r"[\u0000-\u0008\u000b\u000c\u000e-\u001f\u007f-\u009f­᠎​-‏‪-‮⁠-⁤⁦-⁩﻿]"
LEET_FROM, LEET_TO = "0134578@$", "oieastbas"
BUDGET, LEAST_LENGTH, PRINTABLE = 16 * 1024, 4, 0.9

_ALIKE = str.maketrans(LOOK_ALIKES)
BEYOND_ASCII = r"[^\x00-\x7F]"
READING = "struct<size:int,place:int,text:string,codec:string>"


@F.pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def folded(text: str) -> str:
    """C2 of one text."""
    seen = re.sub(INVISIBLE, "", unicodedata.normalize("NFKC", text))
    return re.sub(r"\s+", " ", seen).strip().casefold().translate(_ALIKE)


@F.arrow_udf(T.StringType())
def _folded(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else folded(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(T.StructType([T.StructField("norm", T.StringType()), T.StructField("differs", T.BooleanType())]))
def _folded_and_compared(text: pa.Array) -> pa.Array:
    texts = text.to_pylist()
    norms = [None if t is None else folded(t) for t in texts]
    differ = [None if t is None else n.casefold() != t.casefold() for n, t in zip(norms, texts, strict=True)]
    return pa.StructArray.from_arrays([pa.array(norms, pa.string()), pa.array(differ, pa.bool_())], ["norm", "differs"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), body)[0]


def strip_invisible(text: Column | str) -> Column:
    """Compatibility form without characters that have no glyph; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(_compatible(F.when(text.rlike(BEYOND_ASCII), text)), text), INVISIBLE, "")


def _fold_ascii(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, INVISIBLE, ""), r"\s+", " ")))


def fold(text: Column | str) -> Column:
    """C1, white space to one space, case folded, look-alikes to Latin. One pass of Python: each UDF over what
    another made has Python workers of its own."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(_folded(F.when(text.rlike(BEYOND_ASCII), text)), _fold_ascii(text))


def with_fold(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``df`` with ``norm`` (C2) and ``differs``, whether that differs from the text in more than case, of one pass of Python."""
    text = F.col(f"`{text_column}`")
    made = df.withColumns({"__ascii": _fold_ascii(text), "__other": _folded_and_compared(F.when(text.rlike(BEYOND_ASCII), text))})
    found = {"norm": F.coalesce("__other.norm", "__ascii"), "differs": F.coalesce(F.col("__other.differs"), F.col("__ascii") != F.lower(text), F.lit(False))}
    return made.withColumns(found).drop("__ascii", "__other")


def readable(raw: Column) -> Column:
    """Bytes as text; null unless they are UTF-8, four characters or more and mostly printable."""
    text = F.call_function("try_validate_utf8", raw.cast("string"))
    shown = F.regexp_count(text, F.lit(r"[^\p{C}\p{Z}]|[ \r\n\t]"))
    return F.when((F.length(text) >= LEAST_LENGTH) & (shown >= PRINTABLE * F.length(text)), text)


def _runs(text: Column, *patterns: str) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"({p})"), 1) for p in patterns]))


def from_base64(text: Column) -> Column:
    """C4: runs of 16 characters or more, of either alphabet, padded as needed."""
    body = lambda run: F.translate(F.regexp_replace(run, "=+$", ""), "-_", "+/")
    whole = lambda b: F.rpad(b, (F.ceil(F.length(b) / 4) * 4).cast("int"), "=")
    return F.transform(_runs(text, "[A-Za-z0-9+/]{16,}={0,2}", "[A-Za-z0-9_-]{16,}={0,2}"), lambda run: readable(F.try_to_binary(whole(body(run)), F.lit("base64"))))


def from_hex(text: Column) -> Column:
    """Eight pairs of digits or more, or four with a backslash and x before each."""
    return F.transform(_runs(text, "(?:[0-9a-fA-F]{2}){8,}", r"(?:\\x[0-9a-fA-F]{2}){4,}"), lambda run: readable(F.unhex(F.replace(run, F.lit("\\x"), F.lit("")))))


def from_url(text: Column) -> Column:
    """At least three escapes; a plus stays one, and so does a lone percent sign."""
    guarded = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), "%(?![0-9a-fA-F]{2})", "%25")
    return F.array(F.when(F.regexp_count(text, F.lit("%[0-9a-fA-F]{2}")) >= 3, F.try_url_decode(guarded)))


def from_leet(text: Column) -> Column:
    """Digits inside words to letters, if two words or more mix them."""
    mixed = lambda w: w.rlike("^[A-Za-z0134578]{3,}$") & w.rlike("[A-Za-z]") & w.rlike("[0134578]")
    plain = lambda w: F.when(mixed(w), F.translate(w, LEET_FROM, LEET_TO)).otherwise(w)
    return F.array(let(F.split(text, r"(?U)\b"), lambda words: F.when(F.size(F.filter(words, mixed)) >= 2, F.array_join(F.transform(words, plain), ""))))


def _rewritten(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """The text with each match changed where it stands: what lies between the matches, and the matches, in turn."""
    gaps, runs = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.array_join(F.concat(F.zip_with(F.slice(gaps, F.lit(1), F.size(runs)), runs, lambda gap, run: F.concat(gap, change(run))), F.slice(gaps, -1, 1)), "")


def from_spaced(text: Column) -> Column:
    """Letters that stand apart run together.

    Four letters or more with one mark between them, and a mark that ends the run, are a word. Where gaps of two
    blanks or more part words, each gap becomes one blank and what is spelled between gaps a word, if that saves
    three characters; else four letters or more with single blanks between them are a word.
    """

    def together(t: Column, pattern: str, mark: str) -> Column:
        return let(t, lambda own: F.when(own.rlike(pattern), _rewritten(own, pattern, lambda run: F.translate(run, mark, ""))).otherwise(own))

    for mark in ".-_":
        text = together(text, rf"(?<![A-Za-z0-9\{mark}])[A-Za-z](?:\{mark}[A-Za-z]){{3,}}\{mark}?(?![A-Za-z0-9])", mark)
    spelled = lambda part: F.when(part.rlike(r"(?U)^[A-Za-z](?: [A-Za-z])+\W*$"), F.regexp_replace(part, "(?<=[A-Za-z]) (?=[A-Za-z])", "")).otherwise(part)
    joined = lambda t: F.array_join(F.transform(F.split(t, r"(?U)\s{2,}", -1), spelled), " ")
    single = "(?<![A-Za-z])[A-Za-z](?: [A-Za-z]){3,}(?![A-Za-z])"
    return F.array(let(text, lambda t: let(joined(t), lambda j: F.when(F.length(t) - F.length(j) >= 3, j).otherwise(together(t, single, " ")))))


_HINTS = "|".join(w.translate(str.maketrans(*ROTATED)) for w in ROT13_HINTS)
#: codec -> (what a text has to hold to be worth a try, the texts it may stand for). Most texts fail all the tests.
CODECS: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "base64": ("[A-Za-z0-9+/_-]{16}", from_base64),
    "hex": (r"(?:[0-9a-fA-F]{2}){8}|(?:\\x[0-9a-fA-F]{2}){4}", from_hex),
    "url": ("%[0-9a-fA-F]{2}", from_url),
    "rot13": (rf"(?i)(?<![a-z])(?:{_HINTS})(?![a-z])", lambda text: F.array(rot13(text))),
    "leet": ("[A-Za-z][0134578]|[0134578][A-Za-z]", from_leet),
    "spaced": (r"(?U)(?<![A-Za-z])[A-Za-z][ ._-][A-Za-z](?![A-Za-z])|\s{4}|\s{2}[^\s](?s:.*)\s{2}", from_spaced),
}


def readings(text: Column) -> Column:
    """What one step decodes, shorter texts first, those of one length in the order of the codecs."""

    def of(place: int, codec: str) -> Callable[[Column], Column]:
        return lambda t: F.struct(F.octet_length(t).alias("size"), F.lit(place).alias("place"), t.alias("text"), F.lit(codec).alias("codec"))

    none = F.array().cast("array<string>")
    found = F.concat(*[F.transform(F.when(text.rlike(worth), decode(text)).otherwise(none), of(i, codec)) for i, (codec, (worth, decode)) in enumerate(CODECS.items())])
    return F.array_sort(F.filter(found, lambda r: r["text"].isNotNull() & (r["text"] != text)))


def decoded(text: Column, visible: Column) -> Column:
    """struct<fragments array<struct<text, codec>>, truncated>: what is encoded in a text, whose visible form is
    given, in two steps and up to a budget of bytes (``truncated``: something was left out)."""
    state = lambda seen, out, left, cut: F.struct(seen.alias("seen"), out.alias("out"), left.alias("left"), cut.alias("cut"))

    def take(done: Column, one: Column) -> Column:
        known, over = F.array_contains(done["seen"], one["text"]), one["size"] > done["left"]
        return (
            F.when(known, done)
            .when(over, state(done["seen"], done["out"], done["left"], F.lit(True)))
            .otherwise(state(F.concat(done["seen"], F.array(one["text"])), F.concat(done["out"], F.array(one)), done["left"] - one["size"], done["cut"]))
        )

    start = state(F.array(text), F.array().cast(f"array<{READING}>"), F.lit(BUDGET), F.lit(False))
    first = F.aggregate(readings(visible), start, take)
    second = let(first, lambda one: F.aggregate(F.flatten(F.transform(one["out"], lambda r: readings(r["text"]))), one, take))
    return let(second, lambda two: F.struct(F.transform(two["out"], lambda r: F.struct(r["text"].alias("text"), r["codec"].alias("codec"))).alias("fragments"), two["cut"].alias("truncated")))


def segments(df: DataFrame, text_column: str = "text") -> DataFrame:
    """C11: ``df`` with ``norm``, ``decoded`` (array<struct<text, codec>>) and ``truncated``. Null texts have no
    norm and nothing decoded. Columns of these names are replaced."""
    text = F.col(f"`{text_column}`")
    # Functions over arrays take no UDF, so the visible form is a column of its own first.
    seen = df.withColumns({"norm": fold(text), "__visible": strip_invisible(text)})
    found = decoded(F.coalesce(text, F.lit("")), F.coalesce("__visible", F.lit("")))
    # A generated row is a barrier: the optimizer would copy a plain column into each predicate and use of it.
    made = seen.select("*", F.explode(F.array(found)).alias("__found")).withColumns({"decoded": F.col("__found.fragments"), "truncated": F.col("__found.truncated")})
    return made.drop("__visible", "__found")
