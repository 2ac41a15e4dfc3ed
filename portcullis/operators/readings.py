"""What a model is shown of a request: readings of its segments, and decoded fragments that add something."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portcullis.functions.columns import chunks

# Shares of letters and blanks that make words, and of common characters that make the same text.
WORDISH, SAME = 0.7, 0.8


@F.pandas_udf(T.StringType())
def _folded(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def casefold(text: Column) -> Column:
    """Python's case folding; ASCII stays in the JVM."""
    return F.coalesce(_folded(F.when(text.rlike(r"[^\x00-\x7F]"), text)), F.lower(text))


def texts_for(segments: DataFrame, request: str, size: int = 2000, most_chunks: int = 8, most: int = 16) -> DataFrame:
    """C17: (request, place, segment, text): what a classifier reads of each request's segments (segment, text,
    norm, decoded as array<struct<text, ..>>): the later ones first, each as its text, its normal form if that
    differs in more than case, and what is decoded from it, in chunks; blank ones and those after ``most`` go.
    Where segments have a column ``differs``, as ``text.with_fold`` makes it, it says which normal forms do.

    A segment alone is never asked for more than ``most`` texts, so the row that is ordered stays small.
    """
    text, norm = F.coalesce("text", F.lit("")), F.coalesce("norm", F.lit(""))
    if "differs" in segments.columns:
        cased, differs = segments, F.col("differs")
    else:
        cased, differs = segments.withColumns({"__text": casefold(text), "__norm": casefold(norm)}), F.col("__norm") != F.col("__text")
    none = F.array().cast("array<string>")
    variants = F.concat(F.array(text), F.when(differs, F.array(norm)).otherwise(none), F.coalesce(F.transform("decoded", lambda d: d["text"]), none))
    pieces = F.flatten(F.transform(variants, lambda v: chunks(v, size, 200, most_chunks)))
    kept = F.slice(F.filter(pieces, lambda p: ~p.rlike(r"^\s*$")), 1, most)
    shown = cased.select(request, "segment", F.posexplode(kept).alias("at", "text"))
    order = Window.partitionBy(request).orderBy(F.col("segment").desc(), "at")
    return shown.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(request, "place", "segment", "text")


def _common(a: str, b: str) -> float:
    """Twice the characters that two texts have in common, however they are ordered, in all their characters."""
    both = len(a) + len(b)
    return 2 * (Counter(a) & Counter(b)).total() / both if both else 1.0


@F.pandas_udf(T.BooleanType())
def new_fragment(text: pd.Series, fragment: pd.Series) -> pd.Series:
    """Whether a decoded fragment is worth showing beside the text: mostly words, and not the text read
    another way. A null text counts as empty; a null fragment is none."""

    def worth(t: str | None, f: str | None) -> bool:
        if not isinstance(f, str) or not f.strip():
            return False
        if sum(c.isalpha() or c.isspace() for c in f) < WORDISH * len(f):
            return False
        return _common((t if isinstance(t, str) else "").casefold(), f.casefold()) < SAME

    return pd.Series([worth(t, f) for t, f in zip(text, fragment, strict=True)], dtype=bool)
