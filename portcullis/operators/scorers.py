"""Models as columns (L3): a scorer is any function of a batch of texts; none is built in.

A scorer gets a list of texts and returns as many scores (or pairs of score and label). It is made once for each
task by its factory, so a model is loaded once for many batches. What a scorer can't do in one batch leaves
the batch's rows without a score, marked as failed, and the next batch is tried anew.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RESULT = "struct<score double, label string, failed boolean>"
Scorer = Callable[[list[str]], list]


def _result(value: object) -> tuple[float | None, str | None, bool]:
    score, label = value if isinstance(value, tuple) else (value, None)
    if score is None or not math.isfinite(score):
        return None, label, True
    return min(1.0, max(0.0, float(score))), label, False


def column(text: Column, factory: Callable[[], Scorer] | None) -> Column:
    """``RESULT`` of a text: a score from 0 to 1, a label, and whether the scorer failed; null texts, and all texts
    without a scorer, have none and didn't fail."""
    if factory is None:
        return F.struct(F.lit(None).cast("double").alias("score"), F.lit(None).cast("string").alias("label"), F.lit(False).alias("failed"))

    @F.arrow_udf(RESULT)
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = None
        for batch in batches:
            texts = batch.to_pylist()
            asked = [t for t in texts if t is not None]
            try:
                scorer = scorer or factory()
                found = scorer(asked)
                if len(found) != len(asked):
                    raise ValueError("not a score for each text")
                results = iter([_result(x) for x in found])
            except Exception:  # noqa: BLE001  a model may fail in any way; its rows say so
                results = iter([(None, None, True)] * len(asked))
            rows = [(None, None, False) if t is None else next(results) for t in texts]
            score, label, failed = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.StructArray.from_arrays([pa.array(score, pa.float64()), pa.array(label, pa.string()), pa.array(failed, pa.bool_())], ["score", "label", "failed"])

    return scored(text)


def scored(segments: DataFrame, text: str, factory: Callable[[], Scorer] | None, name: str = "score") -> DataFrame:
    """``segments`` with ``name``, ``<name>_label`` and ``<name>_status``: ok, failed, or skipped without a scorer or text."""
    made = segments.withColumn("__scored", column(F.col(text), factory))
    status = F.when(F.col("__scored.failed"), "failed").when(F.col("__scored.score").isNull(), "skipped").otherwise("ok")
    return made.withColumns({name: F.col("__scored.score"), f"{name}_label": F.col("__scored.label"), f"{name}_status": status}).drop("__scored")
