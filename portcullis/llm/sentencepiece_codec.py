"""SentencePiece encoding and decoding with source offsets.

``encode`` normalises each text by the longest prefix in the model's compiled character map, keeping
for every normalised byte the source byte it came from; the pieces' boundaries are then projected
through that alignment to (begin, end) bytes of the source. ``decode`` turns ids back into text.

Null and empty texts have no tokens but begin and end; repeated rows are encoded each on its own;
other columns pass through; results whose names they have already get underscores.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portcullis.llm.common import beside, kept, texts_of
from portcullis.llm.pieces import PieceModel


def model_bytes(path: str) -> bytes:
    """The model file, read on the driver; a few hundred kB, so it travels with the tasks."""
    return Path(path).read_bytes()


def loaded(data: bytes) -> PieceModel:
    """The model, parsed once in each Python worker."""
    return kept(("pieces", data), lambda: PieceModel.from_bytes(data))


def encode(df: DataFrame, model_path: str, columns: list[str], text_column: str = "text", begin_end: bool = True) -> DataFrame:
    """A row for each row of ``df``: its ``columns``, ``ids``, ``spans`` and ``decoded``.

    ``ids`` (binary) holds the token ids as little-endian unsigned 32-bit integers, with begin and
    end ids if ``begin_end``. ``spans`` (binary) has two such integers for each token of the text,
    begin and end id left out: the source bytes [begin, end). ``decoded`` is decode(ids).
    """
    data = model_bytes(model_path)

    def work(batch: pa.RecordBatch, model: PieceModel) -> dict:
        ids, spans, decoded = [], [], []
        for own, span in model.encode(texts_of(batch, "text")):
            if begin_end:
                own = np.concatenate([[model.bos_id], own, [model.eos_id]]).astype("<u4")
            ids.append(own.tobytes())
            spans.append(span.tobytes())
            decoded.append(model.decode(own))
        return {"ids": ids, "spans": spans, "decoded": decoded}

    return beside(df, columns, text_column, "ids binary, spans binary, decoded string", work, lambda: loaded(data))


def decode(df: DataFrame, model_path: str, ids_column: str = "ids", into: str = "decoded") -> DataFrame:
    """``df`` with the text of its packed ids; null ids have a null text."""
    data = model_bytes(model_path)

    @F.pandas_udf("string")
    def text(packed):
        model = loaded(data)
        return packed.map(lambda x: None if x is None else model.decode(np.frombuffer(x, "<u4")))

    return df.withColumn(into, text(F.col(ids_column)))


def digest(encoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The counts and SHA-256 digests of what ``encode`` returns."""
    return encoded.select(
        id_column,
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.col("spans"), 256).alias("spans_sha256"),
    )
