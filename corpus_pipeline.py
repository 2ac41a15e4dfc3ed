"""The corpus pipeline: five stages over ``documents``, each written and read again before the next.

Language identification drops documents without a language, SimHash near-dedup keeps one of each
group, suffix-array dedup cuts repeated passages out, decontamination drops documents that hold a
benchmark item, and what is left is encoded (the last stage returns digests, not documents).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import decontaminate, language_id, sentencepiece_codec, simhash_dedup, suffix_dedup
from portcullis.llm.common import written
from portcullis.sources.tables import table

#: Share of its n-grams that a document's language has to have.
LEAST_SHARE = 0.2
#: Repeated passages of over 50 words are cut, however few bytes they have.
PASSAGE_WORDS = 51


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: without letters, or in no known language, they go."""
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    found = language_id.predict(docs, model, docs.columns)
    lang, score = (F.col(f"`{c}`") for c in found.columns[-2:])
    return found.where((lang != language_id.UNKNOWN) & (score >= LEAST_SHARE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return simhash_dedup.dedup(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that stand elsewhere too; n_chars follows the text."""
    return suffix_dedup.dedup(docs, words=PASSAGE_WORDS).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return sentencepiece_codec.digest(sentencepiece_codec.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), ["doc_id"]))


STAGES = [
    ("language_id", by_language),
    ("near_dedup", near_dedup),
    ("suffix_dedup", passages),
    ("decontamination", without_benchmark),
    ("sentencepiece", encoded),
]
#: No stage but the last writes what SQL can express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
