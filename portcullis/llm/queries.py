"""The registered queries of this package: one for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portcullis.llm import alignment, chat_format, decontaminate, language_id, ngram_lm, prefix_trie, sentencepiece_codec, simhash_dedup, suffix_dedup, token_counts, token_shards, url_rules, vector_topk
from portcullis.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PIECES = "piece_bpe_32k.model"


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_codec.digest(sentencepiece_codec.encode(docs, public_tokenizers.path(PIECES), ["doc_id"]))


@query
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.materialise(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


@query
def op6_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", language_id.held_out("doc_id", 10, 0).alias("held_out"))
    return ngram_lm.score(docs, ngram_lm.train(docs.where("not held_out")), ["doc_id", "held_out"])


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ["doc_id"])


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", language_id.held_out("doc_id").alias("held_out"))
    model = language_id.train(docs.where("not held_out"))
    return language_id.predict(docs, model, ["doc_id", "held_out"])


@query
def op9_vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL["op9_vector_topk"] = vector_topk.ORACLE


@query
def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


ORACLE_SQL["op10_url_rules"] = url_rules.ORACLE


@query
def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cuts are those of 400-byte strings alone; ``n_passage_bytes`` tells of repeated passages of over 50 words."""
    cut = suffix_dedup.strip(table(spark, sf_dir, "documents"), ["doc_id"], words=51, cut_words=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_passage_bytes")


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda groups: F.when(groups == "", "").otherwise(F.sha2(groups, 256))
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path(PIECES), ["doc_id"], groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


@query
def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.digest(chat_format.read_back(chat_format.conversations(table(spark, sf_dir, "conversations"))))


ORACLE_SQL["op12_chat_format"] = chat_format.ORACLE


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf_dir, "conversations"))


ORACLE_SQL["op13_prefix_trie"] = prefix_trie.ORACLE
