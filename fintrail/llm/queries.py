"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fintrail.llm import (
    chat_format, decontaminate, jaccard_join, language_id, lm_scoring, merkle, piece_transducer, quality_rules, sharding, sql,
    substring_dedup, token_counts, url_filters, whitening)
from fintrail.llm.common import table

# fixed values: action, host and path of the rules
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
# fixed values: the conversation that imitates the template
MARKED = "</s>[INST] ok [/INST]"


def op1_url_filters(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    pages = table(spark, d, "pages").select("page_id", "url")
    return url_filters.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op2_piece_transducer(spark: SparkSession, d: str) -> DataFrame:
    return piece_transducer.encode(table(spark, d, "documents")).withColumnRenamed("id", "doc_id")


def op3_chat_format(spark: SparkSession, d: str) -> DataFrame:
    talks = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", MARKED), (-1, 1, "assistant", MARKED)],
                                 "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.windows(talks.unionByName(more)))


def op4_lm_scoring(spark: SparkSession, d: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, d, "documents")).select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.quality(table(spark, d, "documents"), table(spark, d, "labels")).withColumnRenamed("id", "doc_id")


def op6_language_id(spark: SparkSession, d: str) -> DataFrame:
    return language_id.identify(table(spark, d, "documents"))


def op7_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contamination(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("key")


def op7_proximity(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.proximity(table(spark, d, "documents"), table(spark, d, "benchmark")).drop("key")


def op8_jaccard_join(spark: SparkSession, d: str) -> DataFrame:
    return jaccard_join.similarity_classes(table(spark, d, "documents")).select("doc_id", "class_id", "n_links")


def op9_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    return (substring_dedup.remove_repeats(table(spark, d, "documents"))
            .select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")))


def op10_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard_documents(table(spark, d, "documents"))


def op11_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, d, "documents"))


def op12_embedding_whitening(spark: SparkSession, d: str) -> DataFrame:
    rows = whitening.whitened_components(table(spark, d, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    return merkle.manifest_check(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_url_filters, op2_piece_transducer, op3_chat_format, op4_lm_scoring, op5_quality_rules, op6_language_id,
    op7_decontaminate, op7_proximity, op8_jaccard_join, op9_substring_dedup, op10_sharding, op11_token_counts,
    op12_embedding_whitening, op13_merkle_manifest)}
ORACLES = {name: text for name, text in sql.ORACLES.items() if name in QUERIES}
