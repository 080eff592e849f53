"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fintrail.llm import decontaminate, jaccard_join, language_id, piece_transducer, substring_dedup
from fintrail.llm.common import row_key, stored, table

LEAST_SCORE = 0.5              # calibrated probability below which a language is not accepted
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _by_key(docs: DataFrame) -> DataFrame:
    return docs.withColumn("key", row_key("doc_id", "text"))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those whose language the model is not sure of."""
    model = language_id.train(docs.where(language_id.fold_of("doc_id", 5) != 0))
    return language_id.predict(docs, model, list(COLUMNS)).where(F.col("score") >= LEAST_SCORE).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar ones: the one with the least doc_id, and of its repeated rows one."""
    classes = jaccard_join.similarity_classes(docs)
    first = classes.where("key = class_key").select("key").distinct()
    return _by_key(docs).join(first, "key", "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out windows of words that occur more than once; documents of which nothing is left go."""
    kept = substring_dedup.remove_repeats(docs)
    cut = kept.where("n_removed > 0").select("key", "kept").distinct()
    text = F.coalesce("kept", "text")
    return (_by_key(docs).join(cut, "key", "left").where(F.col("kept").isNull() | (F.col("kept") != ""))
            .select("doc_id", text.alias("text"), "lang", "source",
                    F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept")).alias("n_chars")))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark passage."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    dirty = found.where("contaminated").select("key").distinct()
    return _by_key(docs).join(dirty, "key", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes what is left and decodes it again: doc_id, token_ids, n_tokens, decoded, exact (the ids give the text back)."""
    return piece_transducer.encode(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language", known_language), ("near_duplicates", one_of_each_group), ("substrings", without_repeats),
          ("benchmark", without_benchmark), ("tokens", tokens)]
ORACLE_SQL = None              # the language model and the token paths cannot be expressed in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
