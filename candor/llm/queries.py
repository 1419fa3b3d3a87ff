"""The queries that apply the operators to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candor.llm import chat, embedding_dedup, mixing, ngram_join, packing, pii, quality, rules, tokens, toxicity
from candor.llm.runtime import tidy
from candor.session import table


@tidy
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of the pieces; its sums are taken from the ids as placed."""
    return packing.pack_documents(spark, table(spark, sf_dir, "documents"), capacity=1024, separator=2).drop("ids")


@tidy
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@tidy
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@tidy
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_digest(table(spark, sf_dir, "documents"))


@tidy
def op5_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_duplicates(table(spark, sf_dir, "embeddings"), threshold=0.98)


@tidy
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=80)


@tidy
def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights for all sources, and as many characters as there are: the mixture itself, with its texts."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), seed=17)


@tidy
def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_format(chat.pair_neighbours(table(spark, sf_dir, "conversations")))


@tidy
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(table(spark, sf_dir, "documents"), host="source")


@tidy
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(spark, table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Each by its name; intermediate tables are removed once the result is written."""
    return {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_toxicity, op4_personal_data, op5_embedding_duplicates, op6_ngram_jaccard_join, op7_source_mixing, op8_chat_formatting, op9_quality_rules, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": mixing.MIX_SQL.format(seed=17), "op8_chat_formatting": chat.CHAT_SQL}
