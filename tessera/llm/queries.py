"""The queries of this package: each operator over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import chat_quotes, embedding_dedup, exact_dedup, html_extract, language_id, merkle, mixing, packing, phrases, quality, simhash_dedup, token_counts, token_output
from tessera.session import table


#: Context limits that op8 answers besides every length that occurs.
CONTEXT_LIMITS = tuple(512 << k for k in range(9))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_groups(table(spark, sf_dir, "embeddings"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("target_weight", F.round("target_weight", 9))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_round_trip(table(spark, sf_dir, "documents"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.length_histogram(table(spark, sf_dir, "documents"), limits=CONTEXT_LIMITS)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_quotes.chat_threads(table(spark, sf_dir, "conversations"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_embedding_dedup,
        op2_temperature_mixing,
        op3_exact_dedup,
        op4_best_fit_packing,
        op5_token_output,
        op6_simhash_dedup,
        op7_html_extraction,
        op8_token_counts,
        op9_chat_formatting,
        op10_language_id,
        op11_phrase_collocations,
        op12_quality_classifier,
        op13_merkle_manifest,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_temperature_mixing": mixing.MIX_SQL,
        "op3_exact_dedup": exact_dedup.EXACT_SQL,
        "op9_chat_formatting": chat_quotes.CHAT_SQL,
        "op11_phrase_collocations": phrases.PHRASES_SQL,
        "op13_merkle_manifest": merkle.MERKLE_SQL,
    }
