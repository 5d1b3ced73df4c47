"""The opN_ queries: each operator over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phrasemill.llm import chat, decontaminate, language_id, licenses, media, pieces, pii, pseudo_likelihood, token_counts
from phrasemill.llm.common import table
from phrasemill.llm.ngram_join import jaccard_components

Query = Callable[[SparkSession, str], DataFrame]


def op1_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.pictures_of_vectors(table(spark, sf_dir, "embeddings")), "vec_id")


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licences(spark))


def op5_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(chat.swapped_endings(table(spark, sf_dir, "conversations")))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segmented(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_digest(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": licenses.ORACLE, "op5_preference_pairs": chat.ORACLE, "op8_pii": pii.ORACLE, "op10_decontamination": decontaminate.ORACLE}
