"""One query for each operator, over its whole tables, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rolewise.llm import chat_format, divergence, fingerprints, html_text, language_id, media, merkle, mixing, quality, sentencepieces, sharding, simhash_dedup, toxicity
from rolewise.llm.common import documents


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.components(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(documents(spark, sf_dir))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(documents(spark, sf_dir))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(documents(spark, sf_dir))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.token_digests(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(documents(spark, sf_dir))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.with_probe(spark, spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return chat_format.read_back(chat_format.format_turns(turns, parts="parts"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.placement(documents(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.checked(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_mixing": op2_mixing,
    "op3_fingerprints": op3_fingerprints,
    "op4_media": op4_media,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_toxicity": op6_toxicity,
    "op7_html_text": op7_html_text,
    "op8_language_id": op8_language_id,
    "op9_chat_format": op9_chat_format,
    "op10_sharding": op10_sharding,
    "op11_quality": op11_quality,
    "op12_divergence": op12_divergence,
    "op13_merkle": op13_merkle,
}

ORACLE_SQL: dict[str, str] = {
    "op9_chat_format": chat_format.ORACLE_SQL,
    "op10_sharding": sharding.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
    "op13_merkle": merkle.ORACLE_SQL,
}
