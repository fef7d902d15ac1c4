"""The queries of the ten operators: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_labeller,
    cap_filters,
    licences,
    minhash,
    mixing,
    quality_classifier,
    quality_rules,
    sentencepieces,
    substring_dedup,
    token_counts,
)
from .common import table
from .oracle import oracle_sql

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.selectExpr("doc_id", "licence", "round(dice, 9) AS dice", "n_licence_units")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_decode(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select("the_rest.doc_id", "n_words", "n_removed", "kept_sha256")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), n=4)
    kept = F.coalesce(F.col("key") == F.col("component"), F.lit(True))
    return found.select(F.col("key").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), kept.alias("kept"))


def op7_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))
    kept = F.coalesce(F.col("key") == F.col("component"), F.lit(True))
    return found.select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), kept.alias("kept"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_labeller.extract(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_counts, op2_license_scans, op3_sentencepiece, op4_substring_dedup, op5_quality_classifier, op6_minhash, op7_cap_filters, op8_html_extraction, op9_quality_rules, op10_mixing)}


__all__ = ["oracle_sql", "queries"]
