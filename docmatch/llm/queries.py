"""The registered queries of the corpus operators: each over its whole table, with
production parameters, and returning its full result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, license_scan, mixing, near_dedup, quality_rules, resampling, suffix_dedup, token_shards, wrapper_induction

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PATTERN = public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_read(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(_read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.quality_resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards.read(spark, token_shards.write(_read(spark, sf_dir, "documents"), WORD_BPE))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_read(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_read(spark, sf_dir, "documents"))


def op9_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper_induction.extract(_read(spark, sf_dir, "pages"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents"), RANKS, PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle_sql(),
        "op6_mix_sources": mixing.ORACLE_SQL.replace("{docs}", "documents"),
        "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    }
