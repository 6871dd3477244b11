"""Queries of the training-data operators, each over its whole table, and their DuckDB counterparts where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, mixing, near_dedup, packing, pii, quality, secrets, substring_dedup, suffix_dedup, token_store


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = exact_dedup.exact_dedup(_documents(spark, sf_dir))
    return done.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.op3(_documents(spark, sf_dir))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, sf_dir).select("doc_id", "source"))
    return mixed.select("doc_id", mixing.source_key().alias("source"), "block", "place", "release", "deadline", "slot", "on_target")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_documents(spark, sf_dir))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir), shingle=2, percent=80)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_words(_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated_bytes(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_personal_data,
        op2_exact_dedup,
        op3_token_store,
        op4_best_fit_packing,
        op5_quality_rules,
        op6_mix_sources,
        op7_secret_scan,
        op8_near_dedup,
        op9_substring_dedup,
        op10_suffix_dedup,
    )
}

ORACLES: dict[str, str] = {"op2_exact_dedup": exact_dedup.SQL, "op6_mix_sources": mixing.SQL}
