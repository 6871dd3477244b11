"""Recency, frequency and confidence scoring; score blending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_EXPONENT = -87.0
RERANK_SHARE = 0.7
RERANK_CAP = 64


def age_seconds(as_of: Column, then: Column) -> Column:
    return (F.unix_micros(as_of) - F.unix_micros(then)) / 1e6


def decay(as_of: Column, asserted_at: Column, last_accessed_at: Column, half_life_days: float) -> Column:
    """exp(-age / half life); the scale is one e-fold, and the exponent stays above what a float can hold."""
    age = age_seconds(as_of, F.coalesce(asserted_at, last_accessed_at))
    return F.exp(F.greatest(-age / (86400.0 * half_life_days), F.lit(LEAST_EXPONENT)))


def frequency_boost(access_count: Column) -> Column:
    return 1.0 + F.log(1.0 + access_count.cast("double"))


def adjusted_score(rrf: Column, as_of: Column, half_life_days: float) -> Column:
    score = rrf.cast("double") * decay(as_of, F.col("asserted_at"), F.col("last_accessed_at"), half_life_days)
    score = score * frequency_boost(F.col("access_count")) * F.col("confidence").cast("double")
    return F.greatest(score, F.lit(0.0)).cast("float")


def min_max(score: Column, partition: str = "query_id") -> Column:
    """Score between the least and the greatest of its query; 1 where they are the same."""
    w = Window.partitionBy(partition)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high - low < 1e-10, F.lit(1.0)).otherwise((score - low) / F.nullif(high - low, F.lit(0.0)))


def blend(candidates: DataFrame, rerank: str = "rerank", adjusted: str = "adjusted_score") -> DataFrame:
    """candidates plus blended: 0.7 of the rerank score and 0.3 of the adjusted one, both min-max normalised."""
    mixed = RERANK_SHARE * min_max(F.col(rerank)) + (1 - RERANK_SHARE) * min_max(F.col(adjusted).cast("double"))
    return candidates.withColumn("blended", mixed)
