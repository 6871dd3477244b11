"""Reciprocal rank fusion of keyword and vector candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def source_kind(in_kw: Column, in_vec: Column) -> Column:
    return F.when(in_kw & in_vec, "both").when(in_kw, "kw").when(in_vec, "vec").otherwise("graph")


def fuse(kw: DataFrame, vec: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, prop_id, rrf_score, in_kw, in_vec): full outer join of both rankings."""
    kw = kw.select("query_id", "prop_id", F.col("rank").alias("kw_rank"))
    vec = vec.select("query_id", "prop_id", F.col("rank").alias("vec_rank"))
    both = kw.join(vec, ["query_id", "prop_id"], "full")
    share = [F.coalesce(F.lit(1.0) / (F.lit(rrf_k) + F.col(c)), F.lit(0.0)) for c in ("kw_rank", "vec_rank")]
    return both.select(
        "query_id", "prop_id", (share[0] + share[1]).cast("float").alias("rrf_score"),
        F.col("kw_rank").isNotNull().alias("in_kw"), F.col("vec_rank").isNotNull().alias("in_vec"),
    )
