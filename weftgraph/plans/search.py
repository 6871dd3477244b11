"""Hybrid search: keyword and vector ranking, fusion, graph expansion and scoring as one plan over a batch of queries."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.vector import nearest
from weftgraph.operators.fusion import RRF_K, fuse, source_kind
from weftgraph.operators.graph import neighbours, seed_entities
from weftgraph.operators.keyword import SCORE_DIGITS, KeywordIndex, RowIndex, cover_density_search, keyword_search
from weftgraph.operators.rerank import Reranker, overlap_reranker, rerank, select_diverse
from weftgraph.operators.scoring import RERANK_CAP, adjusted_score, blend
from weftgraph.sources.shared import few, staged


@dataclass(frozen=True)
class SearchParameters:
    k_retrieve: int = 100
    k_initial: int = 200
    half_life_days: float = 30.0
    expand_graph: bool = True
    rrf_k: int = RRF_K
    #: "any" and "all" rank by BM25; "cover" ranks rows with all lexemes by cover density.
    match_mode: str = "any"
    analyzer: str = "simple"
    dedupe_neighbours: bool = True
    session_scoped_graph: bool = False
    as_of: datetime | None = None


def rank_fused(queries: DataFrame, rows: DataFrame, p: SearchParameters, index: KeywordIndex | None = None) -> DataFrame:
    """index: where the keyword statistics come from; by default the texts of rows."""
    if p.match_mode == "cover":
        kw = cover_density_search(queries, rows, p.k_initial, analyzer=p.analyzer)
    else:
        kw = keyword_search(queries, index or RowIndex(rows, p.analyzer), p.k_initial, mode=p.match_mode, analyzer=p.analyzer)
    return fuse(kw, nearest(rows, queries, p.k_initial), p.rrf_k)


def search(
    queries: DataFrame, rows: DataFrame, edges: DataFrame | None = None, parameters: SearchParameters | None = None, index: KeywordIndex | None = None
) -> DataFrame:
    """Ranked rows of each query.

    queries: query_id, q_text, q_embedding, namespace, session_id. rows: active propositions. Result: query_id, rank,
    proposition_id, text, rrf_score, adjusted_score, source_kind, chunk_id, subject_id, predicate, object_id, asserted_at.
    Only ids and scores travel until the best k are known; texts are joined to those.
    """
    p = parameters or SearchParameters()
    # The fused candidates, at most 2 * k_initial a query, are read four times below.
    fused = staged(rank_fused(queries, rows, p, index), "fused")
    candidates = fused
    if p.expand_graph and edges is not None:
        seeds = seed_entities(fused, rows)
        near = neighbours(queries, fused, seeds, edges, rows, dedupe=p.dedupe_neighbours, session_scoped=p.session_scoped_graph)
        candidates = fused.unionByName(near)
    as_of = F.current_timestamp() if p.as_of is None else F.lit(p.as_of)
    facts = rows.select(F.col("id").alias("prop_id"), "asserted_at", "last_accessed_at", "access_count", "confidence")
    scored = facts.join(few(staged(candidates, "candidates")), "prop_id").withColumn("adjusted_score", adjusted_score(F.col("rrf_score"), as_of, p.half_life_days))
    best = Window.partitionBy("query_id").orderBy(F.col("adjusted_score").desc(), "prop_id")
    top = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k_retrieve)
    top = top.select("query_id", "rank", "prop_id", "rrf_score", "adjusted_score", source_kind(F.col("in_kw"), F.col("in_vec")).alias("source_kind"))
    shown = rows.select(F.col("id").alias("prop_id"), "text", "chunk_id", "subject_id", "predicate", "object_id", "asserted_at")
    return shown.join(few(staged(top, "top")), "prop_id").select(
        "query_id", "rank", F.col("prop_id").alias("proposition_id"), "text", "rrf_score", "adjusted_score", "source_kind",
        "chunk_id", "subject_id", "predicate", "object_id", "asserted_at",
    )


def recall(
    queries: DataFrame, rows: DataFrame, edges: DataFrame | None = None, *, k: int = 10, parameters: SearchParameters | None = None,
    with_rerank: bool = True, with_mmr: bool = True, mmr_lambda: float = 0.5, reranker: Reranker = overlap_reranker, index: KeywordIndex | None = None,
) -> DataFrame:
    """search, then reranking of the first 64 rows blended with their scores, then diversity: query_id, pick, score, ..."""
    p = parameters or SearchParameters()
    found = staged(search(queries, rows, edges, p, index), "found")
    if with_rerank:
        some = found.filter(F.col("rank") <= min(p.k_retrieve, RERANK_CAP)).join(queries.select("query_id", "q_text"), "query_id")
        scored = blend(rerank(some, reranker)).withColumn("blended", F.round("blended", SCORE_DIGITS)).withColumn("score", F.col("blended"))
        order = Window.partitionBy("query_id").orderBy(F.col("blended").desc(), "rank")
        placed = scored.withColumn("place", F.row_number().over(order))
    else:
        placed = found.withColumn("score", F.col("adjusted_score").cast("double")).withColumn("place", F.col("rank"))
    placed = staged(placed.select("query_id", "place", "score", *found.columns[2:]), "placed")
    if with_mmr:
        vectors = placed.select("query_id", F.col("proposition_id").alias("prop_id"), "place")
        vectors = rows.select(F.col("id").alias("prop_id"), "embedding").join(few(vectors), "prop_id").join(queries.select("query_id", "q_embedding"), "query_id")
        picks = select_diverse(vectors, k, mmr_lambda).withColumnRenamed("prop_id", "proposition_id")
        return placed.join(picks, ["query_id", "proposition_id"]).drop("place")
    return placed.filter(F.col("place") <= k).withColumn("pick", F.col("place")).drop("place")
