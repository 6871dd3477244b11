"""Facade: ingest, recall and forget over one namespace of a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.vector import hashing_embedder
from weftgraph.operators import ingest as I
from weftgraph.operators.graph import link_entities, pagerank
from weftgraph.operators.rerank import Reranker, overlap_reranker
from weftgraph.plans.search import SearchParameters, recall
from weftgraph.schema import QUERIES
from weftgraph.sources.shared import staged
from weftgraph.sources.store import Store, StoredIndex, cut, new_id

Embedder = Callable[[list[str]], np.ndarray]


@dataclass(frozen=True)
class IngestResult:
    documents: int
    chunks: int
    propositions: int
    entities: int


@dataclass(frozen=True)
class MemoryConfig:
    namespace: str = "default"
    extract_propositions: bool = True
    use_extract_cache: bool = True
    extractor_model: str = "offline"
    link_threshold: float = 0.85
    parameters: SearchParameters = SearchParameters(analyzer="english")


class Memory:
    """embedder, reranker and extractor are hooks; the defaults need no model. extractor None: offline extraction."""

    def __init__(self, store: Store, config: MemoryConfig | None = None, *, embedder: Embedder | None = None, reranker: Reranker = overlap_reranker, extractor: I.Extractor | None = None):
        self.store, self.spark, self.config = store, store.spark, config or MemoryConfig()
        self.embedder, self.reranker, self.extractor = embedder or hashing_embedder(), reranker, extractor
        store.migrate()

    def _embedded(self, df: DataFrame, column: str) -> DataFrame:
        embed = self.embedder

        def run(texts: pd.Series) -> pd.Series:
            return pd.Series([x.tolist() for x in np.asarray(embed(texts.fillna("").tolist()), np.float32)], index=texts.index)

        return df.withColumn("embedding", F.pandas_udf(run, "array<float>")(column))

    def ingest(self, text: str, *, source: str | None = None, session_id: str | None = None, asserted_at: datetime | None = None, chunk_size: int = I.CHUNK_SIZE, chunk_overlap: int = I.CHUNK_OVERLAP) -> IngestResult:
        one = self.spark.createDataFrame([(new_id(), text, source, session_id, asserted_at)], "id string, text string, source string, session_id string, asserted_at timestamp")
        return self.ingest_many(one, chunk_size=chunk_size, chunk_overlap=chunk_overlap)

    def ingest_many(self, texts: DataFrame, *, chunk_size: int = I.CHUNK_SIZE, chunk_overlap: int = I.CHUNK_OVERLAP, paragraphs: bool = True) -> IngestResult:
        """texts: id, text, source, session_id, asserted_at; all of them in one batch. paragraphs: see ingest.chunks."""
        c, store, now = self.config, self.store, datetime.now(UTC)
        ns, none, at = F.lit(c.namespace), F.lit(None), F.lit(now)
        store.append("documents", texts.select("id", "source", ns.alias("namespace"), none.cast("map<string,string>").alias("metadata"), at.alias("created_at")))
        pieces = I.chunks(texts, "id", "text", chunk_size, chunk_overlap, paragraphs, ("session_id", "asserted_at"))
        pieces = staged(pieces.withColumn("id", F.sha2(F.concat_ws("\x1f", "document_id", "ordinal"), 256)), "pieces")
        offsets = (F.col("offset_start") + F.char_length("text")).alias("offset_end")
        store.append("chunks", pieces.select("*", offsets, none.cast("map<string,string>").alias("metadata"), at.alias("created_at")))
        common = {"created_at": at, "last_accessed_at": at, "access_count": F.lit(0), "superseded_by": none.cast("string"), "confidence": F.lit(1.0), "namespace": ns}
        touched = 0
        if c.extract_propositions:
            extracted, new = I.extract(pieces, store.read("proposition_cache") if c.use_extract_cache else store.read("proposition_cache").limit(0), c.extractor_model, self.extractor)
            extracted = cut(extracted)
            if self.extractor is not None and c.use_extract_cache:
                seen = store.read("proposition_cache").select("cache_key")
                store.count_cache_hits(extracted.select("cache_key").join(seen, "cache_key", "left_semi"), now)
                kept = new.withColumns({"extractor_model": F.lit(c.extractor_model), "prompt_version": F.lit("v1"), "created_at": at})
                store.append("proposition_cache", kept, ("cache_key",))
            said = I.statements(extracted, fill=self.extractor is not None).withColumnRenamed("id", "chunk_id")
            names = said.select("subject", F.when(~F.col("object_is_literal"), F.col("object")).alias("object"))
            names = names.select(F.explode(F.array("subject", "object")).alias("name")).filter("name IS NOT NULL").distinct()
            asked = names.select(F.col("name").alias("request_id"), ns.alias("namespace"), "name", F.lit("concept").alias("type"))
            asked = cut(self._embedded(asked, "name"))
            linked = cut(link_entities(asked, store.read("entities", c.namespace), c.link_threshold))
            fresh = linked.filter("how = 'new'").join(asked, "request_id").select(
                F.col("entity_id").alias("id"), "name", "type", "embedding", F.array().cast("array<string>").alias("aliases"), "namespace",
                none.cast("map<string,string>").alias("metadata"), at.alias("created_at"),
            )
            store.append("entities", fresh, ("id",))
            touched = linked.select("entity_id").distinct().count()
            by_name = linked.select(F.col("request_id").alias("name"), "entity_id")
            said = said.join(by_name.select(F.col("name").alias("subject"), F.col("entity_id").alias("subject_id")), "subject", "left")
            ends = by_name.select(F.col("name").alias("object"), F.col("entity_id").alias("object_id"), F.lit(False).alias("object_is_literal"))
            said = said.join(ends, ["object", "object_is_literal"], "left")
            rows = said.select(F.sha2(F.concat_ws("\x1f", "chunk_id", "number"), 256).alias("id"), F.col("p_text").alias("text"), "subject_id", "predicate", "object_id",
                F.when(F.col("object_is_literal"), F.col("object")).alias("object_literal"), "chunk_id", "session_id", "asserted_at", none.cast("map<string,string>").alias("metadata"))
        else:
            text = none.cast("string")
            rows = pieces.select(F.sha2(F.col("id"), 256).alias("id"), "text", text.alias("subject_id"), text.alias("predicate"), text.alias("object_id"), text.alias("object_literal"),
                F.col("id").alias("chunk_id"), "session_id", "asserted_at", F.create_map(F.lit("mode"), F.lit("chunk")).alias("metadata"))
        rows = staged(self._embedded(rows, "text").withColumns(common), "rows")
        store.append("propositions", rows)
        store.index_keywords(rows, c.parameters.analyzer)
        edges = rows.filter("object_id IS NOT NULL").select(F.col("subject_id").alias("src_entity"), F.col("object_id").alias("dst_entity"), F.col("predicate").alias("relation"), F.lit(1.0).alias("weight"), F.col("id").alias("proposition_id"))
        store.append("edges", edges, ("src_entity", "dst_entity", "relation", "proposition_id"))
        return IngestResult(texts.count(), pieces.count(), rows.count(), touched)

    def recall_many(self, queries: DataFrame, *, k: int = 10, k_retrieve: int = 100, with_rerank: bool = True, with_mmr: bool = True, mmr_lambda: float = 0.5, expand_graph: bool = True, bump: bool = True) -> DataFrame:
        """queries: query_id, q_text, session_id. Results of all of them as one job; accesses are logged unless bump is off."""
        c, now = self.config, datetime.now(UTC)
        p = replace(c.parameters, k_retrieve=k_retrieve, k_initial=2 * k_retrieve, expand_graph=expand_graph, as_of=c.parameters.as_of or now)
        asked = self._embedded(queries.withColumn("namespace", F.lit(c.namespace)), "q_text").withColumnRenamed("embedding", "q_embedding")
        asked = cut(asked.select(*QUERIES.names))
        rows, index = self.store.active(c.namespace), StoredIndex(self.store, c.namespace, p.analyzer)
        found = recall(asked, rows, self.store.read("edges"), k=k, parameters=p, with_rerank=with_rerank, with_mmr=with_mmr, mmr_lambda=mmr_lambda, reranker=self.reranker, index=index)
        found = staged(found, "recalled")
        if bump:
            self.store.bump_access(found, now)
        return found

    def recall(self, query: str, *, session_id: str | None = None, **options) -> list:
        """Rows of one query in order: proposition_id, text, score, rrf_score, source_kind, ..."""
        one = self.spark.createDataFrame([("q", query, session_id)], "query_id string, q_text string, session_id string")
        return self.recall_many(one, **options).orderBy("pick").collect()

    def forget(self, proposition_id: str, *, supersede_with: str | None = None) -> None:
        self.store.forget(proposition_id, supersede_with, datetime.now(UTC))

    def recompute_pagerank(self, iterations: int = 20, damping: float = 0.85) -> None:
        ns = self.config.namespace
        ranks = cut(pagerank(self.store.read("entities", ns), self.store.read("edges"), iterations, damping))
        self.store.put_pagerank(ns, ranks, datetime.now(UTC))
