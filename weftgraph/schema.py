"""Table schemas of the store."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _F, _B, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.FloatType(), T.BooleanType(), T.TimestampType()
_META = T.MapType(_S, _S)
VECTOR = T.ArrayType(_F)


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


DOCUMENTS = _table(id=_S, source=_S, namespace=_S, metadata=_META, created_at=_TS)
CHUNKS = _table(id=_S, document_id=_S, text=_S, span_start=_I, span_end=_I, offset_start=_I, offset_end=_I, metadata=_META, created_at=_TS, asserted_at=_TS)
ENTITIES = _table(id=_S, name=_S, type=_S, embedding=VECTOR, aliases=T.ArrayType(_S), namespace=_S, metadata=_META, created_at=_TS)
PROPOSITIONS = _table(
    id=_S, text=_S, embedding=VECTOR, subject_id=_S, predicate=_S, object_id=_S, object_literal=_S, chunk_id=_S, namespace=_S, session_id=_S,
    confidence=_F, created_at=_TS, last_accessed_at=_TS, access_count=_I, superseded_by=_S, metadata=_META, asserted_at=_TS,
)
EDGES = _table(src_entity=_S, dst_entity=_S, relation=_S, weight=_F, proposition_id=_S)
ENTITY_PAGERANK = _table(entity_id=_S, score=_D, computed_at=_TS, namespace=_S)
PROPOSITION = _table(text=_S, subject=_S, predicate=_S, object=_S, object_is_literal=_B)
PROPOSITION_CACHE = _table(cache_key=_S, chunk_hash=_S, extractor_model=_S, prompt_version=_S, propositions=T.ArrayType(PROPOSITION), created_at=_TS)
#: A posting names its row by (batch, ref), which its line in LENGTHS resolves: an id in every posting is most of a table.
POSTINGS = _table(namespace=_S, bucket=_I, analyzer=_S, lexeme=_S, batch=_S, ref=_L, tf=_L)
LENGTHS = _table(namespace=_S, analyzer=_S, prop_id=_S, session_id=_S, dl=_I, batch=_S, ref=_L)
MIGRATIONS = _table(name=_S, applied_at=_TS)
ACCESS_EVENTS = _table(proposition_id=_S, ts=_TS)
SUPERSEDE_EVENTS = _table(proposition_id=_S, replacement=_S, ts=_TS)
CACHE_EVENTS = _table(cache_key=_S, ts=_TS)
QUERIES = _table(query_id=_S, q_text=_S, q_embedding=VECTOR, namespace=_S, session_id=_S)

TABLES: dict[str, T.StructType] = {
    "documents": DOCUMENTS,
    "chunks": CHUNKS,
    "entities": ENTITIES,
    "propositions": PROPOSITIONS,
    "edges": EDGES,
    "entity_pagerank": ENTITY_PAGERANK,
    "proposition_cache": PROPOSITION_CACHE,
    "postings": POSTINGS,
    "lengths": LENGTHS,
    "migrations": MIGRATIONS,
    "access_events": ACCESS_EVENTS,
    "supersede_events": SUPERSEDE_EVENTS,
    "cache_events": CACHE_EVENTS,
}
#: Tables stored by namespace, so that a query's namespace prunes files.
PARTITIONED = {
    "documents": ("namespace",), "entities": ("namespace",), "propositions": ("namespace",), "entity_pagerank": ("namespace",),
    "lengths": ("namespace",), "postings": ("namespace", "bucket"),
}
