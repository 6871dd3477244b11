"""Streaming ingest of turns: beyond the batch engine, same writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.memory import Memory


def deduplicated(turns: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Replayed turns (same id) dropped within the watermark."""
    return turns.withWatermark("asserted_at", delay).dropDuplicatesWithinWatermark(["id"])


def start(turns: DataFrame, memory: Memory, checkpoint: str, *, delay: str = "1 hour") -> StreamingQuery:
    """turns: id, text, source, session_id, asserted_at. Each micro-batch is one ingest of what is new."""

    def batch(df: DataFrame, _: int) -> None:
        known = memory.store.read("documents").select("id")  # a batch that is run again writes nothing twice
        new = df.join(known, "id", "left_anti").filter(F.length(F.trim("text")) > 0)
        if not new.isEmpty():
            memory.ingest_many(new)

    return deduplicated(turns, delay).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
