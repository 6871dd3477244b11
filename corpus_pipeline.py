"""Corpus pipeline over `documents`: quality rules, exact dedup, near-dedup, mixing to target weights, packing.

Each stage takes all documents its predecessor kept; all but the last return the columns of `documents`. A stage writes
Parquet to the shared folder and the next one reads that; so a stage begins with dropping the tables that the one before
staged for itself, and its result is to be written before the next one is called, as run() does.

Cases: null or empty texts fail the quality rules; rows with a null id are judged and mixed like others and are never
near copies; rows that repeat an id are near copies or not together; extra columns travel along, whatever their names,
and are packed away by the last stage; an empty table gives an empty result.

The mixing stage may only return the columns of `documents`, so the packing stage deals the mixed rows again, with the
same weights and so to the same slots and places, and packs consecutive runs of that order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import exact_dedup, mixing, near_dedup, packing, quality
from weftgraph.llm.common import drop, drop_staged, staged, written

#: Target weight by source; None: the square root of the source's documents.
WEIGHTS: dict[str, float] | None = None


def _carried(docs: DataFrame) -> DataFrame:
    """docs as one column, so that no operator's name can clash with one of theirs."""
    return docs.select(F.struct(*docs.columns).alias("_doc"))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("_doc")[c].alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the robust outlier test accept; each row is judged as it travels along."""
    drop_staged(spark)
    # A text travels once, beside the row's other columns; one that is null is not kept.
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select("text", F.struct(*others).alias("_doc"))
    stats = quality.text_statistics(rows, "_doc.doc_id", "text", "_doc.lang", "_doc.source", carry=("_doc", "text"))
    kept = quality.judge(staged(stats, "quality-stats")).filter("kept")
    return kept.select(*[F.col("text") if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal normalised texts."""
    drop_staged(spark)
    rows = _carried(docs).select("_doc", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.text").alias("text"))
    return _restored(exact_dedup.exact_dedup(rows).filter("kept"), docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each component of near copies: five-word shingles, similarity 0.8."""
    drop_staged(spark)
    judged = near_dedup.near_duplicates(docs, shingle=5, percent=80)
    stay = judged.filter("kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(stay, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, written in the order of the mix: files and rows follow slot and place."""
    drop_staged(spark)
    rows = _carried(docs).select("_doc", F.col("_doc.doc_id").alias("doc_id"), F.col("_doc.source").alias("source"))
    mixed = mixing.mix_sources(rows, WEIGHTS).repartitionByRange("slot", "place").sortWithinPartitions("slot", "place")
    return _restored(mixed, docs)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens in the order of the mix, one row per piece."""
    drop_staged(spark)
    return packing.pack_mixed(docs, WEIGHTS)


STAGES = [
    ("quality rules", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("mixing sources to target weights", mix_stage),
    ("best-fit packing", pack_stage),
]

#: SQL has neither the tokenizer nor the robust estimates; tests/llm/test_whole_job.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs, at = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop(spark, *before)
        before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
