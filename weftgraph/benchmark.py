"""Question-answering runs: ingest the sessions of a dataset, recall and answer every question, grade, report."""

from __future__ import annotations

import json
import time
from dataclasses import asdict, dataclass, replace
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph import providers
from weftgraph.functions.text import PROMPT_VERSION
from weftgraph.memory import Memory
from weftgraph.operators import evaluate
from weftgraph.sources.datasets import transcripts, write_records
from weftgraph.sources.shared import staged


@dataclass(frozen=True)
class BenchConfig:
    name: str
    k: int = 20
    k_retrieve: int = 100
    with_rerank: bool = True
    with_mmr: bool = True
    expand_graph: bool = True
    #: Neither answers nor grades come from a model: the first fact found is the answer.
    dry_run: bool = True


def answered(found: DataFrame, questions: DataFrame, answerer: providers.Chat | None) -> DataFrame:
    """questions plus predicted and n_retrieved. found: query_id, pick, text; no answerer: the first text."""
    facts = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pick", "text"))).alias("f"))
    facts = facts.select(F.col("query_id").alias("question_id"), F.col("f.text").alias("facts"))
    asked = questions.join(facts, "question_id", "left").withColumn("facts", F.coalesce("facts", F.array().cast("array<string>")))
    predicted = F.coalesce(F.get("facts", F.lit(0)), F.lit(providers.UNKNOWN))
    if answerer is not None:
        chat = answerer

        @F.pandas_udf("string")
        def predict(question: pd.Series, texts: pd.Series) -> pd.Series:
            return pd.Series([chat("", providers.answer_prompt(q, list(t))) for q, t in zip(question, texts, strict=True)], index=question.index)

        predicted = predict("question", "facts")
    return asked.select(*questions.columns, predicted.alias("predicted"), F.size("facts").alias("n_retrieved"))


def graded(answers: DataFrame, judge: providers.Chat | None) -> DataFrame:
    """answers (question, answer, predicted, category) plus exact (match) and correct; no judge: nothing is correct."""
    exact = evaluate.graded(answers.select("*", F.col("predicted").alias("prediction"), F.col("answer").alias("gold"))).drop("prediction", "gold")
    if judge is None:
        return exact.withColumn("correct", F.lit(False))
    chat = judge

    @F.pandas_udf("boolean")
    def right(question: pd.Series, gold: pd.Series, predicted: pd.Series) -> pd.Series:
        return pd.Series([providers.parse_grade(chat("", providers.judge_prompt(*x)))[0] for x in zip(question, gold, predicted, strict=True)], index=question.index)

    return exact.withColumn("correct", right("question", "answer", "predicted"))


def run_bench(memory: Memory, turns: DataFrame, questions: DataFrame, config: BenchConfig, output: str, *, answerer: providers.Chat | None = None, judge: providers.Chat | None = None) -> dict:
    """Report of a run; records go to <output>/<name>.jsonl and the report to <output>/<name>-report as JSON.

    turns, questions: see weftgraph.sources.datasets. Each namespace of the dataset is one of the store; all its sessions
    are one ingest and all its questions one recall.
    """
    if not config.dry_run and (answerer is None or judge is None):
        raise ValueError("a run with models needs an answerer and a judge")
    answerer, judge = (None, None) if config.dry_run else (answerer, judge)
    spark, started = memory.spark, datetime.now(UTC)
    sessions, asked = staged(transcripts(turns), "bench-sessions"), staged(questions, "bench-questions")
    rows, facts, recalled_ms, answered_ms = [], 0, 0.0, 0.0
    for (namespace,) in asked.select("namespace").union(sessions.select("namespace")).distinct().orderBy("namespace").collect():
        mine = Memory(memory.store, replace(memory.config, namespace=namespace), embedder=memory.embedder, reranker=memory.reranker, extractor=memory.extractor)
        said = sessions.filter(F.col("namespace") == namespace)
        said = said.select(F.sha2(F.concat_ws("\x1f", "namespace", "session_id"), 256).alias("id"), "text", F.lit(config.name).alias("source"), "session_id", "asserted_at")
        facts += mine.ingest_many(said).propositions
        here = asked.filter(F.col("namespace") == namespace)
        began = time.perf_counter()
        queries = here.select(F.col("question_id").alias("query_id"), F.col("question").alias("q_text"), F.lit(None).cast("string").alias("session_id"))
        found = mine.recall_many(queries, k=config.k, k_retrieve=config.k_retrieve, with_rerank=config.with_rerank, with_mmr=config.with_mmr, expand_graph=config.expand_graph)
        asked_at = time.perf_counter()
        rows.append(staged(graded(answered(found, here, answerer), judge), "bench-graded"))
        recalled_ms, answered_ms = recalled_ms + 1000 * (asked_at - began), answered_ms + 1000 * (time.perf_counter() - asked_at)
    every = rows[0]
    for more in rows[1:]:
        every = every.unionByName(more)
    write_records(every.select("namespace", "question_id", "question", F.col("answer").alias("gold"), "predicted", "correct", F.col("exact").alias("exact_match"), "category", "n_retrieved"), f"{output}/{config.name}.jsonl")
    by_category = every.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("correct").cast("long")).alias("correct"), F.sum(F.col("exact").cast("long")).alias("exact")).collect()
    total = sum(r.total for r in by_category)
    share = lambda n: n / total if total else 0.0
    correct, exact = sum(r.correct for r in by_category), sum(r.exact for r in by_category)
    report = {
        "name": config.name, "total": total, "correct": correct, "accuracy": share(correct), "exact_match_correct": exact, "exact_match_accuracy": share(exact),
        "per_category": {r.category: {"total": r.total, "correct": r.correct, "acc": r.correct / r.total} for r in by_category},
        "n_propositions_ingested": facts, "mean_recall_latency_ms": share(recalled_ms), "mean_answer_latency_ms": share(answered_ms),
        "started_at": started.isoformat(), "finished_at": datetime.now(UTC).isoformat(), "config": asdict(config),
        "stack": {"extractor": memory.config.extractor_model, "prompt_version": PROMPT_VERSION, "mode": "propositions" if memory.config.extract_propositions else "chunks",
                  "embedder": getattr(memory.embedder, "__qualname__", str(memory.embedder)), "reranker": getattr(memory.reranker, "__qualname__", str(memory.reranker)),
                  "half_life_days": memory.config.parameters.half_life_days, "rrf_k": memory.config.parameters.rrf_k},
    }
    spark.createDataFrame([(json.dumps(report),)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/{config.name}-report")
    return report
