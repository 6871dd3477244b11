"""Retrieval and answer evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.text import exact_match


def graded(answers: DataFrame, prediction: str = "prediction", gold: str = "gold") -> DataFrame:
    return answers.withColumn("exact", exact_match(F.col(prediction), F.col(gold)))


def by_category(graded_answers: DataFrame, correct: str = "exact") -> DataFrame:
    """(category, total, correct, accuracy)."""
    right = F.sum(F.col(correct).cast("long"))
    found = graded_answers.groupBy("category").agg(F.count(F.lit(1)).alias("total"), F.coalesce(right, F.lit(0)).alias("correct"))
    return found.withColumn("accuracy", F.coalesce(F.try_divide(F.col("correct").cast("double"), "total"), F.lit(0.0)))


def report(graded_answers: DataFrame) -> DataFrame:
    """One row: total, correct, accuracy, exact_correct, exact_accuracy, mean latencies; 0 where there is nothing."""
    total = F.count(F.lit(1))
    share = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c).cast("double")), total), F.lit(0.0))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return graded_answers.agg(
        total.alias("total"), F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0)).alias("correct"), share("correct").alias("accuracy"),
        F.coalesce(F.sum(F.col("exact").cast("long")), F.lit(0)).alias("exact_correct"), share("exact").alias("exact_accuracy"),
        mean("recall_ms").alias("mean_recall_ms"), mean("answer_ms").alias("mean_answer_ms"),
    )
