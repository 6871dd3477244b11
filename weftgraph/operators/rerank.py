"""Reranking hook and maximal marginal relevance."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAIN_DIGITS = 9
Reranker = Callable[[str, list[str]], list[float]]


def overlap_reranker(query: str, texts: list[str]) -> list[float]:
    """Default reranker: share of the query's words that a text has, then how early the first one stands."""
    asked = set(re.findall(r"\w+", (query or "").lower()))
    out = []
    for t in texts:
        words = re.findall(r"\w+", (t or "").lower())
        first = next((i for i, w in enumerate(words) if w in asked), len(words))
        out.append((len(asked & set(words)) / len(asked) if asked else 0.0) + 0.01 / (1 + first))
    return out


def rerank(candidates: DataFrame, reranker: Reranker = overlap_reranker) -> DataFrame:
    """candidates (with q_text and text) plus rerank, scored batch by batch."""

    @F.pandas_udf("double")
    def score(query: pd.Series, text: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=query.index)
        for q, at in query.groupby(query.fillna("")).groups.items():
            out.loc[at] = reranker(q, text.loc[at].fillna("").tolist())
        return out

    return candidates.withColumn("rerank", score("q_text", "text"))


def mmr(query: np.ndarray, docs: np.ndarray, k: int, lam: float = 0.5) -> list[int]:
    """Places of the k picks: the nearest to the query first, then the best of relevance against redundancy."""
    if len(docs) == 0:
        return []
    unit = docs / (np.linalg.norm(docs, axis=1, keepdims=True) + 1e-10)
    relevance = unit @ (query / (np.linalg.norm(query) + 1e-10))
    picks = [int(np.argmax(np.round(relevance, GAIN_DIGITS)))]  # rounded, so that ties go to the earlier candidate
    redundancy = unit @ unit[picks[0]]
    free = np.ones(len(docs), bool)
    free[picks[0]] = False
    while len(picks) < min(k, len(docs)):
        gain = np.where(free, lam * relevance - (1 - lam) * redundancy, -np.inf)
        best = int(np.argmax(np.round(gain, GAIN_DIGITS)))
        picks.append(best)
        free[best] = False
        redundancy = np.maximum(redundancy, unit @ unit[best])
    return picks


def select_diverse(candidates: DataFrame, k: int, lam: float = 0.5) -> DataFrame:
    """The k picks of each query in order: (query_id, prop_id, pick). A query with k candidates or fewer keeps its order.

    candidates: query_id, prop_id, place, embedding, q_embedding; a candidate without an embedding takes the query's. A
    group is one query's candidates, at most a few hundred.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        chosen = list(range(len(pdf)))
        query = pdf["q_embedding"].iloc[0]
        if len(pdf) > k and query is not None:
            docs = np.array([query if e is None else e for e in pdf["embedding"]], np.float64)
            chosen = mmr(np.asarray(query, np.float64), docs, k, lam)
        got = pdf.iloc[chosen[:k]]
        return pd.DataFrame({"query_id": got["query_id"], "prop_id": got["prop_id"], "pick": range(1, len(got) + 1)})

    some = candidates.select("query_id", "prop_id", "place", "embedding", "q_embedding")
    return some.groupBy("query_id").applyInPandas(pick, "query_id string, prop_id string, pick int")
