"""BM25 and cover-density keyword retrieval.

What a ranking needs of the corpus comes from an index: `RowIndex` reads it from the texts in one scan, `StoredIndex`
(weftgraph.sources.store) from postings that were written with the rows. Only the lexemes that a batch of queries asks
for leave a row.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import counted, lexemes
from weftgraph.sources.shared import bounded, few, staged

K1, B = 1.2, 0.75
SCORE_DIGITS = 9


class KeywordIndex(Protocol):
    def hits(self, terms: DataFrame) -> DataFrame:
        """(namespace, prop_id, session_id, lexeme, tf, dl) of the rows that have one of the terms (namespace, lexeme)."""

    def statistics(self) -> DataFrame:
        """(namespace, n_total, avgdl)."""


def row_words(rows: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(namespace, prop_id, session_id, words) of each row."""
    return bounded(rows).select("namespace", F.col("id").alias("prop_id"), "session_id", lexemes(F.col("text"), analyzer).alias("words"))


def postings(rows: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(namespace, prop_id, session_id, lexeme, tf, dl); dl counts distinct lexemes. Nothing is shuffled."""
    each = row_words(rows, analyzer).withColumn("counts", counted(F.col("words")))
    each = each.select("namespace", "prop_id", "session_id", F.size("counts").alias("dl"), F.explode("counts").alias("x"))
    return each.select("namespace", "prop_id", "session_id", "x.lexeme", "x.tf", "dl")


def statistics(lengths: DataFrame) -> DataFrame:
    """(namespace, n_total, avgdl) from (namespace, dl) of active rows; rows without lexemes count with length 0."""
    return lengths.groupBy("namespace").agg(F.greatest(F.count(F.lit(1)), F.lit(1)).cast("double").alias("n_total"), F.greatest(F.avg("dl"), F.lit(1.0)).alias("avgdl"))


def corpus_statistics(rows: DataFrame, analyzer: str = "simple") -> DataFrame:
    return statistics(row_words(rows, analyzer).select("namespace", F.size(F.array_distinct("words")).alias("dl")))


class RowIndex:
    """Index of rows as they are. The first batch of terms decides what is kept of each row: its length and its hits."""

    def __init__(self, rows: DataFrame, analyzer: str = "simple"):
        self.rows, self.analyzer, self._kept = rows, analyzer, None

    def _read(self, terms: DataFrame) -> DataFrame:
        if self._kept is None:
            wanted = terms.groupBy("namespace").agg(F.collect_set("lexeme").alias("wanted"))
            words = row_words(self.rows, self.analyzer).join(few(wanted), "namespace", "left")
            words = words.withColumn("found", F.array_intersect("words", F.coalesce("wanted", F.array().cast("array<string>"))))
            tf = lambda w: F.size(F.filter("words", lambda x: x == w)).cast("long")
            hits = F.transform("found", lambda w: F.struct(w.alias("lexeme"), tf(w).alias("tf")))
            self._kept = staged(words.select("namespace", "prop_id", "session_id", F.size(F.array_distinct("words")).alias("dl"), hits.alias("hits")), "keyword-rows")
        return self._kept

    def hits(self, terms: DataFrame) -> DataFrame:
        each = self._read(terms).select("namespace", "prop_id", "session_id", "dl", F.explode("hits").alias("x"))
        return each.select("namespace", "prop_id", "session_id", "x.lexeme", "x.tf", "dl")

    def statistics(self) -> DataFrame:
        return corpus_statistics(self.rows, self.analyzer) if self._kept is None else statistics(self._kept)


def query_lexemes(queries: DataFrame, analyzer: str = "simple") -> DataFrame:
    """(query_id, namespace, q_session, lexeme); a repeated word gives repeated rows."""
    some = queries.filter("q_text IS NOT NULL AND q_text != ''")
    words = F.explode(lexemes(F.col("q_text"), analyzer))
    return some.select("query_id", "namespace", F.col("session_id").alias("q_session"), words.alias("lexeme"))


def inverse_frequencies(terms: DataFrame, hits: DataFrame, stats: DataFrame) -> DataFrame:
    """terms plus df, n_total, avgdl and idf_val; terms that no row has get df 0."""
    df = hits.groupBy("namespace", "lexeme").agg(F.count(F.lit(1)).cast("double").alias("df"))
    joined = terms.join(df, ["namespace", "lexeme"], "left").join(stats, "namespace", "left")
    joined = joined.fillna(0.0, ["df"]).fillna(1.0, ["n_total", "avgdl"])
    return joined.withColumn("idf_val", F.log((F.col("n_total") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0))


def session_admits(asked: Column, own: Column) -> Column:
    """No session asked for, the same session, or a row of no session."""
    return asked.isNull() | (own == asked) | own.isNull()


def keyword_scores(queries: DataFrame, index: KeywordIndex, *, mode: str = "any", analyzer: str = "simple") -> DataFrame:
    """(query_id, prop_id, bm25) of rows with any, or all, of a query's lexemes; positive scores only.

    Scores are rounded so that ties do not depend on the order of summation.
    """
    terms = staged(query_lexemes(queries, analyzer), "keyword-terms")
    hits = index.hits(terms.select("namespace", "lexeme").distinct())
    weighted = few(staged(inverse_frequencies(terms, hits, index.statistics()), "keyword-weights"))
    found = hits.join(weighted, ["namespace", "lexeme"]).filter(session_admits(F.col("q_session"), F.col("session_id")))
    tf = F.col("tf").cast("double")
    term = F.col("idf_val") * (tf * (K1 + 1)) / (tf + K1 * (1.0 - B + B * F.col("dl").cast("double") / F.col("avgdl")))
    sums = [F.round(F.sum(term), SCORE_DIGITS).alias("bm25")]
    if mode == "all":
        sums.append(F.countDistinct("lexeme").alias("matched"))
    scored = found.groupBy("query_id", "prop_id").agg(*sums)
    if mode == "all":
        size = terms.groupBy("query_id").agg(F.countDistinct("lexeme").alias("asked"))
        scored = scored.join(size, "query_id").filter("matched = asked")
    return scored.filter("bm25 > 0.0").select("query_id", "prop_id", "bm25")


def top_by(scored: DataFrame, score: str, k: int, *, descending: bool = True) -> DataFrame:
    """Rank within each query, ties to the smaller id, and the first k."""
    order = F.col(score).desc() if descending else F.col(score).asc_nulls_last()
    best = Window.partitionBy("query_id").orderBy(order, "prop_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def keyword_search(queries: DataFrame, index: KeywordIndex, k: int, *, mode: str = "any", analyzer: str = "simple") -> DataFrame:
    return top_by(keyword_scores(queries, index, mode=mode, analyzer=analyzer), "bm25", k)


def cover_density(words: Column, terms: Column) -> Column:
    """Sum over the shortest covers of all terms (distinct), each 0.1 over one plus the other words inside it.

    A cover ends at an occurrence of a term and begins at the earliest of the last occurrences of every term so far; it
    is a shortest one if it begins later than the cover before.
    """
    place = F.transform(words, lambda w, i: F.struct(i.alias("at"), F.array_position(terms, w).alias("term")))
    marks = F.filter(place, lambda x: x["term"] > 0)
    state = "struct<last: array<struct<nth: int, at: int>>, nth: int, begin: int, total: double>"
    none = F.struct(F.lit(-1).alias("nth"), F.lit(-1).alias("at"))
    zero = F.struct(F.transform(terms, lambda _: none).alias("last"), F.lit(0).alias("nth"), F.lit(-1).alias("begin"), F.lit(0.0).alias("total")).cast(state)

    def step(s: Column, x: Column) -> Column:
        here = F.struct(s["nth"].alias("nth"), x["at"].alias("at"))
        moved = F.transform(s["last"], lambda v, k: F.when(k == x["term"] - 1, here).otherwise(v))

        def close(last: Column) -> Column:
            first = F.array_min(last)
            new = (first["nth"] >= 0) & (first["nth"] > s["begin"])
            others = x["at"] - first["at"] - (s["nth"] - first["nth"])
            return F.struct(
                last.alias("last"), (s["nth"] + 1).alias("nth"), F.when(new, first["nth"]).otherwise(s["begin"]).alias("begin"),
                (s["total"] + F.when(new, F.lit(0.1) / (1 + others)).otherwise(0.0)).alias("total"),
            ).cast(state)

        return F.get(F.transform(F.array(moved), close), F.lit(0))

    return F.aggregate(marks, zero, step, lambda s: s["total"])


def cover_density_search(queries: DataFrame, rows: DataFrame, k: int, *, analyzer: str = "simple") -> DataFrame:
    """The older ranking: rows with all lexemes, by cover density."""
    terms = query_lexemes(queries, analyzer).groupBy("query_id", "namespace", "q_session").agg(F.sort_array(F.collect_set("lexeme")).alias("terms"))
    match = row_words(rows, analyzer).join(few(terms), "namespace").filter(session_admits(F.col("q_session"), F.col("session_id")))
    match = match.filter(F.size(F.array_except("terms", "words")) == 0)
    scored = match.select("query_id", "prop_id", F.round(cover_density(F.col("words"), F.col("terms")), SCORE_DIGITS).alias("density"))
    return top_by(scored, "density", k)
