"""Seed entities, one-hop expansion, PageRank and entity linking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions.text import trigram_similarity, trigrams
from weftgraph.functions.vector import cosine_distance
from weftgraph.sources.shared import few, staged
from weftgraph.sources.store import cut

SEEDS, NEIGHBOURS, NEIGHBOUR_SHARE = 20, 100, 0.5
#: Nodes and links of a graph that one task iterates over; larger ones are joined step by step.
ONE_TASK_ROWS = 2_000_000


def seed_entities(fused: DataFrame, rows: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """(query_id, entity_id, best_rrf): both ends of fused rows, the best ones of each query."""
    asked = few(fused.select("query_id", F.col("prop_id").alias("id"), "rrf_score"))
    ends = rows.select("id", "subject_id", "object_id").join(asked, "id")
    ends = ends.select("query_id", "rrf_score", F.explode(F.array("subject_id", "object_id")).alias("entity_id")).filter("entity_id IS NOT NULL")
    best = ends.groupBy("query_id", "entity_id").agg(F.max("rrf_score").alias("best_rrf"))
    order = Window.partitionBy("query_id").orderBy(F.col("best_rrf").desc(), "entity_id")
    return best.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= seeds).drop("_n")


def neighbours(
    queries: DataFrame, fused: DataFrame, seeds: DataFrame, edges: DataFrame, rows: DataFrame, *,
    limit: int = NEIGHBOURS, dedupe: bool = True, session_scoped: bool = False,
) -> DataFrame:
    """Rows on an edge that touches a seed, not fused themselves, of the query's namespace; half the least fused score."""
    seeds = staged(seeds, "seeds")
    ends = edges.select("proposition_id", "src_entity", "dst_entity", F.monotonically_increasing_id().alias("_edge"))
    ends = ends.select("proposition_id", "_edge", F.explode(F.array_distinct(F.array("src_entity", "dst_entity"))).alias("entity_id"))
    touched = ends.join(few(seeds.select("query_id", "entity_id")), "entity_id").select("query_id", F.col("proposition_id").alias("prop_id"), "_edge").distinct()
    if dedupe:
        touched = touched.select("query_id", "prop_id").distinct()
    touched = touched.join(fused.select("query_id", "prop_id"), ["query_id", "prop_id"], "left_anti")
    scope = queries.select("query_id", F.col("namespace").alias("q_ns"), F.col("session_id").alias("q_session"))
    found = touched.join(rows.select(F.col("id").alias("prop_id"), "namespace", "session_id"), "prop_id").join(scope, "query_id").filter("namespace = q_ns")
    if session_scoped:
        found = found.filter("q_session IS NULL OR session_id IS NULL OR session_id = q_session")
    order = Window.partitionBy("query_id").orderBy("prop_id")
    found = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
    least = fused.groupBy("query_id").agg(F.min("rrf_score").alias("least"))
    found = found.join(least, "query_id", "left")
    score = (F.lit(NEIGHBOUR_SHARE) * F.coalesce("least", F.lit(0.0).cast("float")).cast("double")).cast("float")
    return found.select("query_id", "prop_id", score.alias("rrf_score"), F.lit(False).alias("in_kw"), F.lit(False).alias("in_vec"))


def pagerank(entities: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, checkpoint_every: int = 5) -> DataFrame:
    """(entity_id, score): weighted power iteration; what leaves the namespace or an end is dropped, not spread.

    entities: id of one namespace; edges: src_entity, dst_entity, weight of all namespaces.
    """
    nodes = staged(entities.select(F.col("id").alias("entity_id")).distinct(), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("score", F.lit(0.0))
    # Parallel edges add up, so each pair of nodes is one row of the transition.
    total = edges.groupBy("src_entity").agg(F.sum("weight").alias("total"))
    share = edges.groupBy("src_entity", "dst_entity").agg(F.sum("weight").alias("weight")).join(total, "src_entity")
    share = share.join(nodes.withColumnRenamed("entity_id", "src_entity"), "src_entity", "left_semi")
    share = staged(share.select("src_entity", "dst_entity", (F.col("weight") / F.col("total")).alias("share")), "pagerank")
    if n + share.count() <= ONE_TASK_ROWS:
        return _pagerank_in_one_task(nodes, share, iterations, damping)
    base = (1.0 - damping) / n
    rank = nodes.withColumn("score", F.lit(1.0 / n))
    for i in range(1, iterations + 1):
        sent = share.join(rank.withColumnRenamed("entity_id", "src_entity"), "src_entity")
        got = sent.groupBy(F.col("dst_entity").alias("entity_id")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        rank = nodes.join(got, "entity_id", "left").select("entity_id", (F.lit(base) + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("score"))
        if i % checkpoint_every == 0 and i < iterations:
            rank = cut(rank)
    return rank


def _pagerank_in_one_task(nodes: DataFrame, share: DataFrame, iterations: int, damping: float) -> DataFrame:
    """The power iteration over a graph that one task holds."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs), ignore_index=True)
        ids = pd.Index(rows.loc[rows["dst"].isna(), "src"])
        edge = rows[rows["dst"].notna()]
        src, dst, part = ids.get_indexer(edge["src"]), ids.get_indexer(edge["dst"].astype(ids.dtype)), edge["share"].to_numpy()
        inside = dst >= 0  # what leaves the namespace is dropped
        score = np.full(len(ids), 1.0 / len(ids))
        for _ in range(iterations):
            score = (1.0 - damping) / len(ids) + damping * np.bincount(dst[inside], score[src[inside]] * part[inside], len(ids))
        yield pd.DataFrame({"entity_id": ids, "score": score})

    kind = nodes.schema["entity_id"].dataType.simpleString()
    alone = nodes.select(F.col("entity_id").alias("src"), F.lit(None).cast(kind).alias("dst"), F.lit(0.0).alias("share"))
    every = alone.unionByName(share.select(F.col("src_entity").alias("src"), F.col("dst_entity").alias("dst"), "share"))
    return every.repartition(1).mapInPandas(run, f"entity_id {kind}, score double")


def link_entities(requests: DataFrame, entities: DataFrame, threshold: float = 0.85, name_threshold: float = 0.6) -> DataFrame:
    """(request_id, entity_id, how) for requests (request_id, namespace, name, type, embedding); how: exact, fuzzy or new.

    Exact name and type first; else the nearest entity of the namespace above both thresholds, whatever its type; else a
    new entity whose id is a hash of namespace, name and type. Fuzzy candidates meet on shared trigrams: a similarity
    over s needs a shared trigram among the rarest few of both names, so only those block. Requests are matched against
    the given entities; names that are new in one batch share an id if they are equal.
    """
    asked = requests.withColumn("_type", F.coalesce("type", F.lit("\x00")))
    known = entities.withColumn("_type", F.coalesce("type", F.lit("\x00")))
    exact = known.groupBy("namespace", "name", "_type").agg(F.min("id").alias("entity_id"))
    matched = asked.join(exact, ["namespace", "name", "_type"], "left")
    found = matched.filter("entity_id IS NOT NULL").select("request_id", "entity_id", F.lit("exact").alias("how"))
    rest = matched.filter("entity_id IS NULL").drop("entity_id")

    left = rest.filter("embedding IS NOT NULL").select("request_id", "namespace", trigrams(F.col("name")).alias("a"), F.col("embedding").alias("q"))
    right = known.filter("embedding IS NOT NULL").select("namespace", F.col("id").alias("entity_id"), trigrams(F.col("name")).alias("b"), F.col("embedding").alias("e"))
    # Similar sets share at least ceil(s * |A|) trigrams, so the first |A| - that + 1 of a common order must meet; the
    # order is by rarity among the known names, so common trigrams bring nobody together while there are rarer ones.
    known_in = right.select("namespace", F.explode("b").alias("t")).groupBy("namespace", "t").agg(F.count(F.lit(1)).alias("names"))

    def heads(rows: DataFrame, ident: str, grams: str) -> DataFrame:
        each = rows.select(ident, "namespace", F.explode(grams).alias("t")).join(known_in, ["namespace", "t"], "left")
        order = F.sort_array(F.collect_list(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "t"))).alias("g")
        kept = F.size("g") - F.ceil(F.size("g") * F.lit(name_threshold)).cast("int") + 1
        return each.groupBy(ident, "namespace").agg(order).select(ident, "namespace", F.explode(F.slice("g", F.lit(1), F.greatest(kept, F.lit(1)))["t"]).alias("t"))

    pairs = heads(left, "request_id", "a").join(heads(right, "entity_id", "b"), ["namespace", "t"]).select("request_id", "entity_id").distinct()
    pairs = pairs.join(left.drop("namespace"), "request_id").join(right.drop("namespace"), "entity_id")
    distance = cosine_distance(F.col("q"), F.col("e"))
    pairs = pairs.filter(trigram_similarity(F.col("a"), F.col("b")) > name_threshold).withColumn("d", F.round(distance, 9))
    pairs = pairs.filter(1 - F.col("d") > threshold)
    nearest = Window.partitionBy("request_id").orderBy("d", "entity_id")
    fuzzy = pairs.withColumn("_n", F.row_number().over(nearest)).filter("_n = 1").select("request_id", "entity_id")
    rest = rest.join(fuzzy, "request_id", "left")
    fresh = F.sha2(F.concat_ws("\x1f", "namespace", "name", "_type"), 256)
    how = F.when(F.col("entity_id").isNull(), "new").otherwise("fuzzy")
    return found.unionByName(rest.select("request_id", F.coalesce("entity_id", fresh).alias("entity_id"), how.alias("how")))
