"""Knowledge-base relations derived from the shared test tables, in Spark and in DuckDB's SQL."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.shared import spread

AS_OF = datetime(2024, 3, 1, tzinfo=UTC)
ACCESSED, ASSERTED = 1704067200, 1706745600  # 2024-01-01 and 2024-02-01 in UTC
ASKED = [
    ("q1", "the thing ering of", 3, "en", None),
    ("q2", "erth anou and and", 7, "en", "src0"),
    ("q3", "der einge und zu", 11, "de", None),
    ("q4", "la menteau que pas", 23, "fr", "src1"),
    ("q5", "que de el menteado", 42, "es", None),
    ("q6", None, 5, "en", None),
    ("q7", "heti and licensed", None, "en", None),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet")) if name == "documents" else spark.read.parquet(f"{sf_dir}/{name}.parquet")


def propositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    q = table(spark, sf_dir, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    d = d.join(e, "doc_id", "left").join(q, "doc_id", "left")
    return d.select(
        i.cast("string").alias("id"),
        "text",
        "embedding",
        F.when(i % 5 != 0, F.concat(F.lit("e"), (i % 50).cast("string"))).alias("subject_id"),
        F.lit("mentions").alias("predicate"),
        F.concat(F.lit("e"), ((i * 7 + 3) % 50).cast("string")).alias("object_id"),
        F.lit(None).cast("string").alias("chunk_id"),
        F.col("lang").alias("namespace"),
        F.when(i % 3 != 0, F.col("source")).alias("session_id"),
        F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.5).otherwise(0.8).cast("float").alias("confidence"),
        F.timestamp_seconds(ACCESSED - i * 60).alias("last_accessed_at"),
        (F.col("n_chars") % 7).cast("int").alias("access_count"),
        F.when(i % 17 == 0, (i + 1).cast("string")).alias("superseded_by"),
        F.when(i % 2 == 0, F.timestamp_seconds(ASSERTED - i * 120)).alias("asserted_at"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    e = lambda x: F.concat(F.lit("e"), x.cast("string"))
    return table(spark, sf_dir, "documents").select(
        e(i % 50).alias("src_entity"), e((i * 7 + 3) % 50).alias("dst_entity"), F.lit("mentions").alias("relation"),
        (1 + i % 3).cast("float").alias("weight"), i.cast("string").alias("proposition_id"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame(ASKED, "query_id string, q_text string, vec_id long, namespace string, session_id string")
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("q_embedding"))
    return e.join(F.broadcast(asked), "vec_id", "right").select("query_id", "q_text", "q_embedding", "namespace", "session_id")


def _quoted(x: object) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)


#: Common table expressions by name: the names they need, and their text.
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "props": (
        (),
        f"""
  SELECT CAST(d.doc_id AS VARCHAR) AS id, d.text, e.embedding, d.lang AS namespace, 'mentions' AS predicate,
         CASE WHEN d.doc_id % 5 <> 0 THEN 'e' || CAST(d.doc_id % 50 AS VARCHAR) END AS subject_id,
         'e' || CAST((d.doc_id * 7 + 3) % 50 AS VARCHAR) AS object_id,
         CASE WHEN d.doc_id % 3 <> 0 THEN d.source END AS session_id,
         CAST(CASE WHEN l.quality = 1 THEN 1.0 WHEN l.quality = 0 THEN 0.5 ELSE 0.8 END AS REAL) AS confidence,
         {ACCESSED} - d.doc_id * 60 AS accessed_s, CAST(d.n_chars % 7 AS INTEGER) AS access_count,
         CASE WHEN d.doc_id % 17 = 0 THEN CAST(d.doc_id + 1 AS VARCHAR) END AS superseded_by,
         CASE WHEN d.doc_id % 2 = 0 THEN {ASSERTED} - d.doc_id * 120 END AS asserted_s
  FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    ),
    "act": (("props",), "SELECT * FROM props WHERE superseded_by IS NULL"),
    "edg": (
        (),
        """
  SELECT 'e' || CAST(doc_id % 50 AS VARCHAR) AS src_entity, 'e' || CAST((doc_id * 7 + 3) % 50 AS VARCHAR) AS dst_entity,
         CAST(doc_id AS VARCHAR) AS proposition_id FROM documents""",
    ),
    "asked": (
        (),
        "SELECT a.*, e.embedding AS q_embedding FROM (VALUES "
        + ", ".join("(" + ", ".join(map(_quoted, q)) + ")" for q in ASKED)
        + ") AS a(query_id, q_text, vec_id, namespace, session_id) LEFT JOIN embeddings e ON e.vec_id = a.vec_id",
    ),
    "tok": (
        ("act",),
        r"SELECT id AS prop_id, namespace, session_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS words FROM act",
    ),
    "post": (
        ("tok",),
        """
  SELECT namespace, prop_id, session_id, lexeme, dl, count(*) AS tf
  FROM (SELECT namespace, prop_id, session_id, len(list_distinct(words)) AS dl, unnest(words) AS lexeme FROM tok)
  GROUP BY ALL""",
    ),
    "stats": (
        ("tok",),
        """
  SELECT namespace, CAST(greatest(count(*), 1) AS DOUBLE) AS n_total,
         greatest(avg(len(list_distinct(words))), 1.0) AS avgdl FROM tok GROUP BY namespace""",
    ),
    "qlex": (
        ("asked",),
        r"""
  SELECT query_id, namespace, session_id AS q_session, unnest(regexp_extract_all(lower(q_text), '[\p{L}\p{N}]+')) AS lexeme
  FROM asked WHERE q_text IS NOT NULL AND q_text <> ''""",
    ),
    "idf": (
        ("qlex", "post", "stats"),
        """
  SELECT q.*, coalesce(f.df, 0.0) AS df, s.avgdl,
         ln((s.n_total - coalesce(f.df, 0.0) + 0.5) / (coalesce(f.df, 0.0) + 0.5) + 1.0) AS idf_val
  FROM qlex q JOIN stats s USING (namespace)
  LEFT JOIN (SELECT namespace, lexeme, CAST(count(*) AS DOUBLE) AS df FROM post GROUP BY ALL) f USING (namespace, lexeme)""",
    ),
    "bm": (
        ("idf", "post"),
        """
  SELECT i.query_id, p.prop_id, count(DISTINCT p.lexeme) AS matched,
         round(sum(i.idf_val * (p.tf * 2.2) / (p.tf + 1.2 * (1.0 - 0.75 + 0.75 * CAST(p.dl AS DOUBLE) / i.avgdl))), 9) AS bm25
  FROM post p JOIN idf i ON i.namespace = p.namespace AND i.lexeme = p.lexeme
  WHERE i.q_session IS NULL OR p.session_id = i.q_session OR p.session_id IS NULL
  GROUP BY i.query_id, p.prop_id""",
    ),
    "kw": (
        ("bm",),
        """
  SELECT query_id, prop_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, prop_id) AS rank
  FROM bm WHERE bm25 > 0 QUALIFY rank <= 200""",
    ),
    "kw_all": (
        ("bm", "qlex"),
        """
  SELECT query_id, prop_id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, prop_id) AS rank
  FROM bm JOIN (SELECT query_id, count(DISTINCT lexeme) AS n FROM qlex GROUP BY ALL) USING (query_id)
  WHERE bm25 > 0 AND matched = n QUALIFY rank <= 200""",
    ),
    "vec": (
        ("act", "asked"),
        """
  SELECT query_id, prop_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, prop_id) AS rank
  FROM (SELECT q.query_id, p.id AS prop_id,
               round(list_cosine_distance(CAST(p.embedding AS DOUBLE[]), CAST(q.q_embedding AS DOUBLE[])), 9) AS distance
        FROM act p JOIN asked q ON q.namespace = p.namespace
        WHERE p.embedding IS NOT NULL AND q.q_embedding IS NOT NULL
          AND (q.session_id IS NULL OR p.session_id = q.session_id OR p.session_id IS NULL))
  QUALIFY rank <= 200""",
    ),
    "fused": (
        ("kw", "vec"),
        """
  SELECT query_id, prop_id, k.rank IS NOT NULL AS in_kw, v.rank IS NOT NULL AS in_vec,
         CAST(coalesce(1.0::DOUBLE / (60 + k.rank), 0) + coalesce(1.0::DOUBLE / (60 + v.rank), 0) AS REAL) AS rrf
  FROM kw k FULL JOIN vec v USING (query_id, prop_id)""",
    ),
    "seeds": (
        ("fused", "act"),
        """
  SELECT query_id, entity_id, max(rrf) AS best
  FROM (SELECT f.query_id, p.subject_id AS entity_id, f.rrf FROM fused f JOIN act p ON p.id = f.prop_id
        UNION ALL SELECT f.query_id, p.object_id, f.rrf FROM fused f JOIN act p ON p.id = f.prop_id)
  WHERE entity_id IS NOT NULL GROUP BY query_id, entity_id
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY max(rrf) DESC, entity_id) <= 20""",
    ),
    "near": (
        ("seeds", "edg", "act", "asked", "fused"),
        """
  SELECT query_id, prop_id, CAST(0.5::DOUBLE * coalesce(least_rrf, 0) AS REAL) AS rrf, false AS in_kw, false AS in_vec
  FROM (SELECT DISTINCT s.query_id, e.proposition_id AS prop_id FROM edg e JOIN seeds s ON s.entity_id IN (e.src_entity, e.dst_entity)) t
  JOIN act p ON p.id = t.prop_id JOIN asked q USING (query_id)
  LEFT JOIN (SELECT query_id, min(rrf) AS least_rrf FROM fused GROUP BY query_id) m USING (query_id)
  WHERE p.namespace = q.namespace AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = t.query_id AND f.prop_id = t.prop_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY prop_id) <= 100""",
    ),
    "scored": (
        ("fused", "near", "act"),
        f"""
  SELECT c.query_id, c.prop_id, c.rrf, c.in_kw, c.in_vec, p.text, p.subject_id, p.predicate, p.object_id, p.asserted_s,
         CAST(greatest(CAST(c.rrf AS DOUBLE)
           * exp(greatest(-({int(AS_OF.timestamp())} - coalesce(p.asserted_s, p.accessed_s))::DOUBLE / (86400.0::DOUBLE * 30.0), -87.0))
           * (1.0 + ln(1.0 + p.access_count::DOUBLE)) * CAST(p.confidence AS DOUBLE), 0.0) AS REAL) AS adjusted
  FROM (SELECT query_id, prop_id, rrf, in_kw, in_vec FROM fused UNION ALL SELECT query_id, prop_id, rrf, in_kw, in_vec FROM near) c
  JOIN act p ON p.id = c.prop_id""",
    ),
}


CTES |= {
    "covers": (
        ("tok", "qlex"),
        """
  SELECT query_id, prop_id, sum(0.1::DOUBLE / (1 + (e.pos - b.pos) - (e.nth - b.nth))) AS density
  FROM (
    WITH t AS (SELECT DISTINCT query_id, namespace, q_session, lexeme FROM qlex),
    n AS (SELECT query_id, count(*) AS n FROM t GROUP BY ALL),
    w AS (SELECT prop_id, namespace, session_id, unnest(words) AS lexeme, generate_subscripts(words, 1) AS pos FROM tok),
    o AS (
      SELECT query_id, prop_id, pos, w.lexeme, row_number() OVER (PARTITION BY query_id, prop_id ORDER BY pos) AS nth
      FROM w JOIN t ON t.namespace = w.namespace AND t.lexeme = w.lexeme AND (q_session IS NULL OR session_id = q_session OR session_id IS NULL)),
    l AS (
      SELECT o.query_id, prop_id, pos, nth, max(CASE WHEN o.lexeme = t.lexeme THEN nth END) OVER (PARTITION BY o.query_id, prop_id, t.lexeme ORDER BY nth) AS last
      FROM o JOIN t ON t.query_id = o.query_id),
    f AS (SELECT query_id, prop_id, pos, nth, min(last) AS first FROM l JOIN n USING (query_id) GROUP BY query_id, prop_id, pos, nth, n HAVING count(last) = n),
    c AS (SELECT query_id, prop_id, first, min(nth) AS nth FROM f GROUP BY ALL)
    SELECT c.query_id, c.prop_id, x AS e, y AS b FROM c
    JOIN (SELECT query_id, prop_id, nth, o AS x FROM o) ox ON ox.query_id = c.query_id AND ox.prop_id = c.prop_id AND ox.nth = c.nth
    JOIN (SELECT query_id, prop_id, nth, o AS y FROM o) oy ON oy.query_id = c.query_id AND oy.prop_id = c.prop_id AND oy.nth = c.first)
  GROUP BY query_id, prop_id""",
    ),
    "cover": (
        ("covers",),
        """
  SELECT query_id, prop_id, round(density, 9) AS density, row_number() OVER (PARTITION BY query_id ORDER BY round(density, 9) DESC, prop_id) AS rank
  FROM covers QUALIFY rank <= 200""",
    ),
    "found": (
        ("scored",),
        """
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY adjusted DESC, prop_id) AS rank FROM scored QUALIFY rank <= 100""",
    ),
    "reranked": (
        ("found", "asked"),
        r"""
  SELECT query_id, prop_id, in_kw, in_vec, blended AS score, row_number() OVER (PARTITION BY query_id ORDER BY blended DESC, rank) AS place
  FROM (
    SELECT *, round(0.7::DOUBLE * CASE WHEN max(r) OVER q - min(r) OVER q < 1e-10 THEN 1.0 ELSE (r - min(r) OVER q) / (max(r) OVER q - min(r) OVER q) END
      + (1 - 0.7::DOUBLE) * CASE WHEN max(a) OVER q - min(a) OVER q < 1e-10 THEN 1.0 ELSE (a - min(a) OVER q) / (max(a) OVER q - min(a) OVER q) END, 9) AS blended
    FROM (
      SELECT *, adjusted::DOUBLE AS a, CASE WHEN len(terms) > 0 THEN len(list_intersect(terms, list_distinct(words)))::DOUBLE / len(terms) ELSE 0.0::DOUBLE END
        + 0.01::DOUBLE / (1 + coalesce(list_position(list_transform(words, lambda w: list_contains(terms, w)), true) - 1, len(words))) AS r
      FROM (
        SELECT f.*, regexp_extract_all(lower(coalesce(f.text, '')), '[\p{L}\p{N}_]+') AS words,
               list_distinct(regexp_extract_all(lower(coalesce(q_text, '')), '[\p{L}\p{N}_]+')) AS terms
        FROM found f JOIN asked USING (query_id) WHERE rank <= 64))
    WINDOW q AS (PARTITION BY query_id))""",
    ),
    "by_score": (("found",), "SELECT query_id, prop_id, in_kw, in_vec, adjusted::DOUBLE AS score, rank AS place FROM found"),
}


def diverse(candidates: str, k: int, lam: float) -> str:
    """Common table expressions that end in `picked` (query_id, pick, place): maximal marginal relevance, a pick a step."""
    dot = lambda a, b: f"list_inner_product({a}, {b})"
    unit = lambda x: f"list_transform({x}, lambda v: v / (sqrt({dot(x, x)}) + 1e-10))"
    gain = f"CASE WHEN list_contains(m.picks, i) THEN -1e9 ELSE round({lam}::DOUBLE * r - (1 - {lam}::DOUBLE) * m.red[i], 9) END"
    return f"""vectors AS MATERIALIZED (
  SELECT query_id, place, {unit("e")} AS u, {unit("q")} AS qu FROM (
    SELECT c.query_id, place, CAST(coalesce(p.embedding, a.q_embedding) AS DOUBLE[]) AS e, CAST(a.q_embedding AS DOUBLE[]) AS q
    FROM {candidates} c JOIN act p ON p.id = c.prop_id JOIN asked a ON a.query_id = c.query_id)),
grouped AS MATERIALIZED (
  SELECT query_id, list(u ORDER BY place) AS u, list({dot("u", "qu")} ORDER BY place) AS rel FROM vectors
  WHERE qu IS NOT NULL GROUP BY query_id HAVING count(*) > {k}),
m AS (
  SELECT query_id, [p] AS picks, list_transform(u, lambda x: {dot("x", "u[p]")}) AS red, u, rel
  FROM (SELECT *, list_position(list_transform(rel, lambda r: round(r, 9)), list_max(list_transform(rel, lambda r: round(r, 9)))) AS p FROM grouped)
  UNION ALL
  SELECT query_id, list_append(picks, p), list_transform(red, lambda r, i: greatest(r, {dot("u[i]", "u[p]")})), u, rel
  FROM (SELECT m.*, list_position(list_transform(rel, lambda r, i: {gain}), list_max(list_transform(rel, lambda r, i: {gain}))) AS p FROM m WHERE len(picks) < {k})),
picked AS (
  SELECT query_id, unnest(picks) AS place, generate_subscripts(picks, 1) AS pick FROM m WHERE len(picks) = {k}
  UNION ALL
  SELECT query_id, place, place AS pick FROM {candidates} WHERE place <= {k} AND query_id NOT IN (SELECT query_id FROM grouped))"""


def sql(select: str, *needed: str) -> str:
    """select after the common table expressions it needs, each once, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in CTES[name][0]:
            add(n)
        if name not in order:
            order.append(name)

    for n in needed:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in order) + "\n" + select
