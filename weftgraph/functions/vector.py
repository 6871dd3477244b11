"""Vector expressions and block-wise exact nearest neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries held by one task at a time; more are answered in further passes.
QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_similarity(a: Column, b: Column) -> Column:
    """Null where a vector is null or zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def l2_normalise(a: Column) -> Column:
    size = norm(a)
    return F.transform(a, lambda x: x / F.when(size < 1e-10, F.lit(1.0)).otherwise(size))


def hashing_embedder(dims: int = 1024) -> Callable[[list[str]], np.ndarray]:
    """Deterministic default embedder: words hashed to signed dimensions, unit length."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dims), np.float32)
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % dims] += 1 if h >> 63 else -1
        size = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(size < 1e-10, 1, size)

    return embed


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of an Arrow list column without nulls as one matrix, straight from its buffer."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(column) and len(flat) % len(column):
        raise ValueError("vectors of different dimensions")
    return flat.reshape(len(column), -1).astype(np.float64)


def unit_rows(m: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest(block: list[tuple], k: int, digits: int):
    """Each batch's k nearest rows to each query of its namespace and session."""
    groups: dict[str, list[int]] = {}
    for i, q in enumerate(block):
        groups.setdefault(q[2], []).append(i)
    schema = pa.schema([("query_id", pa.string()), ("prop_id", pa.string()), ("distance", pa.float64())])
    units = {ns: unit_rows(np.array([block[i][1] for i in rows], np.float64)) for ns, rows in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            space = np.array(b.column("namespace").to_pylist(), object)
            session = np.array(b.column("session_id").to_pylist(), object)
            ids = np.array(b.column("id").to_pylist(), object)
            vectors = unit_rows(matrix(b.column("embedding")))
            out: list[tuple] = []
            for ns, members in groups.items():
                rows = np.flatnonzero(space == ns)
                if not len(rows):
                    continue
                distance = np.round(1 - vectors[rows] @ units[ns].T, digits)
                free = np.equal(session[rows], None)
                for j, q in enumerate(members):
                    d = distance[:, j]
                    ok = ~np.isnan(d)
                    if block[q][3] is not None:
                        ok &= free | (session[rows] == block[q][3])
                    d, mine = d[ok], ids[rows[ok]]
                    if len(d) > k:  # ties at the edge stay in until ids decide
                        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
                        d, mine = d[near], mine[near]
                    best = np.lexsort((mine.astype(str), d))[:k]
                    out += [(block[q][0], mine[i], float(d[i])) for i in best]
            if out:
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Exact k nearest rows by cosine distance: (query_id, prop_id, distance, rank).

    rows: id, namespace, session_id, embedding; queries: query_id, q_embedding, namespace, session_id. A query's session
    admits rows of that session or of none. Every task keeps k rows a query before anything is shuffled. Distances are
    rounded so that ties are the same in any order of summation; ties go to the smaller id.
    """
    asked = queries.filter("q_embedding IS NOT NULL").select("query_id", "q_embedding", "namespace", "session_id").collect()
    found = None
    for at in range(0, max(1, len(asked)), QUERY_BLOCK):
        block = [tuple(r) for r in asked[at : at + QUERY_BLOCK]]
        spaces = sorted({q[2] for q in block})
        near = rows.filter(F.col("namespace").isin(spaces) & F.col("embedding").isNotNull())
        near = near.select(F.col("id").cast("string").alias("id"), "namespace", "session_id", "embedding")
        near = near.mapInArrow(_nearest(block, k, digits), "query_id string, prop_id string, distance double")
        found = near if found is None else found.unionByName(near)
    best = Window.partitionBy("query_id").orderBy("distance", "prop_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


class CellIndex:
    """Inverted file of vectors: each row lies in the cell of its nearest centroid, and a query reads only some cells.

    The centroids are fitted by k-means on at most SAMPLE_ROWS rows; every row is indexed. Distances of the rows that are
    read are exact, so the only loss is a near row in a cell that is not probed; probing all cells is exact.
    """

    SAMPLE_ROWS, STEPS = 20_000, 10

    def __init__(self, centroids: np.ndarray, rows: DataFrame):
        self.centroids, self.rows = centroids, rows

    @classmethod
    def build(cls, rows: DataFrame, path: str, cells: int = 64, seed: int = 7) -> CellIndex:
        """Index rows (id, namespace, session_id, embedding) with an embedding; written under path by cell."""
        have = rows.filter("embedding IS NOT NULL").select(F.col("id").cast("string").alias("id"), "namespace", "session_id", "embedding")
        total = have.count()
        share = min(1.0, 1.2 * cls.SAMPLE_ROWS / max(1, total))
        some = have.select("embedding").sample(share, seed).limit(cls.SAMPLE_ROWS).toArrow()
        centroids = np.zeros((1, 1))
        if some.num_rows:
            x = np.nan_to_num(unit_rows(matrix(some.column(0).combine_chunks())))
            centroids = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)]
            for _ in range(cls.STEPS):
                at = np.argmax(x @ centroids.T, axis=1)
                sums = np.zeros_like(centroids)
                np.add.at(sums, at, x)
                centroids = np.nan_to_num(unit_rows(np.where(np.bincount(at, minlength=len(centroids))[:, None] > 0, sums, centroids)))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.argmax(np.nan_to_num(unit_rows(matrix(b.column("embedding")))) @ centroids.T, axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

        placed = have.mapInArrow(assign, "id string, namespace string, session_id string, embedding array<float>, cell int")
        placed.write.partitionBy("cell").parquet(path)
        schema = "id string, namespace string, session_id string, embedding array<float>, cell int"
        return cls(centroids, rows.sparkSession.read.schema(schema).parquet(path))

    def nearest(self, queries: DataFrame, k: int, probes: int = 8, digits: int = 9) -> DataFrame:
        """As `nearest`, over the probed cells of each query: (query_id, prop_id, distance, rank)."""
        asked = [tuple(r) for r in queries.filter("q_embedding IS NOT NULL").select("query_id", "q_embedding", "namespace", "session_id").collect()]
        by_cells: dict[int, list[tuple]] = {}
        for q in asked:
            near = np.argsort(-self.centroids @ np.nan_to_num(unit_rows(np.array([q[1]], np.float64)))[0])[:probes]
            for cell in near.tolist():
                by_cells.setdefault(cell, []).append(q)
        kept = self.rows.filter(F.col("cell").isin(sorted(by_cells)))  # the other cells' files are not read

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            search = {cell: _nearest(block, k, digits) for cell, block in by_cells.items()}
            for b in batches:
                cells = b.column("cell").to_numpy()
                for cell in np.unique(cells).tolist():
                    yield from search[cell](iter([b.filter(pa.array(cells == cell))]))

        found = kept.mapInArrow(run, "query_id string, prop_id string, distance double")
        best = Window.partitionBy("query_id").orderBy("distance", "prop_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
