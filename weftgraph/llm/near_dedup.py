"""MinHash near-dedup with tensored banding and verified links.

Two collections of SKETCHES sketches of ROWS minhashes each are computed per document; the key of table (i, j) joins
sketch i of the first collection with sketch j of the second. 2 * SKETCHES * ROWS minhashes so give SKETCHES^2 tables of
2 * ROWS rows. At similarity 0.8 a pair shares no table with probability 2 * (1 - 0.8^ROWS)^SKETCHES, 7e-5 here; this is
the only way a link can be missed, and only if no chain of other links joins the two.

1. Documents with equal shingle sets collapse to their smallest id.
2. Each task groups its documents' table keys and links members to a leader itself; only leaders are shuffled. So a
   bucket that a third of all documents share sends one row a task. Leaders differ by table, in LEADERS ways.
3. Distinct candidate pairs within the size bound are verified on the full shingle sets, which are made again from the
   texts of the documents that have candidates.
4. Components of the verified links. Every member of a bucket outside its largest component is then compared with all
   of that component, in blocks of queries against blocks of members, until no link is new; last, those outside
   members are compared with each other in the same way. So no candidate pair is left out, and pairs inside one
   component are not made.

Cases: null, empty or white-space text has no shingles and is linked with nothing; a null id is linked with nothing and
kept; repeated rows share a component and are all kept or not by their id; two texts under one id are compared each
under that id; other columns are ignored; an empty table gives no rows. A worker holds the shingle hashes of the texts of one batch of BATCH_DOCS documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, batches, few, sliced, staged, with_text
from weftgraph.llm.components import components
from weftgraph.llm.words import U64, WordTable, mix

SKETCHES = 10
ROWS = 2
LEADERS = 4
BATCH_DOCS = 512
COMBINE_DOCS = 20_000
HOT_SETS = 1024
_SEEDS = mix(np.arange(1, 2 * SKETCHES * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
_SLICE = 1 << 14


def _minhashes(values: np.ndarray) -> np.ndarray:
    least = np.full(len(_SEEDS), 2**64 - 1, U64)
    for at in range(0, len(values), _SLICE):
        x = (values[at : at + _SLICE, None] ^ _SEEDS) * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(29)
        x *= U64(0x94D049BB133111EB)
        np.minimum(least, x.min(axis=0), out=least)
    return least


def _sets(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    return WordTable([x.lower() for x in as_bytes(batch.column("text"))]).shingles(k)


def _sketch(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.list_(pa.int64()))])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batch_iter, BATCH_DOCS):
            rows: dict[str, list] = {f.name: [] for f in schema}
            rows["doc_id"] = b.column("doc_id").to_pylist()
            for s in _sets(b, k):
                rows["n_shingles"].append(len(s))
                rows["digest"].append(xxhash.xxh3_128_digest(s.tobytes()))
                sketch: list = []
                if len(s):
                    m = _minhashes(s).reshape(-1, ROWS)
                    key = m[:, 0]
                    for r in range(1, ROWS):
                        key = mix(key * U64(0xD6E8FEB86659FD93) + m[:, r])
                    sketch = key.view(np.int64).tolist()
                rows["sketch"].append(sketch)
            yield batches(rows, schema)

    return run


def _local_tables(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(route, key, rep, leader): a member to its leader in this task (route is random), or a leader (route is the key)."""
    schema = pa.schema([(c, pa.int64()) for c in ("route", "key", "rep", "leader")])
    table = np.arange(SKETCHES * SKETCHES, dtype=U64)

    def combined(reps: list[np.ndarray], sketches: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        rep, sketch = np.concatenate(reps), np.concatenate(sketches)
        first, second = sketch[:, :SKETCHES], sketch[:, SKETCHES:]
        keys = mix(first[:, :, None] * U64(0xA24BAED4963EE407) + mix(second[:, None, :] + U64(1)))
        keys = mix(keys.reshape(len(rep), -1) + table * U64(0x9FB21C651E98DF25))
        order_key = mix(rep.astype(U64)[:, None] + (table % U64(LEADERS)) * U64(0xC2B2AE3D27D4EB4F)).ravel()
        keys, owner = keys.ravel(), np.repeat(np.arange(len(rep)), SKETCHES * SKETCHES)
        order = np.lexsort((order_key, keys))
        keys, owner = keys[order], owner[order]
        head = np.concatenate(([True], keys[1:] != keys[:-1]))
        leader = rep[owner[np.maximum.accumulate(np.where(head, np.arange(len(keys)), 0))]]
        member = rep[owner]
        route = np.where(head, keys, mix(keys + member.astype(U64) * U64(3)))
        for at in range(0, len(keys), 1 << 18):
            part = slice(at, at + (1 << 18))
            yield pa.RecordBatch.from_arrays([pa.array(x[part].view(np.int64)) for x in (route, keys, member, leader)], schema=schema)

    reps, sketches, held = [], [], 0
    for b in batch_iter:
        if not b.num_rows:
            continue
        reps.append(b.column("rep").to_numpy())
        sketches.append(b.column("sketch").flatten().to_numpy().reshape(-1, 2 * SKETCHES).view(U64))
        held += b.num_rows
        if held >= COMBINE_DOCS:
            yield from combined(reps, sketches)
            reps, sketches, held = [], [], 0
    if held:
        yield from combined(reps, sketches)


def _shingle_sets(k: int):
    schema = pa.schema([("rep", pa.int64()), ("shingles", pa.binary())])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batch_iter, BATCH_DOCS):
            yield batches({"rep": b.column("doc_id").to_pylist(), "shingles": [s.tobytes() for s in _sets(b, k)]}, schema)

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batch_iter, BATCH_DOCS):
            rows: dict[str, list] = {"a": [], "b": []}
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "x", "y")), strict=True):
                u, v = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.concatenate((u, v))
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    rows["a"].append(a)
                    rows["b"].append(b)
            yield batches(rows, schema)

    return run


QUERY_BLOCK, BASE_BLOCK = 256, 512


def _compare(percent: int):
    """Links of a block of queries to a block of a component's members, all queries at once for each member."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rep, query = table.column("rep").to_pylist(), table.column("query").to_pylist()
        sets = [np.frombuffer(x, U64) for x in table.column("shingles").to_pylist()]
        asked = [i for i, q in enumerate(query) if q]
        links: dict[str, list] = {"a": [], "b": []}
        if asked:
            sizes = np.array([len(sets[i]) for i in asked])
            owner = np.repeat(np.arange(len(asked)), sizes)
            every = np.concatenate([sets[i] for i in asked])
            order = np.argsort(every, kind="stable")
            every, owner = every[order], owner[order]
            for i, q in enumerate(query):
                if q:
                    continue
                low, high = np.searchsorted(every, sets[i], "left"), np.searchsorted(every, sets[i], "right")
                n = high - low
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                shared = np.bincount(owner[at], minlength=len(asked))
                for j in np.flatnonzero(100 * shared >= percent * (sizes + len(sets[i]) - shared)):
                    if (x := rep[asked[j]]) != rep[i]:
                        links["a"].append(min(x, rep[i]))
                        links["b"].append(max(x, rep[i]))
        return pa.table(links, schema=schema)

    return run


def _against(asked: DataFrame, whole: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of asked (base, rep) to the members of their base component, in blocks of both sides."""
    queries = asked.groupBy("base").agg(F.count(F.lit(1)).alias("k"))
    grid = whole.groupBy(F.col("component").alias("base")).agg(F.count(F.lit(1)).alias("n")).join(queries, "base")
    grid = grid.select("base", F.expr(f"(k + {QUERY_BLOCK - 1}) div {QUERY_BLOCK}").alias("k"), F.expr(f"(n + {BASE_BLOCK - 1}) div {BASE_BLOCK}").alias("n"))
    grid = staged(grid, "grid")
    grid = few(grid, grid.count())  # one row a component that has open buckets
    mine, others = F.pmod(F.xxhash64("rep"), F.col("k")), F.pmod(F.xxhash64("rep"), F.col("n"))
    q = asked.join(grid, "base").select("base", "rep", mine.alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("bb"), F.lit(True).alias("query"))
    m = whole.withColumnRenamed("component", "base").join(grid, "base")
    m = m.select("base", "rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("qb"), others.alias("bb"), F.lit(False).alias("query"))
    rows = q.unionByName(m).join(sets, "rep")
    return rows.groupBy("base", "qb", "bb").applyInArrow(_compare(percent), "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(_verify(percent), "a long, b long")


def near_duplicates(df: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Links: 100 * shared >= percent * union."""
    docs = with_text(df, id_col, text_col)
    sketched = staged(docs.mapInArrow(_sketch(shingle), "doc_id long, n_shingles long, digest binary, sketch array<long>"), "sketches")
    usable = sketched.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = usable.groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    reps = staged(reps, "representatives")

    tables = reps.select("rep", "sketch").mapInArrow(_local_tables, "route long, key long, rep long, leader long")
    bucket = Window.partitionBy("route")
    tables = tables.withColumn("top", F.min("leader").over(bucket)).withColumn("n", F.count(F.lit(1)).over(bucket))
    members = tables.filter("n > 1 OR rep != leader").select("key", "rep", "leader", "top")
    members = staged(members, "buckets")

    sizes = reps.select("rep", "n_shingles")

    def sized(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).filter("a != b").distinct()
        pairs = pairs.join(sizes.select(F.col("rep").alias("a"), F.col("n_shingles").alias("na")), "a")
        pairs = pairs.join(sizes.select(F.col("rep").alias("b"), F.col("n_shingles").alias("nb")), "b")
        return pairs.filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b").distinct()

    pairs = members.select(F.col("rep").alias("p"), F.col("leader").alias("q")).unionByName(members.select(F.col("leader").alias("p"), F.col("top").alias("q")))
    pairs = staged(sized(pairs), "pairs")
    ids = members.select(F.explode(F.array("rep", "leader", "top")).alias("doc_id")).distinct()
    sets = staged(docs.join(ids, "doc_id", "left_semi").mapInArrow(_shingle_sets(shingle), "rep long, shingles binary"), "sets")
    links = staged(_verified(pairs, sets, percent), "links")
    found = staged(components(links), "components")

    # Buckets that still hold several components: every member outside a bucket's largest one is compared with all of
    # that component, block by block, until nothing new is linked.
    inside = staged(members.select("key", F.explode(F.array("rep", "leader")).alias("rep")).distinct(), "members")
    while True:
        of = inside.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        whole = of.select("rep", "component").distinct()
        size = whole.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
        per_key = of.groupBy("key", "component").agg(F.count(F.lit(1)).alias("here")).join(size, "component")
        of_key = per_key.groupBy("key").agg(
            F.max(F.struct("size", "component"))["component"].alias("base"), F.count(F.lit(1)).alias("several"), F.sum("here").alias("n")
        )
        open_keys = staged(of_key.filter("several > 1 AND n > 2").select("key", "base"), "open")
        asked = of.join(open_keys, "key").filter("component != base").select("base", "rep").distinct()
        asked = staged(asked, "asked")
        more = staged(_against(asked, whole, sets, percent), "links")
        if more.isEmpty():
            break
        links = links.unionByName(more)
        found = staged(components(links), "components")

    # What is left are pairs outside the largest component of their bucket; both were asked against the same base.
    more = staged(_against(asked, asked.select("rep", F.col("base").alias("component")), sets, percent), "links")
    if not more.isEmpty():
        found = staged(components(links.unionByName(more)), "components")

    of_set = reps.select("digest", "n_shingles", "rep", "copies").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of_set = staged(of_set.select("digest", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "copies"), "component-of-set")
    # Fewer than HOT_SETS sets can have more than 1 / HOT_SETS of all documents; their documents are not shuffled.
    limit = max(1, sketched.count() // HOT_SETS)
    hot = of_set.filter(F.col("copies") > limit).select("digest", "n_shingles", F.col("component_id").alias("hot_id"))
    cold = of_set.filter(F.col("copies") <= limit).select("digest", "n_shingles", "component_id")
    linked = usable.select("doc_id", "n_shingles", "digest").join(F.broadcast(hot), ["digest", "n_shingles"], "left")
    result = linked.filter("hot_id IS NOT NULL").select("doc_id", "n_shingles", F.col("hot_id").alias("component_id"))
    result = result.unionByName(linked.filter("hot_id IS NULL").join(cold, ["digest", "n_shingles"]).select("doc_id", "n_shingles", "component_id"))
    alone = sketched.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return result.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
