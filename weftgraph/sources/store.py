"""Parquet store: append-only tables, event logs folded at read, and compaction."""

from __future__ import annotations

import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.text import counted
from weftgraph.operators.keyword import row_words, statistics
from weftgraph.schema import PARTITIONED, TABLES
from weftgraph.sources.shared import CODEC, few, shared_dir, staged

KEYWORD_BUCKETS = 64
#: Files that a task writes side by side; for more it would sort its rows by partition first.
OPEN_FILES = 2 * KEYWORD_BUCKETS


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fold_access(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with access_count and last_accessed_at as of the events; an id counts once an event batch (equal ts)."""
    seen = events.select("proposition_id", "ts").distinct().groupBy("proposition_id")
    seen = seen.agg(F.count(F.lit(1)).alias("_n"), F.max("ts").alias("_ts"))
    joined = rows.join(seen.withColumnRenamed("proposition_id", "id"), "id", "left")
    count = (F.col("access_count") + F.coalesce("_n", F.lit(0))).cast("int")
    last = F.greatest("last_accessed_at", "_ts")
    return joined.withColumn("access_count", count).withColumn("last_accessed_at", last).select(*rows.columns)


def fold_supersede(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows with superseded_by of the last event; an event without replacement supersedes a row by itself."""
    last = events.groupBy("proposition_id").agg(F.max_by(F.coalesce("replacement", "proposition_id"), "ts").alias("_by"))
    joined = rows.join(last.withColumnRenamed("proposition_id", "id"), "id", "left")
    return joined.withColumn("superseded_by", F.coalesce("_by", "superseded_by")).select(*rows.columns)


def marks(gone: DataFrame, key: str, at: str) -> DataFrame:
    """(key, _block, _bits): the numbers `at` under each key as bits, 4096 a row, so that many rows are few enough to broadcast."""
    bit = F.expr(f"shiftleft(1L, CAST({at} & 63 AS INT))")
    words = gone.groupBy(key, F.shiftright(at, 6).alias("_word")).agg(F.bit_or(bit).alias("_mask"))
    each = F.map_from_entries(F.collect_list(F.struct(F.col("_word").bitwiseAND(63).cast("int"), "_mask")))
    blocks = words.groupBy(key, F.shiftright("_word", 6).alias("_block")).agg(each.alias("_masks"))
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.try_element_at("_masks", i), F.lit(0).cast("long")))
    return blocks.select(key, "_block", bits.alias("_bits"))


def unmarked(df: DataFrame, marked: DataFrame, key: str, at: str) -> DataFrame:
    """The rows of df that marks(..., key, at) does not name; df is not shuffled."""
    found = df.withColumn("_block", F.shiftright(at, 12)).join(few(staged(marked, "marks")), [key, "_block"], "left")
    mask = F.get("_bits", F.shiftright(at, 6).bitwiseAND(63).cast("int"))
    return found.filter(F.coalesce(F.getbit(mask, F.col(at).bitwiseAND(63).cast("int")), F.lit(0)) == 0).select(*df.columns)


def active(rows: DataFrame) -> DataFrame:
    return rows.filter("superseded_by IS NULL")


class Store:
    """Tables of one knowledge base under a root path that every executor can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def migrate(self) -> list[str]:
        """Finish an interrupted swap, then apply the migrations that the log does not name yet, in order."""
        self._finish_swap()
        done = {r.name for r in self.read("migrations").collect()}
        steps = {"001_tables": self._create_tables, "002_keyword_index": self._index_keywords}
        new = [name for name in sorted(steps) if name not in done]
        for name in new:
            steps[name]()
            self._write("migrations", self.spark.createDataFrame([(name, datetime.now(UTC))], TABLES["migrations"]))
        if "002_keyword_index" in done:
            self._renew_index()
        return new

    def _create_tables(self) -> None:
        for name in TABLES:
            if not self._exists(name):
                self._write(name, self.spark.createDataFrame([], TABLES[name]))

    def _index_keywords(self) -> None:
        """Postings of rows that were written before there were any."""
        have = self.read("lengths").select(F.col("prop_id").alias("id"))
        self.index_keywords(self.read("propositions").join(have, "id", "left_anti"))

    def _renew_index(self) -> None:
        """Index anew what was indexed when postings held ids; what was renewed before an interruption stays."""
        lengths = self.read("lengths")
        for analyzer in [r.analyzer for r in lengths.filter("ref IS NULL").select("analyzer").distinct().collect()]:
            own = lengths.filter(F.col("analyzer") == analyzer)
            old, new = (own.filter(f"ref IS {x}NULL").select(F.col("prop_id").alias("id")) for x in ("", "NOT "))
            self.index_keywords(self.read("propositions").join(old, "id", "left_semi").join(new, "id", "left_anti"), analyzer)
            keep = (F.col("analyzer") != analyzer) | F.col("ref").isNotNull()
            self._swap({name: self.read(name).filter(keep) for name in ("postings", "lengths")})

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _exists(self, name: str) -> bool:
        files, at = self._fs(self._path(name))
        return files.exists(at)

    def _write(self, name: str, df: DataFrame, mode: str = "append", path: str | None = None) -> None:
        writer, conf, writers = df.write.mode(mode), self.spark.conf, "spark.sql.maxConcurrentOutputFileWriters"
        if name in PARTITIONED:
            writer = writer.partitionBy(*PARTITIONED[name])
        before = conf.get(writers)
        conf.set(writers, str(OPEN_FILES))
        try:
            writer.parquet(path or self._path(name), compression=CODEC)
        finally:
            conf.set(writers, before)

    def _swap(self, tables: dict[str, DataFrame]) -> None:
        """Replace tables together: all are written aside, then a journal names them, then they are moved. What fails
        before the journal leaves the old tables, what fails after it is finished by the next migrate."""
        aside = {name: f"{self.root}/_aside-{name}-{uuid.uuid4().hex}" for name in tables}
        for name, df in tables.items():
            self._write(name, df.select(*TABLES[name].names), path=aside[name])
        lines = [(f"{name}\t{path}",) for name, path in aside.items()]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.text(f"{self.root}/_swap")
        self._finish_swap()

    def _finish_swap(self) -> None:
        journal = f"{self.root}/_swap"
        files, at = self._fs(journal)
        if not files.exists(at):
            return
        if files.exists(self._fs(f"{journal}/_SUCCESS")[1]):
            for row in self.spark.read.text(journal).collect():
                name, path = row.value.split("\t")
                new, old = self._fs(path)[1], self._fs(self._path(name))[1]
                if files.exists(new):
                    files.delete(old, True)
                    files.rename(new, old)
        files.delete(at, True)

    def read(self, name: str, namespace: str | None = None) -> DataFrame:
        schema = TABLES[name]
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(schema).parquet(self._path(name)).select(*schema.names)
        return df.filter(F.col("namespace") == namespace) if namespace is not None else df

    def append(self, name: str, df: DataFrame, key: tuple[str, ...] = ()) -> None:
        """Append rows; with a key, only the first of each key and only keys that are not there yet."""
        schema = TABLES[name]
        df = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
        if key:
            df = df.dropDuplicates(list(key))
            old = self.read(name).select(*[F.col(c).alias(f"_{c}") for c in key])
            same = F.lit(True)
            for c in key:
                same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
            df = df.join(old, same, "left_anti")
        self._write(name, df)

    def propositions(self, namespace: str | None = None) -> DataFrame:
        """Propositions with accesses and supersessions folded in."""
        rows = fold_access(self.read("propositions", namespace), self.read("access_events"))
        return fold_supersede(rows, self.read("supersede_events"))

    def active(self, namespace: str | None = None) -> DataFrame:
        return active(self.propositions(namespace))

    def superseded(self) -> DataFrame:
        """prop_id of rows that are not active any more."""
        gone = self.read("supersede_events").select(F.col("proposition_id").alias("prop_id"))
        return gone.union(self.read("propositions").filter("superseded_by IS NOT NULL").select("id")).distinct()

    def index_keywords(self, rows: DataFrame, analyzer: str = "english") -> None:
        """Write the postings and lengths of rows, by namespace and hash of the lexeme. Each text is read once, nothing is
        shuffled or sorted: a task leaves a file a bucket. Postings without lengths are not found, so lengths come last."""
        counts = row_words(rows, analyzer).select("namespace", "prop_id", "session_id", counted(F.col("words")).alias("counts"))
        kept = staged(counts.withColumn("ref", F.monotonically_increasing_id()), "keyword-counts")
        kept = kept.withColumns({"analyzer": F.lit(analyzer), "batch": F.lit(new_id())})
        each = kept.select("namespace", "analyzer", "batch", "ref", F.explode("counts").alias("x")).select("*", "x.lexeme", "x.tf")
        self.append("postings", each.withColumn("bucket", keyword_bucket()))
        self.append("lengths", kept.withColumn("dl", F.size("counts")))

    def health(self) -> dict[str, int]:
        """Rows of each table."""
        return {name: self.read(name).count() for name in TABLES}

    def bump_access(self, ids: DataFrame, ts: datetime) -> None:
        """Count one access of each id (column proposition_id), however often it is given."""
        self.append("access_events", ids.select("proposition_id").distinct().withColumn("ts", F.lit(ts)))

    def forget(self, proposition_id: str, replacement: str | None, ts: datetime) -> None:
        row = [(proposition_id, replacement, ts)]
        self.append("supersede_events", self.spark.createDataFrame(row, TABLES["supersede_events"]))

    def cached(self, keys: DataFrame) -> DataFrame:
        """keys (cache_key, ...) plus propositions, null where the cache has none."""
        return keys.join(self.read("proposition_cache").select("cache_key", "propositions"), "cache_key", "left")

    def count_cache_hits(self, keys: DataFrame, ts: datetime) -> None:
        self.append("cache_events", keys.select("cache_key").withColumn("ts", F.lit(ts)))

    def cache_with_hits(self) -> DataFrame:
        hits = self.read("cache_events").groupBy("cache_key").agg(F.count(F.lit(1)).cast("int").alias("hit_count"))
        return self.read("proposition_cache").join(hits, "cache_key", "left").fillna(0, ["hit_count"])

    def put_pagerank(self, namespace: str, ranks: DataFrame, ts: datetime) -> None:
        """Replace the scores of one namespace; other namespaces' files stay."""
        rows = ranks.withColumn("computed_at", F.lit(ts)).withColumn("namespace", F.lit(namespace))
        rows = rows.select(*TABLES["entity_pagerank"].names)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(self._path("entity_pagerank"))

    def compact(self) -> None:
        """Write propositions with all events folded in and empty the event logs, all at once."""
        empty = {name: self.spark.createDataFrame([], TABLES[name]) for name in ("access_events", "supersede_events")}
        self._swap({"propositions": self.propositions(), **empty})

    def delete_documents(self, ids: DataFrame) -> None:
        """Remove documents (column id) with their chunks, propositions, postings and edges, all at once.

        What goes is found by ids alone and named by file and row, so that texts, vectors and postings are not shuffled.
        """
        asked = ids.select(F.col("id").alias("document_id"))
        chunks = self._find("chunks", asked, "document_id", "id")
        rows = self._find("propositions", chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "id")
        lengths = self._find("lengths", rows.select(F.col("id").alias("prop_id")), "prop_id", "batch", "ref")
        edges = self._find("edges", rows.select(F.col("id").alias("proposition_id")), "proposition_id")
        gone = {"edges": edges, "lengths": lengths, "propositions": rows, "chunks": chunks}
        self._swap({
            "postings": unmarked(self.read("postings"), marks(lengths, "batch", "ref"), "batch", "ref"),
            **{name: unmarked(self._placed(name), marks(found, "_file", "_row"), "_file", "_row") for name, found in gone.items()},
            "documents": self.read("documents").join(ids.select("id"), "id", "left_anti"),
        })

    def _placed(self, name: str) -> DataFrame:
        """A table with the file and number of each row in it."""
        return self.read(name).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _find(self, name: str, keys: DataFrame, key: str, *columns: str) -> DataFrame:
        """columns, _file and _row of the rows of a table that have one of the keys."""
        return staged(self._placed(name).join(keys, key, "left_semi").select(*columns, "_file", "_row"), f"gone-{name}")

    def delete_entities(self, ids: DataFrame) -> None:
        """Remove entities (column id) with their edges and scores; propositions lose the end."""
        gone = ids.select("id").distinct()
        rows, edges = self.read("propositions"), self.read("edges")
        for end in ("subject_id", "object_id"):
            rows = rows.join(gone.select(F.col("id").alias(end), F.lit(True).alias("_gone")), end, "left").withColumn(end, F.when(F.col("_gone").isNull(), F.col(end))).drop("_gone")
        for end in ("src_entity", "dst_entity"):
            edges = edges.join(gone.select(F.col("id").alias(end)), end, "left_anti")
        scores = self.read("entity_pagerank").join(gone.select(F.col("id").alias("entity_id")), "entity_id", "left_anti")
        self._swap({"propositions": rows, "edges": edges, "entity_pagerank": scores, "entities": self.read("entities").join(gone, "id", "left_anti")})

    def wipe(self) -> None:
        """Empty all tables but the log of migrations."""
        self._swap({name: self.spark.createDataFrame([], schema) for name, schema in TABLES.items() if name != "migrations"})


def keyword_bucket() -> Column:
    return F.pmod(F.xxhash64("lexeme"), F.lit(KEYWORD_BUCKETS)).cast("int")


class StoredIndex:
    """Keyword index of a namespace from written postings: a query reads the buckets of its lexemes."""

    def __init__(self, store: Store, namespace: str, analyzer: str = "english"):
        self.store, self.namespace, self.analyzer = store, namespace, analyzer

    def _lengths(self) -> DataFrame:
        """Lengths of the active rows."""
        rows = self.store.read("lengths", self.namespace).filter(F.col("analyzer") == self.analyzer)
        return rows.join(self.store.superseded(), "prop_id", "left_anti")

    def hits(self, terms: DataFrame) -> DataFrame:
        asked = few(staged(terms.select("namespace", "lexeme", keyword_bucket().alias("bucket")).distinct(), "keyword-asked"))
        found = self.store.read("postings", self.namespace).filter(F.col("analyzer") == self.analyzer).join(asked, ["namespace", "bucket", "lexeme"])
        found = found.select("batch", "ref", "lexeme", "tf").join(self._lengths(), ["batch", "ref"])
        return staged(found.select("namespace", "prop_id", "session_id", "lexeme", "tf", "dl"), "keyword-hits")

    def statistics(self) -> DataFrame:
        return statistics(self._lengths())


def new_id() -> str:
    return str(uuid.uuid4())


def text_source(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): each file under path as one text."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def values(spark: SparkSession, rows: list[tuple], schema: str | T.StructType) -> DataFrame:
    """Inline relation."""
    return spark.createDataFrame(rows, schema)
