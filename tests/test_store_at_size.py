"""What keeps the store's writes in proportion: short references, deletes by place, and stores indexed before them."""

from pyspark.sql import functions as F

from tests.test_engine import ask, rows
from weftgraph.memory import Memory, MemoryConfig
from weftgraph.operators import keyword
from weftgraph.sources import store as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_marks_name_rows_exactly(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("k"), (F.col("id") + (F.col("id") % 3) * (1 << 33)).alias("at"))
    some = df.filter(F.xxhash64("k", "at") % 3 == 0)
    left = S.unmarked(df, S.marks(some, "k", "at"), "k", "at")
    assert left.exceptAll(df.exceptAll(some)).count() == 0 and left.count() == df.count() - some.count()
    assert S.unmarked(df, S.marks(some.limit(0), "k", "at"), "k", "at").count() == df.count()


def test_deletes_leave_wide_rows_where_they_are(spark, tmp_path):
    memory = Memory(S.Store(spark, f"file://{tmp_path}/kb"), MemoryConfig(extract_propositions=False))
    given = [(f"d{i}", f"cat number {i} " + "word " * 400, "s", "A" if i % 2 else None, None) for i in range(30)]
    memory.ingest_many(spark.createDataFrame(given, "id string, text string, source string, session_id string, asserted_at timestamp"))
    store, wrote = memory.store, []
    swap = store._swap
    store._swap = lambda tables: (wrote.extend((name, plan(df)) for name, df in tables.items()), swap(tables))
    store.delete_documents(spark.createDataFrame([(f"d{i}",) for i in range(0, 30, 3)], "id string"))
    assert len(wrote) == 6
    for name, text in wrote:
        assert name == "documents" or ("hashpartitioning" not in text and "SortMergeJoin" not in text), (name, text)
    left = {r.document_id for r in store.read("chunks").select("document_id").distinct().collect()}
    assert left == {f"d{i}" for i in range(30) if i % 3}
    refs = lambda name: {tuple(r) for r in store.read(name).select("batch", "ref").distinct().collect()}
    assert refs("postings") == refs("lengths") and store.read("lengths").count() == store.read("propositions").count() == store.read("chunks").count()
    assert {r.session_id for r in store.read("propositions").select("session_id").collect()} == {"A", None}
    assert memory.recall("3", k=5, bump=False) == [] or all("number 3 " not in r.text for r in memory.recall("3", k=5, bump=False))


def test_postings_are_written_without_a_shuffle(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/kb")
    store.migrate()
    wrote, append = {}, store.append
    store.append = lambda name, df, key=(): (wrote.update({name: plan(df)}), append(name, df, key))
    store.index_keywords(rows(spark, {"text": "cats sleep"}, {"text": ""}, {"text": None}))
    assert "Exchange" not in wrote["postings"] + wrote["lengths"] and "prop_id" not in store.read("postings").columns
    assert sorted((r.prop_id, r.dl) for r in store.read("lengths").collect()) == [("p0", 2), ("p1", 0), ("p2", 0)]


def test_an_older_index_is_renewed(spark, tmp_path):
    store = S.Store(spark, f"file://{tmp_path}/kb")
    store.migrate()
    table = rows(spark, {"text": "cats sleep and cats eat"}, {"text": "dogs run"}, {"text": "a cat and dogs"})
    store.append("propositions", table)
    old = keyword.postings(table, "english").withColumns({"analyzer": F.lit("english"), "bucket": S.keyword_bucket()})
    old.write.mode("append").partitionBy("namespace", "bucket").parquet(store._path("postings"))
    old.select("namespace", "analyzer", "prop_id", "dl").distinct().write.mode("append").partitionBy("namespace").parquet(store._path("lengths"))
    assert store.migrate() == [] and store.migrate() == []
    assert store.read("lengths").count() == 3 and store.read("postings").filter("ref IS NULL").count() == 0
    q = ask(spark, "cat dog")
    want = keyword.keyword_scores(q, keyword.RowIndex(table, "english"), analyzer="english")
    got = keyword.keyword_scores(q, S.StoredIndex(store, "ns"), analyzer="english")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3


def test_english_words_of_few_texts_are_objects_at_once(spark):
    import tracemalloc

    import pyarrow as pa

    from weftgraph.functions import text as T

    texts = pa.array([f"cats were running by {i} " + "dogs slept " * 200 for i in range(4000)] + [None, ""])
    tracemalloc.start()
    got = T._english(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got[7].as_py()[:3] == ["cat", "run", "7"] and len(got[7]) == 403 and got[4000].as_py() == got[4001].as_py() == []
    assert peak < 4e6, peak  # 4,000 lists of 403 references are 12.9 MB
    assert T._english(texts.slice(0, 0)).type == got.type
    keyword.row_words(rows(spark, {"text": "x"}), "english")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)
