"""Store, index, datasets, server, runs and streaming of the retrieval engine."""

import json
import threading
import urllib.error
import urllib.request
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from tests.test_engine import NOW, ask, rows
from weftgraph import benchmark, providers, server
from weftgraph.functions import text as T
from weftgraph.memory import Memory, MemoryConfig
from weftgraph.operators import keyword
from weftgraph.schema import TABLES
from weftgraph.sources import datasets
from weftgraph.sources.store import Store, StoredIndex
from weftgraph.streaming import ingest as streaming


def _plain_density(words, terms):
    total, last = 0.0, -1
    at = [(i, w) for i, w in enumerate(words) if w in terms]
    for end in range(len(at)):
        begins = [max((k for k in range(end + 1) if at[k][1] == t), default=-1) for t in terms]
        if min(begins) > last:
            last = min(begins)
            total += 0.1 / (1 + at[end][0] - at[last][0] - (end - last))
    return total


def test_cover_density(spark):
    import random

    rng = random.Random(4)
    cases = [([rng.choice("abcdxy") for _ in range(rng.randint(0, 14))], sorted(set(rng.choices("abcd", k=rng.randint(1, 3))))) for _ in range(300)]
    df = spark.createDataFrame([(i, w, t) for i, (w, t) in enumerate(cases)], "i int, w array<string>, t array<string>")
    got = {r.i: r.d for r in df.select("i", keyword.cover_density(F.col("w"), F.col("t")).alias("d")).collect()}
    assert all(abs(got[i] - _plain_density(w, t)) < 1e-12 for i, (w, t) in enumerate(cases))


def test_words_of_any_script_and_counts(spark):
    df = spark.createDataFrame([("für Größe, für 東京 x1 _a_",), ("",), (None,)], "t string").coalesce(1)
    got = [sorted((x.lexeme, x.tf) for x in r[0] or []) for r in df.select(T.counted(T.lexemes(F.col("t")))).collect()]
    assert got == [[("a", 1), ("für", 2), ("größe", 1), ("x1", 1), ("東京", 1)], [], []]
    assert T.english_lexemes("Für die Katzen") == [T.stem("für"), T.stem("die"), T.stem("katzen")]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_times_without_a_zone_are_utc(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        given = ["2024-01-01T00:00:00", "2024-01-01T00:00:00Z", "2024-01-01 02:00:00+02:00", "2024-01-01", "soon"]
        df = spark.createDataFrame([(x,) for x in given], "t string").coalesce(1)
        assert [r[0] for r in df.select(F.unix_seconds(T.iso_timestamp(F.col("t")))).collect()] == [1704067200] * 4 + [None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stored_index_ranks_as_texts_do(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb")
    assert store.migrate() == ["001_tables", "002_keyword_index"] and store.migrate() == []
    table = rows(spark, {"text": "cats sleep and cats eat"}, {"text": "dogs run"}, {"text": "a cat and dogs"}, {"text": "cats", "superseded_by": "p0"}, {"text": "cat", "session_id": "A"})
    store.append("propositions", table)
    store.index_keywords(table)
    store.forget("p4", None, NOW)
    q = ask(spark, "cat dog")
    active = store.active("ns")
    want = keyword.keyword_scores(q, keyword.RowIndex(active, "english"), analyzer="english")
    got = keyword.keyword_scores(q, StoredIndex(store, "ns"), analyzer="english")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    plan = StoredIndex(store, "ns").store.read("postings", "ns").filter("bucket = 3")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(namespace" in plan


def test_compaction_and_deletes(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb")
    memory = Memory(store, MemoryConfig(namespace="n1"))
    memory.ingest("one fact")
    memory.ingest("another fact")
    memory.recompute_pagerank(iterations=2)
    found = memory.recall("fact", k=5)
    assert len(found) == 2
    store.compact()
    assert store.read("access_events").count() == 0
    assert store.read("propositions").agg(F.sum("access_count")).first()[0] == 2
    entity = store.read("entities").limit(1).select("id")
    store.delete_entities(entity)
    assert store.read("entities").count() == 0 and store.read("entity_pagerank").count() == 0 and store.read("propositions").filter("subject_id IS NOT NULL").count() == 0
    one = store.read("documents").orderBy("id").limit(1).select("id")
    store.delete_documents(spark.createDataFrame(one.collect(), "id string"))
    assert {name: n for name, n in store.health().items() if name in ("documents", "chunks", "propositions", "lengths")} == dict.fromkeys(("documents", "chunks", "propositions", "lengths"), 1)
    store.wipe()
    assert all(n == 0 for name, n in store.health().items() if name != "migrations")


def test_interrupted_swap_is_finished(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/kb")
    store.migrate()
    finish, store._finish_swap = store._finish_swap, lambda: None
    store._swap({"edges": spark.createDataFrame([("a", "b", "r", 1.0, "p")], TABLES["edges"])})
    assert store.read("edges").count() == 0
    store._finish_swap = finish
    store.migrate()
    assert store.read("edges").count() == 1


DIALOGUES = {
    "data": {
        "first": {"conversation": {"session_2": [{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": "  "}], "session_2_date": "x", "session_1": {"turns": [{"role": "B", "content": "yo", "date": "2024-01-01T00:00:00"}]}}, "qas": [{"q": "q?", "a": 7, "type": 2}]},
        "second": {"conversation": [{"speaker": "C", "text": "no sessions"}], "questions": [{"question": "r?"}, "odd", {"answer": "x"}]},
    }
}


def test_dialogues_as_objects(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps(DIALOGUES))
    turns, questions = datasets.load_dialogues(spark, str(tmp_path / "d.json"))
    got = sorted((r.namespace, r.ordinal, r.session_id, r.speaker, r.text, r.asserted_at is not None) for r in turns.collect())
    assert got == [("locomo-0", 0, "sess-0", "A", "hi", False), ("locomo-0", 2, "sess-2", "B", "yo", True), ("locomo-1", 0, "sess-0", "C", "no sessions", False)]
    asked = sorted((r.question_id, r.question, r.answer, r.category) for r in questions.collect())
    assert asked == [("locomo-0-qa-0", "q?", "7", "2"), ("locomo-1-qa-0", "r?", "", "general")]
    assert datasets.load_dialogues(spark, str(tmp_path / "d.json"), limit=1)[1].count() == 1
    one = {"id": "x", "question": "q?", "haystack_sessions": {"a": {"messages": [{"role": "u", "content": "hi"}]}}, "session_timestamp": "2024-01-01"}
    (tmp_path / "h.json").write_text(json.dumps({"rows": [one, {"id": "y"}]}))
    turns, questions = datasets.load_haystacks(spark, str(tmp_path / "h.json"))
    assert [(r.namespace, r.session_id, r.asserted_at.year) for r in turns.collect()] == [("lme-x", "sess-0", 2024)] and questions.first().question_id == "x-q0"


def test_grades_and_prompts():
    assert providers.parse_grade('Well {x} {"correct": true, "reasoning": "same"} ok') == (True, "same")
    assert providers.parse_grade("no")[0] is False
    prompt = providers.answer_prompt("who?", ["a b", "c"])
    assert "- a b\n- c" in prompt and "who?" in prompt
    assert providers.extractor(lambda system, text: '{"propositions": [{"subject": "a", "predicate": "b", "object": "c"}]}')(["t"])[0][0]["text"] == "a b c"


def test_bench_run(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"sessions": [[{"speaker": "A", "text": "the capital of France is Paris"}], [{"speaker": "B", "text": "cats sleep a lot"}]], "qa": [{"question": "capital of France", "answer": "Paris", "category": "geo"}, {"question": "zebra", "answer": "none", "category": "no"}]}]))
    turns, questions = datasets.load_dialogues(spark, str(tmp_path / "d.json"))
    memory = Memory(Store(spark, f"file://{tmp_path}/kb"), MemoryConfig(extract_propositions=False))
    config = benchmark.BenchConfig("mini", k=1, dry_run=False, with_mmr=False)
    chat = lambda system, prompt: '{"correct": true}' if "Right answer: Paris" in prompt else "Paris" if "capital of France is Paris" in prompt else "no"
    report = benchmark.run_bench(memory, turns, questions, config, f"file://{tmp_path}/out", answerer=chat, judge=chat)
    assert (report["total"], report["correct"], report["per_category"]["geo"]["acc"], report["n_propositions_ingested"]) == (2, 1, 1.0, 2)
    assert report["mean_recall_latency_ms"] > 0 and spark.read.json(f"file://{tmp_path}/out/mini.jsonl").count() == 2
    assert json.loads(spark.read.text(f"file://{tmp_path}/out/mini-report").first()[0])["total"] == 2
    with pytest.raises(ValueError):
        benchmark.run_bench(memory, turns, questions, config, "x")


def _call(port, path, body=None):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", None if body is None else json.dumps(body).encode())
    try:
        with urllib.request.urlopen(request) as answer:
            return answer.status, json.loads(answer.read() or b"null")
    except urllib.error.HTTPError as problem:
        return problem.code, json.loads(problem.read())


def test_server(spark, tmp_path):
    memory = Memory(Store(spark, f"file://{tmp_path}/kb"), MemoryConfig(extract_propositions=False))
    http = server.make_server(memory, port=0)
    port = http.server_address[1]
    threading.Thread(target=http.serve_forever, daemon=True).start()
    try:
        assert _call(port, "/memorize", {"text": "rivers flow", "session_id": "A", "asserted_at": "2024-01-01T00:00:00+00:00"})[1]["propositions"] == 1
        code, found = _call(port, "/recall", {"query": "rivers", "k": 3})
        assert code == 200 and [r["text"] for r in found] == ["rivers flow"] and found[0]["subject"] is None
        assert _call(port, "/forget", {"proposition_id": found[0]["proposition_id"]}) == (204, None)
        assert _call(port, "/recall", {"query": "rivers"}) == (200, [])
        assert _call(port, "/recall", {"k": 3})[0] == 422 and _call(port, "/else", {})[0] == 404
        assert _call(port, "/health")[1]["tables"]["documents"] == 1
    finally:
        http.shutdown()


def test_streaming_ingest(spark, tmp_path):
    schema = "id string, text string, source string, session_id string, asserted_at timestamp"
    at = datetime(2024, 1, 1, tzinfo=UTC)
    spark.createDataFrame([("d1", "rivers flow", "s", None, at), ("d1", "rivers flow", "s", None, at), ("d2", "  ", "s", None, at)], schema).write.parquet(f"{tmp_path}/in/a")
    memory = Memory(Store(spark, f"file://{tmp_path}/kb"), MemoryConfig(extract_propositions=False))
    for _ in range(2):  # the second run finds nothing new
        turns = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
        streaming.start(turns, memory, f"{tmp_path}/check").awaitTermination()
    assert memory.store.read("documents").count() == 1 and [r.text for r in memory.recall("rivers")] == ["rivers flow"]


def test_cell_index_recall(spark, tmp_path):
    import numpy as np

    from weftgraph.functions.vector import CellIndex, nearest

    rng = np.random.default_rng(5)
    centers = rng.normal(size=(40, 16))
    points = (centers[rng.integers(0, 40, 3000)] + 0.4 * rng.normal(size=(3000, 16))).tolist()
    table = spark.createDataFrame([(f"p{i}", "ns", "A" if i % 3 == 0 else None, p) for i, p in enumerate(points)] + [("none", "ns", None, None)], "id string, namespace string, session_id string, embedding array<float>")
    q = spark.createDataFrame([(f"q{i}", None, points[i * 50], "ns", "B" if i % 2 else None) for i in range(20)], "query_id string, q_text string, q_embedding array<float>, namespace string, session_id string")
    exact = {(r.query_id, r.prop_id) for r in nearest(table, q, 10).collect()}
    index = CellIndex.build(table, f"file://{tmp_path}/cells", cells=32)
    assert index.rows.count() == 3000
    found = {(r.query_id, r.prop_id) for r in index.nearest(q, 10, probes=8).collect()}
    assert len(found & exact) >= 0.9 * len(exact)
    every = index.nearest(q, 10, probes=32)
    assert {(r.query_id, r.prop_id) for r in every.collect()} == exact
