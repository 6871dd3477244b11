"""Properties of the retrieval engine on small relations."""

import json
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text as T
from weftgraph.functions.stemmer import stem
from weftgraph.operators import graph, ingest, keyword
from weftgraph.operators.rerank import mmr
from weftgraph.plans.search import SearchParameters, search
from weftgraph.schema import PROPOSITIONS, QUERIES
from weftgraph.sources import datasets, store

NOW = datetime(2024, 3, 1, tzinfo=UTC)


def hot(i, dims=8):
    return [1.0 if j == i else 0.0 for j in range(dims)]


def rows(spark, *items):
    full = []
    for n, x in enumerate(items):
        base = dict.fromkeys(PROPOSITIONS.names) | {"id": f"p{n}", "namespace": "ns", "confidence": 1.0, "access_count": 0, "last_accessed_at": NOW}
        full.append(tuple((base | x)[c] for c in PROPOSITIONS.names))
    return spark.createDataFrame(full, PROPOSITIONS)


def ask(spark, text=None, embedding=None, session=None):
    return spark.createDataFrame([("q", text, embedding, "ns", session)], QUERIES)


def found(spark, table, text=None, embedding=None, session=None, edges=None, **options):
    p = SearchParameters(as_of=NOW, **options)
    return search(ask(spark, text, embedding, session), table, edges, p).orderBy("rank").collect()


def test_stemming():
    assert [stem(w) for w in ("cats", "zymurgy", "animals", "running")] == ["cat", "zymurgi", "anim", "run"]


def test_keyword_any_and_all(spark):
    table = rows(spark, {"text": "cats sleep"}, {"text": "dogs run"}, {"text": "cats and dogs"})
    assert {r.proposition_id for r in found(spark, table, "cat", analyzer="english")} == {"p0", "p2"}
    assert {r.proposition_id for r in found(spark, table, "cats dogs")} == {"p0", "p1", "p2"}
    assert {r.proposition_id for r in found(spark, table, "cats dogs", match_mode="all")} == {"p2"}
    assert {r.proposition_id for r in found(spark, table, "cats dogs", match_mode="cover")} == {"p2"}


def test_rare_terms_and_short_rows_rank_first(spark):
    table = rows(spark, *[{"text": f"animal number {i}"} for i in range(20)], {"text": "zymurgy animal"})
    best = lambda q: keyword.keyword_scores(ask(spark, q), keyword.RowIndex(table)).agg(F.max("bm25")).first()[0]
    assert best("zymurgy") > 1.5 * best("animal")
    table = rows(spark, {"text": "mitochondria " + " ".join(f"w{i}" for i in range(40))}, {"text": "mitochondria"})
    assert found(spark, table, "mitochondria")[0].proposition_id == "p1"


def test_fusion_sessions_and_supersession(spark):
    table = rows(
        spark, {"text": "elephant", "embedding": hot(0)}, {"text": "elephant"}, {"text": "zoo", "embedding": hot(0)},
        {"text": "elephant", "session_id": "A"}, {"text": "elephant", "session_id": "B"}, {"text": "elephant", "superseded_by": "p0"},
    )
    got = found(spark, store.active(table), "elephant", hot(0), session="A")
    assert got[0].proposition_id == "p0" and got[0].source_kind == "both"
    assert {r.proposition_id for r in got} == {"p0", "p1", "p2", "p3"}


def test_recency_prefers_event_time(spark):
    old = NOW - timedelta(days=60)
    table = rows(spark, {"text": "fact", "asserted_at": old}, {"text": "fact", "last_accessed_at": old, "asserted_at": NOW}, {"text": "fact", "last_accessed_at": datetime(2000, 1, 1, tzinfo=UTC)})
    got = found(spark, table, "fact", half_life_days=7.0)
    assert [r.proposition_id for r in got] == ["p1", "p0", "p2"] and got[-1].adjusted_score >= 0


def test_graph_expansion(spark):
    table = rows(spark, {"text": "alpha", "subject_id": "e1", "object_id": "e2"}, {"text": "beta", "subject_id": "e2", "object_id": "e3"}, {"text": "gamma"})
    edges = spark.createDataFrame([("e1", "e2", "p0"), ("e2", "e3", "p1"), ("e3", "e2", "p1")], "src_entity string, dst_entity string, proposition_id string")
    got = found(spark, table, "alpha", edges=edges, k_initial=1)
    assert [(r.proposition_id, r.source_kind) for r in got] == [("p0", "kw"), ("p1", "graph")]
    assert [r.proposition_id for r in found(spark, table, "alpha", edges=edges, expand_graph=False)] == ["p0"]


def test_pagerank_and_empty(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0)], "src_entity string, dst_entity string, weight double")
    score = {r.entity_id: r.score for r in graph.pagerank(nodes, edges).collect()}
    assert score["c"] > score["b"] > score["a"]
    assert graph.pagerank(nodes.limit(0), edges).count() == 0


def test_entity_linking(spark):
    known = spark.createDataFrame([("e1", "ns", "William Shakespeare", "concept", hot(0))], "id string, namespace string, name string, type string, embedding array<float>")
    asked = [("r1", "ns", "William Shakespeare", "concept", hot(0)), ("r2", "ns", "William Shakespear", "concept", hot(0)), ("r3", "ns", "William Shakespear", "concept", hot(1)), ("r4", "ns", "Other", None, None)]
    got = {r.request_id: r for r in graph.link_entities(spark.createDataFrame(asked, "request_id string, namespace string, name string, type string, embedding array<float>"), known, 0.5).collect()}
    assert [(got[r].entity_id == "e1", got[r].how) for r in ("r1", "r2", "r3", "r4")] == [(True, "exact"), (True, "fuzzy"), (False, "new"), (False, "new")]


def test_mmr():
    docs = np.array([[1, 0, 0], [0.98, 0.2, 0], [0.5, 0, 0.866]])
    assert mmr(np.array([1, 0, 0]), docs, 2, 0.3) == [0, 2]
    assert mmr(np.array([1, 0, 0]), docs[:0], 2) == [] and len(mmr(np.array([1, 0, 0]), docs, 9)) == 3


def test_chunks():
    assert ingest.chunk_text("") == [""] and ingest.chunk_text("a\n\nb") == ["a\n\nb"]
    parts = ingest.chunk_text("x" * 2500 + "\n\ny", 1200, 100)
    assert [len(p) for p in parts] == [1200, 1200, 303] and parts[-1].endswith("\n\ny")
    assert len(ingest.chunk_text("a" * 600 + "\n\n" + "b" * 599, 1200)[0]) == 1201
    assert ingest.parse_propositions('say ```json\n{"propositions": [{"subject": "a", "predicate": "b", "object": "c"}, {"x": 1}]}\n```') == [{"text": "a b c", "subject": "a", "predicate": "b", "object": "c", "object_is_literal": False}]
    assert ingest.parse_propositions("no json") == []


@pytest.mark.parametrize("a,b,same", [("Paris!", "paris", True), ("in Paris, France", "Paris", True), ("Rome", "Paris", False), ("", "x", True)])
def test_exact_match(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(T.exact_match(F.col("a"), F.col("b"))).first()[0] is same


def test_datasets(spark, tmp_path):
    one = [{"sessions": [[{"speaker": "A", "text": "hi"}, {"speaker": "B", "text": " "}], [{"role": "A", "content": "bye", "date": "2024-01-01T00:00:00Z"}]], "qa": [{"question": "q?", "answer": "a", "category": "c"}, {"q": "r?"}]}]
    (tmp_path / "d.json").write_text(json.dumps(one))
    turns, questions = datasets.load_dialogues(spark, str(tmp_path / "d.json"))
    assert [(r.session_id, r.speaker, r.text) for r in turns.orderBy("ordinal").collect()] == [("sess-0", "A", "hi"), ("sess-1", "A", "bye")]
    assert [(r.question, r.answer, r.category) for r in questions.orderBy("question_id").collect()] == [("q?", "a", "c"), ("r?", "", "general")]
    two = [{"question_id": "x1", "question": "q?", "answer": "a", "question_type": "t", "haystack_sessions": [[{"role": "u", "content": "hi"}], [{"role": "u", "content": "yo"}]], "haystack_session_ids": ["s9"], "haystack_dates": ["2024-01-01T00:00:00Z"]}]
    (tmp_path / "h.json").write_text(json.dumps(two))
    turns, questions = datasets.load_haystacks(spark, str(tmp_path / "h.json"))
    assert [(r.session_id, r.asserted_at is not None) for r in turns.orderBy("ordinal").collect()] == [("s9", True), ("sess-1", False)]
    assert questions.first().category == "t"


def test_memory_round_trip(spark, tmp_path):
    from weftgraph.memory import Memory, MemoryConfig
    from weftgraph.sources.store import Store

    memory = Memory(Store(spark, f"file://{tmp_path}/kb"), MemoryConfig(namespace="n1", extract_propositions=False))
    got = memory.ingest("rivers flow to the sea", source="t", session_id="A")
    assert (got.documents, got.chunks, got.propositions, got.entities) == (1, 1, 1, 0)
    memory.ingest("mountains are high", source="t", session_id="B")
    found_rows = memory.recall("rivers", session_id="A", k=5)
    assert [r.text for r in found_rows] == ["rivers flow to the sea"]
    assert memory.store.propositions("n1").agg(F.sum("access_count")).first()[0] == 1
    memory.forget(found_rows[0].proposition_id)
    assert memory.recall("rivers", session_id="A", k=5) == []
    offline = Memory(Store(spark, f"file://{tmp_path}/kb"), MemoryConfig(namespace="n2"))
    assert offline.ingest("one fact").entities == 1
    offline.recompute_pagerank(iterations=2)
    assert offline.store.read("entity_pagerank", "n2").count() == 1


def test_names_meet_on_rare_trigrams(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(3, 7)))
    names = [f"company {word()}" for _ in range(150)]
    kind = "id string, namespace string, name string, type string, embedding array<float>"
    known = spark.createDataFrame([(f"e{i:03}", "ns", n, None, hot(0)) for i, n in enumerate(names)], kind)
    asked = [(f"r{i:02}", "ns", n[:-1] + rng.choice("abx"), None, hot(0)) for i, n in enumerate(names[:40])]
    got = {r.request_id: r for r in graph.link_entities(spark.createDataFrame(asked, kind.replace("id ", "request_id ", 1)), known, 0.5).collect()}

    def grams(name):
        return {f"  {w} "[i : i + 3] for w in name.split() for i in range(len(w) + 1)}

    for rid, _, name, *_ in asked:
        exact = [f"e{i:03}" for i, n in enumerate(names) if n == name]
        close = [f"e{i:03}" for i, n in enumerate(names) if len(grams(n) & grams(name)) > 0.6 * len(grams(n) | grams(name))]
        want = (min(exact), "exact") if exact else (min(close), "fuzzy") if close else (None, "new")
        assert (got[rid].entity_id if want[0] else None, got[rid].how) == want


def test_english_ranking_by_brute_force(spark):
    import math
    import random
    from collections import Counter

    rng = random.Random(2)
    stems = ["run", "walk", "jump", "look", "play", "turn"]
    text = lambda n: " ".join(rng.choice(stems) + rng.choice(["", "s", "ed", "ing"]) for _ in range(n)) + " the of"
    texts = [text(rng.randint(1, 30)) for _ in range(60)]
    asked = ["running jumps", "the played look", "turning", "nothing"]
    queries = spark.createDataFrame([(f"q{i}", t, None, "ns", None) for i, t in enumerate(asked)], QUERIES)
    table = rows(spark, *[{"text": t} for t in texts])
    got = {(r.query_id, r.prop_id): r.bm25 for r in keyword.keyword_scores(queries, keyword.RowIndex(table, "english"), analyzer="english").collect()}
    docs = [Counter(T.english_lexemes(t)) for t in texts]
    average = sum(len(d) for d in docs) / len(docs)
    want = {}
    for i, q in enumerate(asked):
        for n, d in enumerate(docs):
            score = 0.0
            for w in T.english_lexemes(q):
                df = sum(w in x for x in docs)
                score += math.log((len(docs) - df + 0.5) / (df + 0.5) + 1) * d[w] * 2.2 / (d[w] + 1.2 * (0.25 + 0.75 * len(d) / average))
            if score > 0:
                want[(f"q{i}", f"p{n}")] = score
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
