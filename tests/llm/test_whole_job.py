"""Results that a shortened job would not give."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np

import corpus_pipeline
from tests.llm.test_queries import ROWS
from weftgraph.llm import mixing, packing, quality, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _mixed_docs(spark):
    rows = [(i, " ".join(f"w{(i * 7919 + j * j) % 997}" for j in range(60 + i * 13 % 90)), "en", f"s{i % 3}", None) for i in range(240)]
    rows += [(None, rows[0][1] + " x", "en", "s1", None), (2**60 + 1, rows[1][1] + " x", "en", "s1", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_sequences_follow_the_mix(spark):
    docs, weights = _mixed_docs(spark), {"s0": 6.0, "s1": 2.0, "s2": 1.0}
    order = {r.doc_id: (r.slot, r.place) for r in mixing.mix_sources(docs, weights).collect()}
    got = packing.pack_mixed(docs, weights, capacity=512, run_pieces=40, chunk_slots=1).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(
        (r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.pack_documents(docs, capacity=512).collect()
    )
    places, held = defaultdict(list), defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
        held[r.sequence_id].append(order[r.doc_id])
    assert sorted(places) == list(range(len(places)))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 512
    # No piece is further from its place in the mix than a run and a chunk of pieces.
    rank = {k: i for i, k in enumerate(sorted((order[r.doc_id], r.piece) for r in got))}
    packed = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert max(abs(rank[(order[r.doc_id], r.piece)] - i) for i, r in enumerate(packed)) <= 40 + 3 * mixing.BLOCK_DOCS


def test_weights_change_the_pipeline(spark, tmp_path, monkeypatch):
    _mixed_docs(spark).write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    for weights in (None, {"s0": 6.0, "s1": 2.0, "s2": 1.0}):
        monkeypatch.setattr(corpus_pipeline, "WEIGHTS", weights, raising=False)
        got.append({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})
    assert {x[:2] for x in got[0]} == {x[:2] for x in got[1]} and len(got[0]) > 100
    assert got[0] != got[1]


def test_small_source_is_judged_by_its_own_style(spark):
    style = lambda i, end: " ".join(f"w{(i * 7919 + j * j) % 9973}x{j}{end if j % 3 == 0 else ''}" for j in range(80 + i % 40))
    rows = [(i, style(i, ""), "en", "prose", None) for i in range(300)]
    rows += [(1000 + i, style(i, "###"), "en", "code", None) for i in range(30)]
    rows += [(2000, style(1, "#" * 20), "en", "code", None), (2001, style(1, "###"), "en", "prose", None)]
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert [i for i in sorted(got) if not got[i].kept] == [2000, 2001]


def _stays(texts):
    """Ids (None too) that exact groups and components of five-word sets at 0.8 keep. texts: (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in texts:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), i is None, i, t))
    left = [min(g)[2:] for g in groups.values()]
    sets = defaultdict(set)
    for i, t in left:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode().split()
        sets[i] |= {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets if i is not None}
    for a in sorted(root):
        for b in sorted(root):
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return [(i, t) for i, t in left if i is None or root[i] == i]


def test_pipeline_against_brute_force(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    numbered = spark.createDataFrame([(k, *r[1:]) for k, r in enumerate(ROWS)], SCHEMA)
    good = [ROWS[r.doc_id][:2] for r in quality.quality_rules(numbered).collect() if r.kept]
    library = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"), "word").library
    want = Counter()
    for i, t in _stays(good):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            part = ids[s : s + 4096]
            want[(i, k, s, len(part), zlib.crc32(part.tobytes()))] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 40 < len(want) < len(good)
