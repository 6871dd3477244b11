"""The operators over a small table of awkward rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftgraph.llm import exact_dedup, mixing, near_dedup, packing, pii, quality, secrets, shared_windows, substring_dedup, suffix_dedup, token_store, tokens

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _rows():
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(vocabulary, n))
    long, passage = prose(3000), prose(80)
    base = [prose(int(n)) for n in rng.integers(60, 300, 60)]
    texts = [None, "", "  \n\t", "one", "two words", long, long + " end", passage, base[0] + " " + passage + " x", passage + " " + base[1]]
    texts += base + [t.replace(" ", "\n", 1) for t in base[:6]] + [t + " tail" for t in base[6:12]] + base[:3]
    texts += ["token = \"0123456789abcdef0123456789abcdef\" mail me@example.com or +1 (555) 123-4567 " + prose(60), "é ü ñ 日本 " * 30]
    rows = [(i, t, ["en", "de", None][i % 3], "hot" if i % 2 else f"s{i % 5}", None) for i, t in enumerate(texts)]
    rows += [rows[5], (None, base[2], "en", None, 1), (7_000_000_000, base[4], "en", "s1", 1), (-5, base[5] + "  ", "de", "s2", 1)]
    return rows


ROWS = _rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _text(t):
    return t or ""


def test_exact_dedup(docs, empty):
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", _text(t)), []).append((-len(_text(t)), i is None, i))
    for ranges in (1, 20, 256):  # no, some and all groups of two and more are salted
        got = exact_dedup.exact_dedup(docs, ranges=ranges).collect()
        assert len(got) == len(ROWS)
        for r in got:
            norm = re.sub(r"[\x20\x09-\x0D]", "", _text(r.text))
            g = groups[norm]
            assert (r.keep_id, r.group_size, r.text_sha256) == (min(g)[2], len(g), hashlib.sha256(norm.encode()).hexdigest())
        assert Counter(r.text_sha256 for r in got if r.kept) == Counter({r.text_sha256: 1 for r in got})
    assert exact_dedup.exact_dedup(empty).count() == 0
    clash = docs.withColumns({c: F.lit(c) for c in ("kept", "group_size", "hash", "salt", "row", "first", "norm", "id", "head")})
    got = exact_dedup.exact_dedup(clash).filter("kept")
    assert got.count() == len(groups) and got.filter("hash = 'hash' AND row = 'row' AND id = 'id' AND norm = 'norm'").count() == len(groups)


def test_mixing_cases(docs, empty):
    got = mixing.mix_sources(docs, block_docs=2).collect()
    assert len(got) == len(ROWS)
    slots = {}
    for r in got:
        slots.setdefault(r.slot, set()).add((r.source or "", r.block))
        assert not r.on_target or r.release <= r.slot < r.deadline
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    assert mixing.mix_sources(empty).count() == 0
    clash = mixing.mix_sources(docs.withColumns({c: F.lit("x") for c in ("slot", "weight", "n", "before")}))
    assert clash.filter("slot >= 0 AND weight = 'x' AND n = 'x' AND before = 'x'").count() == len(ROWS)


def test_token_store(spark, docs, empty):
    encoder = tokens.PieceEncoder(tokens.tokenizer_path("byte_bpe_50k.json"), "byte")
    got = {(r.doc_id, r.start): r for r in token_store.op3(docs).collect()}
    at = 0
    for i, t in sorted(((i, _text(t)) for i, t, *_ in ROWS), key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*encoder.library.encode(t, add_special_tokens=False).ids, 0], "<u4")
        r = got[(i, at)]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_store.op3(empty).count() == 0


def test_packing(docs, empty):
    for capacity in (64, 4096):
        got = packing.pack_documents(docs, capacity=capacity).collect()
        library = tokens.PieceEncoder(tokens.tokenizer_path("word_bpe_49k.json"), "word").library
        want = Counter()
        for i, t, *_ in ROWS:
            ids = np.array([*library.encode(_text(t), add_special_tokens=False).ids, 1], "<u4")
            for k, s in enumerate(range(0, len(ids), capacity)):
                want[(i, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes()))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
        places = {}
        for r in got:
            places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for p in places.values():
            at = 0
            for o, n in sorted(p):
                assert o == at
                at += n
            assert at <= capacity
    assert packing.pack_documents(empty).count() == 0


def test_quality_rules(docs, empty):
    got = quality.quality_rules(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    junk = docs.filter("doc_id = 20").withColumn("doc_id", F.lit(500).cast("long")).withColumn("text", F.regexp_replace("text", " ", "### "))
    judged = quality.quality_rules(docs.unionByName(junk)).filter("doc_id = 500").first()
    assert not judged.kept and not judged.base_failed
    assert quality.quality_rules(empty).count() == 0


def test_finders(docs, empty):
    for find in (pii.find_personal_data, secrets.scan_secrets):
        got = find(docs.withColumn("spans", F.lit(1))).collect()
        assert len(got) == len(ROWS)
        assert {r.doc_id for r in got if r.spans} == {r[0] for r in ROWS if "token =" in _text(r[1])}
        assert find(empty).count() == 0


def _brute_components(percent, k):
    sets = {}
    for i, t, *_ in ROWS:
        w = re.sub("[A-Z]", lambda m: m[0].lower(), _text(t)).encode().split()
        if i is not None:
            sets.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}, sets


def test_near_duplicates(docs, empty):
    want, sets = _brute_components(80, 2)
    got = near_dedup.near_duplicates(docs, shingle=2).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (want[r.doc_id], len(sets[r.doc_id]), r.doc_id == want[r.doc_id])
    assert near_dedup.near_duplicates(empty).count() == 0


def _covered(symbols, k=50):
    least = {}
    for i, w in symbols:
        if i is not None:
            for a in range(len(w) - k + 1):
                least[w[a : a + k]] = min(least.get(w[a : a + k], i), i)
    for i, w in symbols:
        gone = bytearray(len(w))
        for a in range(len(w) - k + 1):
            if i is not None and least[w[a : a + k]] < i:
                gone[a : a + k] = b"\1" * k
        yield i, w, gone


@pytest.mark.parametrize("hot", [5000, 1])
def test_substring_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(shared_windows, "HOT_RUNS", hot)
    monkeypatch.setattr(shared_windows, "CHUNK_BYTES", 8192)
    want = Counter()
    for i, w, gone in _covered([(i, tuple(_text(t).encode().split())) for i, t, *_ in ROWS]):
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    got = substring_dedup.remove_repeated_words(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert substring_dedup.remove_repeated_words(empty).count() == 0


@pytest.mark.parametrize("hot", [5000, 1])
def test_suffix_dedup(docs, empty, monkeypatch, hot):
    monkeypatch.setattr(shared_windows, "HOT_RUNS", hot)
    monkeypatch.setattr(shared_windows, "CHUNK_BYTES", 8192)
    want = Counter()
    for i, w, gone in _covered([(i, _text(t).encode()) for i, t, *_ in ROWS]):
        kept = bytes(x for x, g in zip(w, gone, strict=True) if not g)
        want[(i, len(w), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    got = suffix_dedup.remove_repeated_bytes(docs).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert suffix_dedup.remove_repeated_bytes(empty).count() == 0


def test_pipeline(spark, docs, empty, tmp_path):
    docs.write.parquet(f"{tmp_path}/full/documents.parquet")
    empty.write.parquet(f"{tmp_path}/none/documents.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    good = {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    kept = {r.doc_id for r in got}
    assert kept <= good and len(kept) > 40
    for _, stage in corpus_pipeline.STAGES[:-1]:
        clash = ("kept", "keep_id", "group_size", "text_sha256", "slot", "place", "block", "release", "deadline", "on_target", "grp", "row", "hash", "salt", "weight", "extra")
        more = stage(spark, docs.withColumns({c: F.lit(f"my {c}") for c in clash}), "")
        assert more.columns == [*docs.columns, *clash]
        assert more.select(*[F.min(c) for c in clash]).first() == more.select(*[F.max(c) for c in clash]).first() == tuple(f"my {c}" for c in clash)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
