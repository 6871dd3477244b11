"""Very long texts and clashing column names in every operator; the robust estimate and the shared windows by brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_queries import ROWS, SCHEMA
from weftgraph.llm import exact_dedup, mixing, near_dedup, packing, pii, quality, secrets, shared_windows, substring_dedup, suffix_dedup, token_store, tokens

_RNG = np.random.default_rng(3)
LONG = " ".join("".join(_RNG.choice(list("abcdefghijklmnop"), 6)) for _ in range(60_000))
TEXTS = [LONG, LONG + " tail me@example.com AKIA" + "B" * 20, "short " * 60, LONG]


@pytest.fixture(scope="module")
def long_docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(TEXTS)], SCHEMA).repartition(2)


def _by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_long_texts_are_read_whole(long_docs):
    got = _by_id(pii.find_personal_data(long_docs))
    assert got[1].spans == f"email:{len(LONG) + 6}:{len(LONG) + 20}" and got[0].spans == ""
    assert _by_id(secrets.scan_secrets(long_docs))[1].spans == f"access:{len(LONG) + 21}:{len(LONG) + 45}"
    assert [(r.keep_id, r.group_size) for _, r in sorted(_by_id(exact_dedup.exact_dedup(long_docs)).items())] == [(0, 2), (1, 1), (2, 1), (0, 2)]
    assert [r.component_id for _, r in sorted(_by_id(near_dedup.near_duplicates(long_docs)).items())] == [0, 0, 2, 0]
    assert _by_id(quality.quality_rules(long_docs))[1].n_words == 60_003
    words = _by_id(substring_dedup.remove_repeated_words(long_docs))
    assert [(words[i].n_words, words[i].n_removed) for i in range(4)] == [(60_000, 0), (60_003, 60_000), (60, 0), (60_000, 60_000)]
    raw = _by_id(suffix_dedup.remove_repeated_bytes(long_docs))
    assert [(raw[i].n_bytes, raw[i].n_removed, raw[i].n_spans) for i in (0, 1, 3)] == [(len(LONG), 0, 0), (len(TEXTS[1]), len(LONG), 1), (len(LONG), len(LONG), 1)]
    assert raw[1].kept_sha256 == hashlib.sha256(TEXTS[1][len(LONG) :].encode()).hexdigest()


def test_long_texts_are_tokenised_whole(long_docs):
    ids = {name: tokens.PieceEncoder(tokens.tokenizer_path(name), name.split("_")[0]).library.encode(LONG, add_special_tokens=False).ids for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    stored = np.array([*ids["byte_bpe_50k.json"], 0], "<u4")
    assert (_by_id(token_store.op3(long_docs))[0].n_tokens, _by_id(token_store.op3(long_docs))[0].ids_crc32) == (len(stored), zlib.crc32(stored.tobytes()))
    for packed in (packing.pack_documents(long_docs), packing.pack_mixed(long_docs)):
        pieces = sorted((r.piece, r.start, r.length) for r in packed.filter("doc_id = 0").collect())
        n = len(ids["word_bpe_49k.json"]) + 1
        assert pieces == [(k, 4096 * k, min(4096, n - 4096 * k)) for k in range(-(-n // 4096))]


@pytest.mark.parametrize(
    "run",
    [pii.find_personal_data, exact_dedup.exact_dedup, token_store.op3, packing.pack_documents, packing.pack_mixed, quality.quality_rules, mixing.mix_sources, secrets.scan_secrets, near_dedup.near_duplicates, substring_dedup.remove_repeated_words, suffix_dedup.remove_repeated_bytes],
    ids=lambda f: f.__name__,
)
def test_names_of_other_columns_do_not_matter(spark, run):
    docs = spark.createDataFrame(ROWS[:40], SCHEMA).repartition(2)
    names = ("rep", "key", "chunk", "payload", "bucket", "n_words", "kept", "slot", "piece", "length", "start", "digest", "sketch", "grp", "spans", "n_tokens", "row", "_row", "_src", "seg", "part", "component_id", "sequence_id", "weight")
    clash = docs.withColumns({c: F.lit("x") for c in names})
    shared = [c for c in run(docs).columns if c not in ("keep_id",)]
    rows = lambda df: sorted(map(repr, df.select(*shared).collect()))
    assert rows(run(clash)) == rows(run(docs))


def _verdicts(stats):
    """kept by exact concentration steps, without bins, from the same starts. stats: rows of text_statistics."""
    p, floor = 4, np.diag(quality.FLOOR)
    x, failed = [], []
    for r in stats:
        failed.append(r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        n, chars = max(1, r.n_words), max(1, r.word_chars)
        x.append((np.log(chars / n), (r.n_symbols / chars) ** 0.5, (r.n_dup_lines / n) ** 0.5, (r.n_repeat_words / n) ** 0.5))
    x, failed = np.array(x), np.array(failed)
    members = defaultdict(list)
    for i, r in enumerate(stats):
        if not failed[i]:
            for g in ((r.lang, r.source), (r.lang,), ()):
                members[g].append(i)
    up = lambda g: [h for h in ((), g[:1]) if h != g and len(h) < len(g)] + [g]

    def mixed(own, g):
        n, value = own[up(g)[0]]
        for h in up(g)[1:]:
            value = (own[h][0] * own[h][1] + quality.PRIOR_ROWS * value) / (own[h][0] + quality.PRIOR_ROWS)
        return value

    best = {}
    for start in range(3):
        center, cov = {}, {}
        for g, rows in members.items():
            q = np.percentile(np.round(x[rows], 3), [25, 50, 75], axis=0)
            spread = np.diag(((q[2] - q[0]) / 1.349) ** 2)
            center[g] = (len(rows), q[1] if start < 2 else x[rows].mean(axis=0))
            cov[g] = (len(rows), (np.diag(quality.START), spread, np.cov(x[rows].T, bias=True).reshape(p, p))[start])
        model = {g: (mixed(center, g), mixed(cov, g) + floor) for g in members}
        for _ in range(quality.MAX_STEPS):
            center, cov, scale = {}, {}, {}
            for g, rows in members.items():
                d = x[rows] - model[g][0]
                dist = np.einsum("ij,jk,ik->i", d, np.linalg.inv(model[g][1]), d)
                near = np.array(rows)[np.argsort(dist, kind="stable")[: int(np.ceil(len(rows) * quality.H_SHARE))]]
                center[g], cov[g] = (len(near), x[near].mean(axis=0)), (len(near), np.cov(x[near].T, bias=True).reshape(p, p))
                scale[g] = max(1.0, np.sort(dist)[(len(dist) - 1) // 2] / quality.NORMAL_MEDIAN)
            model = {g: (mixed(center, g), mixed(cov, g) + floor) for g in members}
        for g in members:
            det = np.linalg.slogdet(model[g][1])[1]
            if g not in best or det < best[g][0]:
                best[g] = (det, *model[g], scale[g])
    out = {}
    for i, r in enumerate(stats):
        if failed[i]:
            out[r.doc_id] = (False, None)
        else:
            _, center, cov, scale = best[(r.lang, r.source)]
            d = x[i] - center
            distance = d @ np.linalg.inv(cov) @ d / scale
            out[r.doc_id] = (distance <= quality.CUTOFF, distance)
    return out


def test_quality_verdicts_against_exact_steps(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(600):
        source = ("web", "books", "code")[i % 3]
        word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9 if source == "books" else 6)))
        text = " ".join(word() + ("#" if source == "code" and rng.random() < 0.4 else "") for _ in range(int(rng.integers(55, 120))))
        if i % 40 == 0:
            text = text.replace(" ", " ### ")
        if i % 40 == 20:
            text = "\n".join([text[:60]] * 3 + [text])
        rows.append((i, text, ("en", "de")[i % 2], source, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    want = _verdicts(quality.text_statistics(docs).collect())
    got = _by_id(quality.quality_rules(docs))
    clear = [i for i, (_, d) in want.items() if d is None or not 0.6 < d / quality.CUTOFF < 1.6]
    assert len(clear) > 580 and sum(not want[i][0] for i in clear) >= 10
    assert [i for i in clear if got[i].kept != want[i][0]] == []


def test_removals_are_decided_by_contents(spark, monkeypatch):
    """Digests that lie are found out: with all digests alike nothing is removed, the task ends with an error."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    table = docs.select("doc_id", "text").toArrow()
    chunk = shared_windows.Chunk(table, False, suffix_dedup.GRAM_BYTES)
    r = chunk.runs()
    order = np.argsort(r.digest, kind="stable")
    chunk.confirm(r.start[order], r.windows[order] + shared_windows.WINDOW - 1, r.digest[order])
    with pytest.raises(ArithmeticError):
        chunk.confirm(r.start[order], np.full(len(order), 60), np.zeros(len(order), np.uint64))
