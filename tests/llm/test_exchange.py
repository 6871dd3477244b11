"""Steps A to E of the shared windows without Spark: how work is dealt to buckets and answers come back."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tests.llm.test_queries import _covered
from weftgraph.llm import shared_windows, suffix_dedup


def _exchanged(x, chunks):
    """Steps A to E in this process: results of each chunk, and the rows that went to buckets in steps A and C."""
    def step(f, tables, schema, by):
        met = defaultdict(list)
        for name, *more in tables:
            for row in f((pa.scalar(name),), *more).to_pylist():
                met[row[by]].append(row)
        return {k: pa.Table.from_pylist(rows, schema) for k, rows in met.items()}

    to_bucket, to_chunk = shared_windows._ROW_SCHEMA, shared_windows._BACK_SCHEMA
    none = to_chunk.empty_table()
    sent = step(x.a, enumerate(chunks), to_bucket, "bucket")
    told = step(x.b, sent.items(), to_chunk, "chunk")
    asked = step(x.c, ((i, t, told.get(i, none)) for i, t in enumerate(chunks)), to_bucket, "bucket")
    answered = step(x.d, asked.items(), to_chunk, "chunk")
    return [lambda i=i, t=t: x.e((pa.scalar(i),), t, answered.get(i, none)) for i, t in enumerate(chunks)], sent, asked


def _chunks(pieces, shared):
    """Two tables of texts that have little but `shared` in common."""
    rng = np.random.default_rng(5)
    text = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))
    rows = [(i, (text() + shared[i % len(shared)] + text()) if shared else text()) for i in range(2 * pieces)]
    return [pa.table({"doc_id": [i for i, _ in r], "text": [t for _, t in r]}) for r in (rows[:pieces], rows[pieces:])], rows


def test_buckets_are_even():
    """The smallest of many hashes is near zero: taken as it is, it would deal a tenth of all runs to one bucket."""
    x = shared_windows.Exchange(False, suffix_dedup.GRAM_BYTES, 8, suffix_dedup.match_windows, suffix_dedup._finish, suffix_dedup._OUT, shared_windows.HOT_RUNS)
    _, sent, _ = _exchanged(x, _chunks(30, None)[0])
    size = [sum(len(p) for p in t["payload"].to_pylist()) for t in sent.values()]
    assert len(size) == 256 and max(size) < 2 * sum(size) / 256


def test_answers_are_searched_once(monkeypatch):
    """Hot windows are looked up in all buckets' answers at once; per bucket, the work grew with buckets times windows."""
    hot = "".join(chr(65 + (i * i * 7 + i) % 23) for i in range(900))
    chunks, rows = _chunks(6, [hot[i * 40 : i * 40 + 500] for i in range(8)])
    x = shared_windows.Exchange(False, suffix_dedup.GRAM_BYTES, 10, suffix_dedup.match_windows, suffix_dedup._finish, suffix_dedup._OUT, 1)
    last, _, asked = _exchanged(x, chunks)
    assert len(asked) > 100
    calls, find = [], shared_windows.Exchange._find
    monkeypatch.setattr(shared_windows.Exchange, "_find", staticmethod(lambda *a: calls.append(1) or find(*a)))
    got = {r["doc_id"]: r for f in last for r in f().to_pylist()}
    assert len(calls) <= 2 * len(chunks)
    for i, raw, gone in _covered([(i, t.encode()) for i, t in rows]):
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        assert (got[i]["n_removed"], got[i]["kept_sha256"]) == (sum(gone), hashlib.sha256(kept).hexdigest())
    assert sum(r["n_removed"] for r in got.values()) > 2000
