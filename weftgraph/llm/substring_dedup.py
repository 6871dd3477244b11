"""Substring dedup over words by super-k-mer partitioning (see shared_windows).

Runs of windows with one minimiser travel to its bucket as one string of words joined by single spaces; there the
windows of all strings are cut out and sorted, so that equal word sequences stand next to each other and are compared
as they are.

Cases: null, empty or white-space text has no words; fewer than 50 words are never removed; a row with a null id removes
nothing and loses nothing; rows of one id do not remove each other; other columns are ignored; an empty table gives no
rows; a text of any length is read whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.shared_windows import WINDOW, Chunk, covered_by_smaller

GRAM_WORDS = 8
_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def sort_windows(contents: list[bytes], least: np.ndarray, minimisers: np.ndarray) -> np.ndarray:
    """(string, window, 1, smaller id): the windows that a string of smaller id has as well. Strings come in order of
    minimiser."""
    found: list[tuple[int, int, int, int]] = []
    ids = least.tolist()
    head = np.flatnonzero(np.concatenate(([True], minimisers[1:] != minimisers[:-1]))).tolist()
    for s, e in zip(head, [*head[1:], len(contents)], strict=True):
        if e - s < 2:
            continue
        windows: list[tuple[bytes, int, int, int]] = []
        for c in range(s, e):
            text = contents[c]
            begins = [0, *(i + 1 for i, x in enumerate(text) if x == 32)]
            ends = [*(x - 1 for x in begins[1:]), len(text)]
            windows += [(text[begins[i] : ends[i + WINDOW - 1]], ids[c], c, i) for i in range(len(begins) - WINDOW + 1)]
        windows.sort()
        before, low = None, 0
        for text, doc, c, i in windows:
            if text != before:
                before, low = text, doc
            elif low < doc:
                found.append((c, i, 1, low))
    return np.array(found, np.int64).reshape(-1, 4)


def _finish(chunk: Chunk, covered: np.ndarray, out: pa.Schema) -> pa.Table:
    t = chunk.table
    rows = []
    for d, (s, e) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
        gone = covered[s:e]
        if gone.any():
            stay = np.flatnonzero(~gone) + s
            kept = b" ".join(t.data[a:b] for a, b in zip(t.start[stay].tolist(), t.end[stay].tolist(), strict=True))
        else:
            kept = b" ".join(chunk.texts[d].split())
        rows.append((chunk.ids[d], e - s, int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    columns = zip(*rows, strict=True)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def remove_repeated_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    return covered_by_smaller(df, words=True, gram=GRAM_WORDS, solver=sort_windows, finish=_finish, out=_OUT, schema="doc_id long, n_words long, n_removed long, kept_sha256 string", id_col=id_col, text_col=text_col)
