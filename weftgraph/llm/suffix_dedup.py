"""Substring dedup over bytes by column-wise suffix sorting of many short strings.

shared_windows brings together the byte strings that can hold a repeated 50-byte string: super-k-mers of at most 84
bytes. A bucket sorts all their suffixes column-wise: each round puts one more symbol of every string in front of its
suffixes. The suffixes of round t + 1 are the empty ones and, sorted stably by their new first symbol, those of round t;
the collection Burrows-Wheeler transform is the column of symbols that stand before each suffix, and the common prefix of
neighbours is one more than the least common prefix between their places in the round before. Each round reads and
writes the transform and the prefix column from end to end, as sequential files would be; a bucket's strings are worked
on in parts of about PART_STRINGS, those of a minimiser together, so these columns stay in memory. After as many rounds as the longest string has
bytes, suffixes with a common prefix of 50 or more hold equal 50-byte strings.

Equal strings of a bucket are one string to the sort, with the smallest of their ids; they are compared as bytes. Before
the sort, strings without a window whose digest another string of their minimiser has are left out and the rest are cut
to the stretch that has such windows: equal windows have equal digests, so this loses nothing, and only the sort, by the
bytes themselves, finds a window repeated.

A direct construction over whole documents would need as many rounds as the longest document has bytes, each over the
whole transform, which no cluster can run; the minimiser buckets make the strings short without losing a match.

Cases: null counts as empty; fewer than 50 bytes are never removed; a row with a null id removes nothing and loses
nothing; rows of one id do not remove each other; other columns are ignored; an empty table gives no rows; a text of any
length is read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.shared_windows import WINDOW, Chunk, covered_by_smaller
from weftgraph.llm.words import _BASE, _BASE_INVERSE, _BYTE, U64, _power, mix

GRAM_BYTES = 20
PART_STRINGS = 2000
_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _logarithms(n: int) -> np.ndarray:
    """Whole binary logarithms of 0 (as 0) to n."""
    return (np.frexp(np.maximum(np.arange(n + 1), 1).astype(np.float64))[1] - 1).astype(np.int32)


def _range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray, logarithm: np.ndarray) -> np.ndarray:
    """Least of values[low..high], both ends included."""
    n, size = len(values), high - low + 1
    level = logarithm[size]
    table = np.empty((int(level.max()) + 1 if len(level) else 1, n), values.dtype)
    table[0] = values
    for k in range(1, len(table)):
        half, width = 1 << (k - 1), n - (1 << k) + 1
        np.minimum(table[k - 1, :width], table[k - 1, half : half + width], out=table[k, :width])
    flat, row = table.ravel(), level * np.int32(n)
    return np.minimum(flat[row + low], flat[row + high + np.int32(1) - (np.int32(1) << level)])


def column_suffix_sort(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, common prefix with the one before) of all suffixes in order, empty ones first.

    The symbol 0 marks a string's beginning in the transform, so bytes are kept one higher.
    """
    m = len(strings)
    size = np.array([len(s) for s in strings], np.int64)
    base = np.cumsum(size + 1) - size - 1
    joined = np.frombuffer(b"".join(strings), np.uint8)
    kind = np.uint8 if not len(joined) or joined.max() < 255 else np.uint16  # UTF-8 has no byte 255
    text = np.zeros(len(joined) + m, kind)
    text[np.arange(len(joined)) + np.repeat(np.arange(1, m + 1), size)] = joined.astype(kind) + kind(1)
    empty = (base + size).astype(np.int32)  # place of each string's last symbol: what stands before its empty suffix
    at, prefix = empty, np.zeros(m, np.uint8)
    logarithm = _logarithms(len(text))
    for _ in range(int(size.max()) if m else 0):
        transform = text[at]
        order = np.argsort(transform, kind="stable").astype(np.int32)
        order = order[len(transform) - int(np.count_nonzero(transform)) :]  # whole strings take no further symbol
        if not len(order):
            break
        symbol = transform[order]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        longer = np.zeros(len(order), np.uint8)
        # Neighbours of one first symbol keep their order, so the stretch between their old places decides.
        longer[same] = np.minimum(_range_minimum(prefix, order[same - 1] + np.int32(1), order[same], logarithm), 254) + 1
        at = np.concatenate((empty, at[order] - np.int32(1)))
        prefix = np.concatenate((np.zeros(m, np.uint8), longer))
    string = np.searchsorted(base, at, "right") - 1
    return string, at - base[string], prefix


def _promising(contents: list[bytes], least: np.ndarray, minimisers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, begin, end): the stretch of each string from its first to its last window whose digest a string of the
    same minimiser and another id has too. Equal windows have equal digests, so nothing is lost; the sort decides."""
    size = np.array([len(c) for c in contents], np.int64)
    first = np.cumsum(size) - size
    raw = np.frombuffer(b"".join(contents), np.uint8)
    total = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)), out=total[1:])
    n = np.maximum(size - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(contents)), n)
    offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = first[owner] + offset
    digest = (total[start + WINDOW] - total[start]) * _power("down", _BASE_INVERSE, len(raw) + 1)[start]
    digest = mix(digest + mix(minimisers)[owner])
    order = np.argsort(digest)
    sorted_digest, ids = digest[order], least[owner[order]]
    head = np.flatnonzero(np.concatenate((np.ones(min(1, len(order)), bool), sorted_digest[1:] != sorted_digest[:-1])))
    if not len(head):
        return (np.empty(0, np.int64),) * 3
    shared = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
    hit = np.zeros(len(order), bool)
    hit[order] = np.repeat(shared, np.diff(np.append(head, len(order))))
    owner, offset = owner[hit], offset[hit]
    kept = np.flatnonzero(np.concatenate((np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1])))
    if not len(kept):
        return (np.empty(0, np.int64),) * 3
    return owner[kept], np.minimum.reduceat(offset, kept), np.maximum.reduceat(offset, kept) + WINDOW


def _blocks(minimisers: np.ndarray) -> Iterator[slice]:
    """Slices of about PART_STRINGS strings that keep those of a minimiser together."""
    ends = np.append(np.flatnonzero(minimisers[1:] != minimisers[:-1]) + 1, len(minimisers))
    begin = 0
    while begin < len(minimisers):
        end = int(ends[min(np.searchsorted(ends, begin + PART_STRINGS), len(ends) - 1)])
        yield slice(begin, end)
        begin = end


def match_windows(contents: list[bytes], least: np.ndarray, minimisers: np.ndarray) -> np.ndarray:
    """(string, first window, windows, smaller id): what of each string a string of smaller id has as well. Strings come
    in order of minimiser."""
    found = [np.empty((0, 4), np.int64)]
    for some in _blocks(minimisers):
        string, begin, end = _promising(contents[some], least[some], minimisers[some])
        if not len(string):
            continue
        string = string + some.start
        which, offset, prefix = column_suffix_sort([contents[i][s:e] for i, s, e in zip(string.tolist(), begin.tolist(), end.tolist(), strict=True)])
        ids = least[string][which]
        group = np.flatnonzero(prefix < WINDOW)
        low = np.repeat(np.minimum.reduceat(ids, group), np.diff(np.append(group, len(ids))))
        hit = np.flatnonzero((low < ids) & ((end - begin)[which] - offset >= WINDOW))
        rows = np.stack((string[which[hit]], offset[hit] + begin[which[hit]], low[hit]), 1)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1] + 1) | (rows[1:, 2] != rows[:-1, 2])
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(rows)))
        found.append(np.stack((rows[first, 0], rows[first, 1], n, rows[first, 2]), 1))
    return np.concatenate(found)


def _finish(chunk: Chunk, covered: np.ndarray, out: pa.Schema) -> pa.Table:
    rows = []
    for d, (s, e) in enumerate(zip(chunk.first[:-1].tolist(), chunk.first[1:].tolist(), strict=True)):
        raw, gone = chunk.texts[d], covered[s:e]
        n, spans = int(gone.sum()), 0
        if n:
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            raw = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        rows.append((chunk.ids[d], e - s, n, spans, hashlib.sha256(raw).hexdigest()))
    columns = zip(*rows, strict=True)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, out, strict=True)], schema=out)


def remove_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return covered_by_smaller(df, words=False, gram=GRAM_BYTES, solver=match_windows, finish=_finish, out=_OUT, schema="doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", id_col=id_col, text_col=text_col)
