"""Windows of WINDOW symbols that also start in a document with a smaller id: super-k-mer partitioning.

Symbols are words or bytes. The minimiser of a window is its smallest m-gram hash; consecutive windows of one minimiser
are a run (super-k-mer) of WINDOW + windows - 1 symbols. Equal windows have equal minimisers, so whatever repeats meets
in the bucket of its minimiser. Documents travel once, to chunks of about CHUNK_BYTES by a hash of id and text; all
else travels between chunks and buckets as packed arrays, one row a (chunk, bucket), already combined per chunk. These
rows grow with the square of the input, so chunks and buckets are as large as a worker's memory allows, and a bucket is
taken from a scrambled minimiser: the smallest of many hashes is near zero, and its own upper bits would deal most runs
to a few buckets.

A. chunk -> bucket: (minimiser, distinct runs, whether several documents have it) for each minimiser of the chunk.
B. bucket -> chunk: minimisers that several chunks, or several documents of one, have.
C. chunk -> bucket: each distinct run of those minimisers as one packed string. Runs of a minimiser that more than
   HOT_RUNS distinct (chunk, run) pairs have (a quarter of it for words, whose strings are longer) are sent window by
   window, to the buckets of the windows' digests, so that no bucket gathers an unbounded group.
D. bucket -> chunk: the bucket compares its strings, equal ones whole and the windows of the others symbol by symbol (the
   solver), and returns for each string the windows that a smaller id has.
E. chunk: every window with a smaller id is covered; the covered symbols of each document are handed to `finish`.

No window is removed on a digest alone: digests name a chunk's runs and windows, and those of one digest are compared
symbol by symbol in the chunk before they are taken for one; different ones would end the task with an error.

What a chunk sends for a passage is one entry however many of its documents hold it, so hot passages and large groups
of copies cost one entry a chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import as_bytes, with_text
from weftgraph.llm.words import _BASE, _BASE_INVERSE, _BYTE, U64, WordTable, _power, mix

WINDOW = 50
CHUNK_BYTES = 2 << 20
BUCKET_BYTES = 16 << 20
BLOCK_SYMBOLS = 1 << 20
HOT_RUNS = 20_000
KEY_BITS = 40
CONFIRM_BYTES = 1 << 20
_ROW = "bucket int, chunk int, payload binary"
_BACK = "chunk int, payload binary"
#: (contents, least ids, minimisers) -> (content, first window, windows, smaller id), one row each
Solver = Callable[[list[bytes], np.ndarray, np.ndarray], np.ndarray]


def pack(*arrays: np.ndarray) -> bytes:
    out = []
    for x in arrays:
        raw = x.tobytes()
        out += [x.dtype.str.encode().ljust(4), len(raw).to_bytes(8, "little"), raw]
    return b"".join(out)


def unpack(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at + 4 : at + 12], "little")
        out.append(np.frombuffer(data[at + 12 : at + 12 + n], data[at : at + 4].decode().strip()))
        at += 12 + n
    return out


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids as an offset and narrow differences where they fit."""
    low = ids.min()
    near = int(ids.max()) - int(low) < 2**32
    return np.array([low if near else 0], np.int64), (ids - low).astype(np.uint32) if near else ids


def unpack_ids(low: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return rest.astype(np.int64) + low[0]


def narrow(sizes: np.ndarray) -> np.ndarray:
    """Sizes in the least of three widths that holds them."""
    return sizes.astype(np.min_scalar_type(int(sizes.max())) if len(sizes) else np.uint8)


def stretch(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each stretch, one after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)


def confirm_equal(raw: np.ndarray, start: np.ndarray, size: np.ndarray, digest: np.ndarray) -> None:
    """Stretches of raw that stand next to each other with one digest must be equal byte by byte."""
    again = np.flatnonzero(digest[1:] == digest[:-1]) + 1
    equal = bool((size[again] == size[again - 1]).all())
    cuts = np.flatnonzero(np.diff(np.cumsum(size[again]) // CONFIRM_BYTES)) + 1
    for some in np.split(again, cuts) if equal else ():
        equal &= bool((raw[stretch(start[some], size[some])] == raw[stretch(start[some - 1], size[some])]).all())
    if not equal:
        raise ArithmeticError("two different stretches have one digest; change the seed in words.py")


@dataclass
class Runs:
    start: np.ndarray  # first symbol
    windows: np.ndarray
    key: np.ndarray  # minimiser, scrambled, KEY_BITS
    digest: np.ndarray  # of the content
    doc: np.ndarray  # place in the chunk


class Chunk:
    """Documents of a chunk as one symbol sequence."""

    def __init__(self, table: pa.Table, words: bool, gram: int):
        order = table.column("doc_id").to_pylist()
        texts = as_bytes(table.column("text").combine_chunks())
        self.ids, self.texts, self.words, self.gram = order, texts, words, gram
        self.doc_ids = np.array([0 if x is None else x for x in order], np.int64)
        self.no_id = np.array([x is None for x in order], bool)
        if words:
            t = WordTable(texts)
            self.table, self.first, value = t, t.first, t.hash
        else:
            self.data = b"".join(texts)
            self.first = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
            value = _BYTE[np.frombuffer(self.data, np.uint8)]
        n = len(value)
        self.total = np.zeros(n + 1, U64)
        np.cumsum(value * _power("up", _BASE, n), out=self.total[1:])
        self.down = _power("down", _BASE_INVERSE, n + 1)

    def digest(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """63-bit digests of symbol ranges, in the upper bits."""
        return mix((self.total[end] - self.total[start]) * self.down[start] + (end - start).astype(U64)) & ~U64(1)

    def content(self, start: int, end: int) -> bytes:
        if self.words:
            t = self.table
            return b" ".join(t.data[t.start[start] : t.end[end - 1]].split())
        return self.data[start:end]

    def contents(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bytes of symbol ranges, one after the other."""
        if self.words:
            texts = [self.content(s, e) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            return np.array([len(x) for x in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)
        return end - start, np.frombuffer(self.data, np.uint8)[stretch(start, end - start)]

    def confirm(self, start: np.ndarray, size: np.ndarray, digest: np.ndarray) -> None:
        """Stretches come sorted by digest; those of one digest must be equal symbol by symbol."""
        if not self.words:
            return confirm_equal(np.frombuffer(self.data, np.uint8), start, size, digest)
        same = digest[1:] == digest[:-1]
        some = np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(digest) else digest
        n, raw = self.contents(start[some], start[some] + size[some])
        confirm_equal(raw, np.cumsum(n) - n, n, digest[some])

    def runs(self) -> Runs:
        """All runs of all documents with an id; a run has at most WINDOW - gram + 1 windows."""
        parts: list[tuple] = []
        span = WINDOW - self.gram + 1
        for s in range(0, max(0, int(self.first[-1]) - WINDOW + 1), BLOCK_SYMBOLS):
            e = min(s + BLOCK_SYMBOLS, int(self.first[-1]) - WINDOW + 1)  # windows s..e-1
            at = np.arange(s, e + span - 1)
            least = mix((self.total[at + self.gram] - self.total[at]) * self.down[at])
            width = 1
            while 2 * width <= span:
                least = np.minimum(least[:-width], least[width:])
                width *= 2
            if width < span:
                least = np.minimum(least[: e - s], least[span - width : span - width + e - s])
            at = np.arange(s, e)
            begin, end = np.searchsorted(self.first, (s, e - 1), "right") - (1, 0)
            inside = np.diff(np.clip(self.first[begin : end + 1], s, e))
            doc = np.repeat(np.arange(begin, end), inside)
            last = np.where(self.no_id[begin:end], -1, self.first[begin + 1 : end + 1] - WINDOW)
            valid = at <= np.repeat(last, inside)
            at, least, doc = at[valid], least[valid], doc[valid]
            if not len(at):
                continue
            new = np.concatenate(([True], (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1])))
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(at)))
            if size.max() > span:  # cut long runs of one repeated minimiser
                within = np.arange(len(at)) - np.repeat(head, size)
                head = np.flatnonzero(within % span == 0)
                size = np.diff(np.append(head, len(at)))
            parts.append((at[head], size, mix(least[head]) >> U64(64 - KEY_BITS), doc[head]))
        if not parts:
            e = np.empty(0, np.int64)
            return Runs(e, e, e.astype(U64), e.astype(U64), e)
        start, size, key, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
        return Runs(start, size, key, self.digest(start, start + size + WINDOW - 1), doc)


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where any of the sorted columns changes."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


_ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])
_BACK_SCHEMA = pa.schema([("chunk", pa.int32()), ("payload", pa.binary())])


def _payloads(table: pa.Table) -> Iterator[tuple[int, bytes]]:
    return zip(table.column("chunk").to_pylist(), table.column("payload").to_pylist(), strict=True)


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """bucket is sorted."""
    head = _heads(bucket).tolist() if len(bucket) else []
    for s, e in zip(head, [*head[1:], len(bucket)][: len(head)], strict=True):
        yield int(bucket[s]), slice(s, e)


class Exchange:
    """Steps A to E; bits: buckets as a power of two, 8 at least so that 32 bits of a key remain inside one."""

    def __init__(self, words: bool, gram: int, bits: int, solver: Solver, finish, out: pa.Schema, hot_runs: int):
        self.words, self.gram, self.bits, self.solver, self.finish, self.out = words, gram, bits, solver, finish, out
        self.hot_runs = hot_runs

    def _bucket(self, key: np.ndarray) -> np.ndarray:
        return (key >> U64(KEY_BITS - self.bits)).astype(np.int32)

    def _inside(self, key: np.ndarray) -> np.ndarray:
        """What of a key its bucket does not say."""
        return (key & U64((1 << (KEY_BITS - self.bits)) - 1)).astype(np.uint32)

    def a(self, key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table, self.words, self.gram)
        r = chunk.runs()
        rows = []
        if len(r.key):
            order = np.lexsort((r.digest, r.key))
            k, d, ids = r.key[order], r.digest[order], chunk.doc_ids[r.doc[order]]
            head, distinct = _heads(k), _heads(k, d)
            n = np.diff(np.append(np.searchsorted(distinct, head), len(distinct)))
            several = np.minimum.reduceat(ids, head) != np.maximum.reduceat(ids, head)
            k, n = k[head], (np.minimum(n, 2**15 - 1) * 2 + several).astype(np.uint16)
            inside, name = self._inside(k), key[0].as_py()
            for bucket, part in _by_bucket(self._bucket(k)):
                rows.append((bucket, name, pack(inside[part], n[part])))
        return _rows(rows, _ROW_SCHEMA)

    def b(self, key: tuple, table: pa.Table) -> pa.Table:
        parts = []
        for chunk, payload in _payloads(table):
            k, n = unpack(payload)
            parts.append((np.full(len(k), chunk, np.int32), k, n))
        chunk, k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(k, kind="stable")
        chunk, k, n = chunk[order], k[order], n[order]
        head = _heads(k)
        size = np.diff(np.append(head, len(k)))
        shared = (size > 1) | (n[head] & 1 > 0)
        hot = np.add.reduceat(n.astype(np.int64) >> 1, head) > self.hot_runs
        shared, hot = np.repeat(shared, size), np.repeat(hot, size)
        chunk, k, hot = chunk[shared], k[shared], hot[shared]
        order = np.argsort(chunk, kind="stable")
        chunk, k, hot = chunk[order], k[order], hot[order]
        bucket = np.array([key[0].as_py()], np.uint64)
        return _rows([(c, pack(bucket, k[p], np.packbits(hot[p]))) for c, p in _by_bucket(chunk)], _BACK_SCHEMA)

    def _told(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Keys that other documents have too, sorted, and which of them are hot."""
        keys, hots = [np.empty(0, U64)], [np.empty(0, bool)]
        for payload in table.column("payload").to_pylist():
            bucket, k, hot = unpack(payload)
            keys.append(k.astype(U64) | (bucket << U64(KEY_BITS - self.bits)))
            hots.append(np.unpackbits(hot, count=len(k)).astype(bool))
        k, hot = np.concatenate(keys), np.concatenate(hots)
        order = np.argsort(k, kind="stable")
        return k[order], hot[order]

    @staticmethod
    def _find(sorted_keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Place of each wanted value, -1 where there is none."""
        if not len(sorted_keys):
            return np.full(len(wanted), -1)
        at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
        return np.where(sorted_keys[at] == wanted, at, -1)

    def _windows(self, chunk: Chunk, r: Runs, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, digest, document) of each window of the chosen runs."""
        n = r.windows[chosen]
        start = stretch(r.start[chosen], n)
        return start, chunk.digest(start, start + WINDOW), np.repeat(r.doc[chosen], n)

    def c(self, key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        name = key[0].as_py()
        if not docs.num_rows or not told.num_rows:
            return _rows([], _ROW_SCHEMA)
        chunk = Chunk(docs, self.words, self.gram)
        r = chunk.runs()
        k, is_hot = self._told(told)
        at = self._find(k, r.key)
        rows = []
        if is_hot.any():  # step E needs to know them; they travel by some bucket
            rows.append((name % (1 << self.bits), name, pack(np.zeros(1, np.uint8), k[is_hot])))
        asked, hot = np.flatnonzero((at >= 0) & ~is_hot[at]), np.flatnonzero((at >= 0) & is_hot[at])
        start, digest, doc = r.start[asked], r.digest[asked], r.doc[asked]
        end, route = start + r.windows[asked] + WINDOW - 1, r.key[asked]
        if len(hot):
            ws, wd, wdoc = self._windows(chunk, r, hot)
            start, digest, doc = np.concatenate((start, ws)), np.concatenate((digest, wd)), np.concatenate((doc, wdoc))
            end, route = np.concatenate((end, ws + WINDOW)), np.concatenate((route, mix(wd) >> U64(64 - KEY_BITS)))
        if len(route):
            order = np.lexsort((digest, route))
            route, digest, start, end, ids = route[order], digest[order], start[order], end[order], chunk.doc_ids[doc[order]]
            head = _heads(route, digest)
            low = np.minimum.reduceat(ids, head)
            route, digest, start, end = route[head], digest[head], start[head], end[head]
            for bucket, p in _by_bucket(self._bucket(route)):
                sizes, joined = chunk.contents(start[p], end[p])
                rows.append((bucket, name, pack(np.ones(1, np.uint8), self._inside(route[p]), digest[p], *pack_ids(low[p]), narrow(sizes), joined)))
        return _rows(rows, _ROW_SCHEMA)

    def d(self, key: tuple, table: pa.Table) -> pa.Table:
        rows, parts = [], []
        for chunk, payload in _payloads(table):
            got = unpack(payload)
            if got[0][0] == 0:
                rows.append((chunk, payload))
            else:
                _, route, digest, low, rest, sizes, joined = got
                parts.append((np.full(len(route), chunk, np.int32), route, digest, unpack_ids(low, rest), sizes.astype(np.int64), joined))
        if not parts:
            return _rows(rows, _BACK_SCHEMA)
        chunk, route, digest, ids, size, joined = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        start = np.cumsum(size) - size
        order = np.lexsort((digest, route))
        chunk, route, digest, ids, size, start = (x[order] for x in (chunk, route, digest, ids, size, start))
        head = _heads(route, digest)
        confirm_equal(joined, start, size, digest)
        uses, least = np.diff(np.append(head, len(ids))), np.minimum.reduceat(ids, head)
        smaller = np.repeat(least, uses)
        whole = np.flatnonzero(ids > smaller)
        answers = [(whole, np.zeros(len(whole), np.int16), np.full(len(whole), -1, np.int16), smaller[whole])]
        by_route = _heads(route[head])
        contents = np.diff(np.append(by_route, len(head)))
        asked = np.flatnonzero(np.repeat(contents > 1, contents))  # minimisers with several contents
        if len(asked):
            begin, end = start[head[asked]], start[head[asked]] + size[head[asked]]
            texts = [joined[s:e].tobytes() for s, e in zip(begin.tolist(), end.tolist(), strict=True)]
            found = self.solver(texts, least[asked], route[head[asked]].astype(U64))
            content, found = asked[found[:, 0]], found[:, 1:]
            use, by = stretch(head[content], uses[content]), np.repeat(np.arange(len(content)), uses[content])
            use, by = use[found[by, 2] < ids[use]], by[found[by, 2] < ids[use]]
            answers.append((use, found[by, 0].astype(np.int16), found[by, 1].astype(np.int16), found[by, 2]))
        use, first, n, smaller = (np.concatenate(x) for x in zip(*answers, strict=True))
        order = np.argsort(chunk[use], kind="stable")
        use, first, n, smaller = use[order], first[order], n[order], smaller[order]
        for c, p in _by_bucket(chunk[use]):
            rows.append((c, pack(np.ones(1, np.uint8), digest[use[p]], first[p], n[p], *pack_ids(smaller[p]))))
        return _rows(rows, _BACK_SCHEMA)

    def e(self, key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        chunk = Chunk(docs, self.words, self.gram)
        cover = np.zeros(int(chunk.first[-1]) + 1, np.int64)

        def covered(start: np.ndarray, windows: np.ndarray) -> None:
            np.add.at(cover, start, 1)
            np.add.at(cover, start + windows + WINDOW - 1, -1)

        r = chunk.runs()
        if len(r.key):
            order = np.argsort(r.digest, kind="stable")
            r = Runs(*(x[order] for x in (r.start, r.windows, r.key, r.digest, r.doc)))
            chunk.confirm(r.start, r.windows + WINDOW - 1, r.digest)
            ids = chunk.doc_ids[r.doc]
            head = _heads(r.digest)
            hit = ids > np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, len(ids))))
            payloads = [unpack(x) for x in told.column("payload").to_pylist()]
            answers = [(g, first, n, unpack_ids(*low)) for _, g, first, n, *low in (p for p in payloads if p[0][0] == 1)]
            # All buckets' answers as one, sorted by digest: what follows is done once, not once a bucket.
            if answers:
                g, first, n, smaller = (np.concatenate(x) for x in zip(*answers, strict=True))
                by = np.lexsort((smaller, g))
                g, first, n, smaller = g[by], first[by].astype(np.int64), n[by].astype(np.int64), smaller[by]
            else:
                g, first, n, smaller = np.empty(0, U64), *np.empty((3, 0), np.int64)
            for p in payloads:
                if p[0][0] == 0:
                    self._hot(chunk, r, np.flatnonzero(self._find(p[1], r.key) >= 0), g, smaller, covered)
            if len(g):
                s, e = np.searchsorted(r.digest, g, "left"), np.searchsorted(r.digest, g, "right")
                each = e - s
                told_by = np.repeat(np.arange(len(g)), each)
                run = stretch(s, each)
                ok = ids[run] > smaller[told_by]
                run, told_by = run[ok], told_by[ok]
                covered(r.start[run] + first[told_by], np.where(n[told_by] < 0, r.windows[run], n[told_by]))
            covered(r.start[hit], r.windows[hit])
        return self.finish(chunk, np.cumsum(cover[:-1]) > 0, self.out)

    def _hot(self, chunk: Chunk, r: Runs, hot: np.ndarray, g: np.ndarray, smaller: np.ndarray, covered) -> None:
        """Cover the windows of hot runs that an answer, or another document of the chunk, gives a smaller id. Answers
        (digests g, smaller ids) come sorted by both."""
        start, digest, doc = self._windows(chunk, r, hot)
        order = np.argsort(digest, kind="stable")
        start, digest, ids = start[order], digest[order], chunk.doc_ids[doc[order]]
        chunk.confirm(start, np.full(len(start), WINDOW), digest)
        head = _heads(digest)
        hit = ids > np.repeat(np.minimum.reduceat(ids, head), np.diff(np.append(head, len(ids))))
        if len(g):
            first = _heads(g)
            at = self._find(g[first], digest)
            hit |= (at >= 0) & (ids > smaller[first][at])
        covered(start[hit], np.ones(int(hit.sum()), np.int64))


def covered_by_smaller(df: DataFrame, *, words: bool, gram: int, solver: Solver, finish, out: pa.Schema, schema: str, id_col: str, text_col: str) -> DataFrame:
    """Run the exchange; finish(chunk, covered symbols, out) makes the rows of each chunk's documents."""
    docs = with_text(df, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / CHUNK_BYTES))
    bits = max(8, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
    x = Exchange(words, gram, bits, solver, finish, out, max(1, HOT_RUNS // 4) if words else HOT_RUNS)
    docs = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int"))
    by_chunk = docs.groupBy("chunk")
    sent = by_chunk.applyInArrow(lambda k, t: x.a(k, t), _ROW)
    told = sent.groupBy("bucket").applyInArrow(lambda k, t: x.b(k, t), _BACK)
    asked = by_chunk.cogroup(told.groupBy("chunk")).applyInArrow(lambda k, t, u: x.c(k, t, u), _ROW)
    answered = asked.groupBy("bucket").applyInArrow(lambda k, t: x.d(k, t), _BACK)
    return by_chunk.cogroup(answered.groupBy("chunk")).applyInArrow(lambda k, t, u: x.e(k, t, u), schema)
