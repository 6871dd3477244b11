"""Token ids in files of patched frame-of-reference blocks.

Documents are range-partitioned by id and sorted, so partitions and the segments inside them are in corpus order. A
segment holds whole documents of about SEGMENT_TOKENS ids. Its ids are cut into blocks of BLOCK values: the block
minimum is subtracted, a width is chosen that the given percentile of the rest fits in, that many bits of every value
are packed, and values beyond the width go to an exception list of (position, value).

Byte layout of one encoded array, little endian: magic "WPF1", values u32, blocks u32; then for each block base u32;
width u8; exceptions u16; start u32 (the index of block starts, from the first block); then the blocks: 32 * width
bytes of bits, exception positions u8, exception values u32.

Segments are rows of Parquet files (part, seg, local_start, n_tokens, doc_ids, lengths, ids), so that any store Spark
writes to will do and lost executors cost no more than their tasks; lengths and ids are encoded arrays.

Cases: null or empty text gives the end id alone; null ids come first in the order; rows of one id follow each other,
ordered by text; other columns are ignored; an empty table gives no rows. A document is never split over segments, so
a worker holds the ids of the longest document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import batches, few, shared_dir, sliced, with_text
from weftgraph.llm.tokens import piece_encoder, tokenizer_path

BLOCK = 256
PERCENTILE = 90
SEGMENT_TOKENS = 1 << 20
ENCODE_DOCS = 128
MAGIC = b"WPF1"
SEGMENTS = "part int, seg int, local_start long, n_tokens long, doc_ids array<long>, lengths binary, ids binary"


def pfor_encode(values: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    """Encode unsigned 32-bit values."""
    n = len(values)
    k = -(-n // BLOCK)
    if not n:
        return MAGIC + np.array([0, 0], "<u4").tobytes()
    v = np.empty(k * BLOCK, np.uint32)
    v[:n], v[n:] = values, values[-1]
    v = v.reshape(k, BLOCK)
    base = v.min(axis=1)
    d = v - base[:, None]
    at = min(BLOCK - 1, BLOCK * percentile // 100)
    chosen = np.partition(d, at, axis=1)[:, at]
    width = np.where(chosen > 0, np.floor(np.log2(np.maximum(chosen, 1).astype(np.float64))) + 1, 0).astype(np.int64)
    over = d.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    n_exc = over.sum(axis=1)
    size = 32 * width + 5 * n_exc
    start = np.concatenate(([0], np.cumsum(size)[:-1]))
    out = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            low = d[which].astype("<u2" if w <= 16 else "<u4").view(np.uint8).reshape(len(which), BLOCK, -1)
            if w != 8 * low.shape[2]:
                low = np.packbits(np.unpackbits(low, axis=2, bitorder="little")[:, :, :w].reshape(len(which), -1), axis=1, bitorder="little")
            out[start[which][:, None] + np.arange(32 * w)] = low.reshape(len(which), -1)
    rows, cols = np.nonzero(over)
    if len(rows):
        nth = np.arange(len(rows)) - np.concatenate(([0], np.cumsum(n_exc)[:-1]))[rows]
        at_pos = start[rows] + 32 * width[rows]
        out[at_pos + nth] = cols
        raw = d[rows, cols].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(at_pos + n_exc[rows] + 4 * nth)[:, None] + np.arange(4)] = raw
    head = [np.array([n, k], "<u4"), base.astype("<u4"), width.astype(np.uint8), n_exc.astype("<u2"), start.astype("<u4")]
    return MAGIC + b"".join(x.tobytes() for x in head) + out.tobytes()


def pfor_decode(data: bytes) -> np.ndarray:
    if data[:4] != MAGIC:
        raise ValueError("not a patched frame-of-reference array")
    n, k = np.frombuffer(data, "<u4", 2, 4)
    n, k = int(n), int(k)
    if not n:
        return np.empty(0, np.uint32)
    at = 12
    parts = []
    for kind in ("<u4", "u1", "<u2", "<u4"):
        parts.append(np.frombuffer(data, kind, k, at))
        at += parts[-1].nbytes
    base, width, n_exc, start = parts[0], parts[1].astype(np.int64), parts[2].astype(np.int64), parts[3].astype(np.int64)
    body = np.frombuffer(data, np.uint8, -1, at)
    d = np.zeros((k, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            packed = body[start[which][:, None] + np.arange(32 * w)]
            kind, wide = ("<u2", 16) if w <= 16 else ("<u4", 32)
            if w != wide:
                bits = np.zeros((len(which), BLOCK, wide), np.uint8)
                bits[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), BLOCK, w)
                packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
            d[which] = packed.view(kind)
    if n_exc.any():
        rows = np.repeat(np.arange(k), n_exc)
        nth = np.arange(len(rows)) - np.concatenate(([0], np.cumsum(n_exc)[:-1]))[rows]
        at_pos = start[rows] + 32 * width[rows]
        where = (at_pos + n_exc[rows] + 4 * nth)[:, None] + np.arange(4)
        d[rows, body[at_pos + nth]] = np.ascontiguousarray(body[where]).view("<u4").ravel()
    return (d + base[:, None]).ravel()[:n]


def _encode(path: str, kind: str, end_id: int):
    schema = pa.schema([("part", pa.int32()), ("seg", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("ids", pa.binary())])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(path, kind), np.array([end_id], "<u4").tobytes()
        part, seg, begun = TaskContext.get().partitionId(), 0, 0
        ids: list[bytes] = []
        docs: list[int | None] = []

        def segment() -> pa.RecordBatch:
            nonlocal seg, begun, ids, docs
            lengths = np.array([len(x) // 4 for x in ids], np.uint32)
            n = int(lengths.sum(dtype=np.int64))
            row = {"part": [part], "seg": [seg], "local_start": [begun], "n_tokens": [n], "doc_ids": [docs], "lengths": [pfor_encode(lengths)], "ids": [pfor_encode(np.frombuffer(b"".join(ids), "<u4"))]}
            seg, begun, ids, docs = seg + 1, begun + n, [], []
            return batches(row, schema)

        held = 0
        for some in sliced(batch_iter, ENCODE_DOCS):
            for doc_id, got in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist()), strict=True):
                docs.append(doc_id)
                ids.append(got + end)
                held += len(got) // 4 + 1
                if held >= SEGMENT_TOKENS:
                    yield segment()
                    held = 0
        if docs:
            yield segment()

    return run


def write_tokens(df: DataFrame, path: str, *, vocabulary: str, kind: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of all documents, in id order, as segment files under path."""
    docs = with_text(df, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    docs.mapInArrow(_encode(vocabulary, kind, end_id), SEGMENTS).write.parquet(path)


_READ = "part int, doc_id long, local long, n_tokens long, ids_crc32 long"


def _decode(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("part", pa.int32()), *((c, pa.int64()) for c in ("doc_id", "local", "n_tokens", "ids_crc32"))])
    for b in sliced(batch_iter, 1):  # a row is a segment
        for row in b.to_pylist():
            lengths = pfor_decode(row["lengths"]).astype(np.int64)
            ids = pfor_decode(row["ids"]).astype("<u4").tobytes()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(ids[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield batches({"part": [row["part"]] * len(lengths), "doc_id": row["doc_ids"], "local": (starts + row["local_start"]).tolist(), "n_tokens": lengths.tolist(), "ids_crc32": crc}, schema)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # One row a write task, whatever the corpus.
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    docs = files.select("part", "local_start", "doc_ids", "lengths", "ids").mapInArrow(_decode, _READ)
    return docs.join(few(parts, parts.count()), "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def op3(df: DataFrame) -> DataFrame:
    from uuid import uuid4

    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid4().hex}"
    write_tokens(df, path, vocabulary=tokenizer_path("byte_bpe_50k.json"), kind="byte", end_id=0)
    return read_tokens(spark, path)
