"""Best-fit packing of documents into sequences, by matching of large items.

Only the number of pieces of each length decides how many sequences are needed, and there are at most `capacity`
lengths. So the packing is worked out on that histogram, on the driver, in a time and space that do not grow with the
corpus: pieces above one third of the capacity pair at most twice a sequence, the largest with the largest that fits
beside it; smaller ones, largest first, go where the least room that is enough is left; a new sequence opens when no
room is enough. The outcome is a table of runs (length, first rank, pieces, first sequence, pieces a sequence, offset),
which is broadcast while it is short (`few`) and joined by length beyond; each piece finds its place by its rank among
the pieces of its length. Ranks come from counts of (length, bucket), so a length that a third of all documents have is spread
over BUCKETS tasks.

``pack_mixed`` packs within consecutive runs of the mix order instead: documents take the slot and place that
``mix_sources`` gives them, chunks of CHUNK_SLOTS slots are joined to runs of about RUN_PIECES pieces, and each run is
packed by itself with its sequences numbered by the first of their pieces. So sequences read in order hold the sources
by target weight, run by run. A worker holds the piece rows (no texts) of one run.

Cases: null or empty text is a piece of the end id alone; null ids are kept; repeated rows are packed each; columns
other than id and text are ignored; an empty table gives no rows; a text of any length is tokenised whole and cut.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import mixing
from weftgraph.llm.common import batches, few, sliced, staged, with_text
from weftgraph.llm.tokens import piece_encoder, tokenizer_path

CAPACITY = 4096
BUCKETS = 32
ENCODE_DOCS = 128
RUN_PIECES = 4096
CHUNK_SLOTS = 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, kind: str, end_id: int, capacity: int, more: tuple[tuple[str, pa.DataType], ...] = ()):
    """Pieces of documents; more: columns that travel along."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *more])

    def run(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = piece_encoder(path, kind), np.array([end_id], "<u4").tobytes()
        for some in sliced(batch_iter, ENCODE_DOCS):
            rows: dict[str, list] = {f.name: [] for f in schema}
            along = zip(*(some.column(name).to_pylist() for name, _ in more), strict=True) if more else [()] * some.num_rows
            for doc_id, got, rest in zip(some.column("doc_id").to_pylist(), encoder.encode(some.column("text").to_pylist()), along, strict=True):
                ids = got + end
                for k, s in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[s : s + 4 * capacity]
                    for name, x in zip(rows, (doc_id, k, s // 4, len(part) // 4, zlib.crc32(part), *rest), strict=True):
                        rows[name].append(x)
            yield batches(rows, schema)

    return run


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first sequence, pieces a sequence, offset) and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    taken: dict[int, int] = defaultdict(int)
    runs: list[tuple[int, int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, sequences)
    sequences = 0

    def place(length: int, pieces: int, first: int, each: int, offset: int) -> None:
        runs.append((length, taken[length], pieces, first, each, offset))
        taken[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    for length in reversed(large):
        while left[length]:
            at = bisect.bisect_right(large, min(capacity - length, length)) - 1
            while at >= 0 and not left[large[at]]:
                at -= 1
            mate = large[at] if at >= 0 else 0
            if mate == length and left[length] == 1:
                at -= 1
                while at >= 0 and not left[large[at]]:
                    at -= 1
                mate = large[at] if at >= 0 else 0
            if mate == length:
                k = left[length] // 2
                place(length, 2 * k, sequences, 2, 0)
            else:
                k = min(left[length], left[mate]) if mate else left[length]
                place(length, k, sequences, 1, 0)
                if mate:
                    place(mate, k, sequences, 1, length)
            if gap := capacity - length - mate:
                room[gap].append((sequences, k))
            sequences += k

    gaps = sorted(room)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[length]:
            at = bisect.bisect_left(gaps, length)
            if at == len(gaps):
                k = -(-left[length] // (capacity // length))
                room[capacity].append((sequences, k))
                bisect.insort(gaps, capacity)
                sequences += k
                continue
            gap = gaps[at]
            first, k = room[gap].pop()
            each = gap // length
            whole = min(k, left[length] // each)
            back = []
            if whole:
                place(length, whole * each, first, each, capacity - gap)
                back.append((gap - each * length, first, whole))
            if whole < k and left[length]:
                some = left[length]
                place(length, some, first + whole, each, capacity - gap)
                back.append((gap - some * length, first + whole, 1))
                whole += 1
            if whole < k:
                back.append((gap, first + whole, k - whole))
            if not room[gap]:
                del room[gap], gaps[at]
            for g, f, n in back:
                if g:
                    if g not in room:
                        bisect.insort(gaps, g)
                    room[g].append((f, n))
    return runs, sequences


def pack_documents(df: DataFrame, *, vocabulary: str | None = None, kind: str = "word", end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    pieces = staged(with_text(df, id_col, text_col).mapInArrow(_cut(path, kind, end_id, capacity), PIECES), "pieces")
    pieces = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    found = pieces.groupBy("length", "_bucket").count().collect()  # at most capacity * BUCKETS rows
    counts: dict[int, int] = defaultdict(int)
    before = []
    for n, bucket, c in sorted(found):
        before.append((n, bucket, counts[n]))
        counts[n] += c
    runs, _ = plan_sequences(counts, capacity)
    before = few(spark.createDataFrame(before, "length long, _bucket long, _before long"), len(before))
    runs = few(spark.createDataFrame(runs, "_length long, _rank long, _pieces long, _first long, _each long, _offset long"), len(runs))

    nth = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece")
    ranked = pieces.withColumn("_rn", F.row_number().over(nth)).join(before, ["length", "_bucket"])
    ranked = ranked.withColumn("_at", F.col("_before") + F.col("_rn") - 1)
    inside = (F.col("_at") >= F.col("_rank")) & (F.col("_at") < F.col("_rank") + F.col("_pieces"))
    placed = ranked.join(runs, (F.col("length") == F.col("_length")) & inside)
    nth_in_run = F.col("_at") - F.col("_rank")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        (F.col("_first") + F.expr("(_at - _rank) div _each")).alias("sequence_id"),
        (F.col("_offset") + (nth_in_run % F.col("_each")) * F.col("length")).alias("offset"),
    )


def _pack_run(capacity: int):
    def pack(run: pa.Table) -> pa.Table:
        run = run.sort_by([("slot", "ascending"), ("place", "ascending"), ("piece", "ascending")])
        lengths = run.column("length").to_numpy()
        values, counts = np.unique(lengths, return_counts=True)
        runs, n = plan_sequences(dict(zip(values.tolist(), counts.tolist(), strict=True)), capacity)
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        by_length = dict(zip(values.tolist(), np.split(np.argsort(lengths, kind="stable"), np.cumsum(counts)[:-1]), strict=True))
        for length, rank, pieces, first, each, at in runs:
            rows, nth = by_length[length][rank : rank + pieces], np.arange(pieces)
            sequence[rows], offset[rows] = first + nth // each, at + nth % each * length
        used, first_row = np.unique(sequence, return_index=True)
        number = np.zeros(n, np.int64)
        number[used[np.argsort(first_row)]] = np.arange(len(used))
        run = run.select([*(c.split()[0] for c in PIECES.split(", ")), "_run"])
        return run.append_column("_sequence", pa.array(number[sequence])).append_column("offset", pa.array(offset))

    return pack


def pack_mixed(
    df: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    vocabulary: str | None = None,
    kind: str = "word",
    end_id: int = 1,
    capacity: int = CAPACITY,
    run_pieces: int = RUN_PIECES,
    chunk_slots: int = CHUNK_SLOTS,
) -> DataFrame:
    """The columns of pack_documents; sequences follow the order that mix_sources deals the documents with weights."""
    path = vocabulary or tokenizer_path("word_bpe_49k.json")
    more = (("source", pa.string()), ("_row", pa.int64()))
    rows = with_text(df, "doc_id", "text", mixing.source_key().alias("source"), F.monotonically_increasing_id().alias("_row"))
    pieces = staged(rows.mapInArrow(_cut(path, kind, end_id, capacity, more), PIECES + ", source string, _row long"), "pieces")
    mixed = mixing.mix_sources(pieces.filter("piece = 0").select("doc_id", "source", "_row"), weights)
    mixed = mixed.select("_row", "slot", "place", F.expr(f"slot div {chunk_slots}").alias("_chunk"))
    pieces = staged(pieces.drop("source").join(mixed, "_row"), "mixed-pieces")

    # One row a chunk that has documents, and its run by the pieces before it.
    before = Window.partitionBy().orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = pieces.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    chunks = chunks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    chunks = chunks.select("_chunk", F.expr(f"_before div {run_pieces}").alias("_run"))
    packed = pieces.join(F.broadcast(chunks), "_chunk").groupBy("_run").applyInArrow(_pack_run(capacity), PIECES + ", _run long, _sequence long, offset long")
    packed = staged(packed, "packed-runs")

    earlier = Window.partitionBy().orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    first = packed.groupBy("_run").agg((F.max("_sequence") + 1).alias("_n"))
    first = first.select("_run", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    placed = packed.join(F.broadcast(first), "_run")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_sequence")).alias("sequence_id"), "offset")
