"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.shared import shared_dir

#: The six characters [\x20\x09-\x0D]; bytes.split() and bytes.strip() use the same set.
SPACES = b" \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


#: Tables of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 100_000


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, whose rows have been counted, with a broadcast hint if they are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


#: Bytes of an Arrow batch, the same for all operators: what a Python worker is sent at once. A longer row is one batch.
BATCH_BYTES = 8 << 20
#: Tables that operators have staged and nobody has dropped.
_STAGED: list[str] = []


def written(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df written to the shared folder and read back, and where it lies; it stays until it is dropped."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at), at


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    table, at = written(df, label)
    _STAGED.append(at)
    return table


def drop(spark: SparkSession, *paths: str) -> None:
    for at in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_staged(spark: SparkSession) -> None:
    """Delete what operators have staged so far; results that have not been written by now are lost."""
    drop(spark, *_STAGED)
    _STAGED.clear()


def sliced(batch_iter: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches, which Spark bounds by bytes, in slices of few rows: so many texts a worker turns into objects at once."""
    for b in batch_iter:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def with_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and further columns under fixed names. Also bounds Arrow batches by BATCH_BYTES."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more
    )


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, None as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def batches(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)


def code_point_offsets(raw: bytes, at: list[int]) -> list[int]:
    """Code-point offsets of byte offsets."""
    if raw.isascii():
        return at
    starts = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
    count = np.concatenate(([0], np.cumsum(starts)))
    return [int(count[x]) for x in at]


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)
