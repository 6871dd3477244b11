"""The folder that all executors share, tables staged in it, and broadcasts under a size check."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of more rows than this are joined by a shuffle.
BROADCAST_ROWS = 50_000
#: Texts and hashes, most of what is written, take two thirds of what Spark's default codec leaves.
CODEC = "zstd"
#: Bytes of an Arrow batch: what a Python worker is sent at once. A longer row is one batch.
BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if the driver is all there is (tests), else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def staged(df: DataFrame, label: str = "staged") -> DataFrame:
    """df written to the shared folder and read back: computed once, lineage cut, and there when executors are lost."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/weft/{label}-{uuid.uuid4().hex}"
    df.write.parquet(at, compression=CODEC)
    return spark.read.schema(df.schema).parquet(at)


def clear(spark: SparkSession) -> None:
    """Delete all staged tables of the shared folder; results that still read them are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/weft")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded(df: DataFrame) -> DataFrame:
    """df, for whose session Arrow batches are bounded by BATCH_BYTES from now on; Spark by itself allows 64 MB."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def few(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most limit rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan that has fewer splits than the cluster has cores, dealt anew; a table of many files stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
