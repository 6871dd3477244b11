"""Exact dedup by content sort, in DataFrame functions only.

Rows are range-partitioned by sampled splitters and sorted externally by the whole normalised text inside each range, so
equal texts are neighbours; windows over neighbours compare the whole texts and retain the smallest identifier. A
splitter is the text's first HEAD_CHARS characters, then a 64-bit hash of all of it, so that texts of one opening still
split, then a salt.

The salt is 0 but for texts that more rows share than one range should hold: of n copies, ceil(n / limit) salts take
their share by id, limit being 1/RANGES of all rows. Fewer than RANGES hashes can have more copies than that; they and
their numbers of salts are what is broadcast. Each range retains its best row of a salted text, and these rows, fewer
than 2 * RANGES, are compared by the same windows again. So all rows take one way, no range gets more than about
1/RANGES of all rows from one text, and no text is broadcast.

Cases: null text counts as empty and equals texts of white space only; a null id sorts after every other id; of rows
equal in text, length and id any one stays; an empty table gives an empty result; columns named like the results are
replaced. Texts of any length are compared whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.common import SPACE_CLASS, staged

RANGES = 256
HEAD_CHARS = 64
_RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def _normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE_CLASS + "+", "")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """df plus keep_id, group_size, kept, text_sha256; every row of df stays, dropped ones too."""
    names = [c for c in df.columns if c not in _RESULT]
    # The row travels as one column, so that no name of its can clash.
    text = F.coalesce(F.col("row")[text_col], F.lit(""))
    rows = df.select(F.struct(*names).alias("row")).withColumn("norm", _normalised(text))
    keyed = rows.select("row", F.substring("norm", 1, HEAD_CHARS).alias("head"), F.xxhash64("norm").alias("hash"), F.col("row")[id_col].alias("id"))

    limit = max(1, df.count() // ranges)
    copies = keyed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    copies = copies.select("hash", F.expr(f"(n + {limit} - 1) div {limit}").alias("salts"))  # fewer than 2 * ranges rows
    salted = keyed.join(F.broadcast(copies), "hash", "left")
    salted = salted.withColumn("salt", F.when(F.col("salts").isNotNull(), F.pmod(F.xxhash64("id"), "salts")).otherwise(0))

    sorted_rows = salted.repartitionByRange("head", "hash", "salt").withColumns({"norm": _normalised(text), "chars": F.char_length(text)})
    best = [F.col("chars").desc(), F.col("id").asc_nulls_last()]
    same = Window.partitionBy("norm", "head", "hash", "salt")
    run = same.orderBy(*best)
    local = sorted_rows.select(
        "row", "hash", "salt", "salts",
        F.sha2("norm", 256).alias("sha256"),
        F.first("id").over(run).alias("keep_id"),
        F.first("chars").over(run).alias("chars"),
        F.count(F.lit(1)).over(same).alias("n"),
        (F.row_number().over(run) == 1).alias("first"),
    )
    local = staged(local, "exact-runs")

    heads = local.filter("first AND salts IS NOT NULL").select("hash", "salt", "sha256", F.col("keep_id").alias("id"), "chars", "n", _normalised(text).alias("norm"))
    every = Window.partitionBy("norm")
    run = every.orderBy(*best)
    merged = heads.select(
        "hash", "salt", "sha256",
        F.struct(F.first("id").over(run).alias("keep_id"), F.sum("n").over(every).alias("n"), (F.row_number().over(run) == 1).alias("first")).alias("whole"),
    )
    done = local.join(F.broadcast(merged), ["hash", "salt", "sha256"], "left")
    whole, salted_row = F.col("whole"), F.col("whole").isNotNull()
    return done.select(
        *[F.col("row")[c].alias(c) for c in names],
        F.when(salted_row, whole["keep_id"]).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(salted_row, whole["n"]).otherwise(F.col("n")).alias("group_size"),
        (F.col("first") & (~salted_row | whole["first"])).alias("kept"),
        F.col("sha256").alias("text_sha256"),
    )


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
