"""Chunking, extraction and the rows that ingest writes."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from weftgraph.functions.text import cache_key, chunk_hash, statement
from weftgraph.schema import PROPOSITION

CHUNK_SIZE, CHUNK_OVERLAP = 1200, 100
OFFLINE_CHARS = 120
#: Texts that a worker turns into objects at once.
SLICE = 256
MAX_PROPOSITIONS = 20
Extractor = Callable[[list[str]], list[list[dict]]]


def _paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of each paragraph without the white space around it; blank lines part paragraphs."""
    begin = 0
    for gap_start, gap_end in [*(m.span() for m in re.finditer(r"\n{2,}", text)), (len(text), len(text))]:
        inner = text[begin:gap_start]
        if body := inner.strip():
            start = begin + inner.index(body[0])
            yield start, start + len(body)
        begin = gap_end


def chunk_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[list[tuple[int, int]]]:
    """The chunks of a text, each as the (start, end) of the paragraphs, or parts of one, that it joins.

    A paragraph joins the chunk before it while both and one character more fit into size. Otherwise it begins a chunk
    of its own; of n characters too many, ceil(n / (size - overlap)) cuts of full size come first, each size - overlap
    after the one before, and the rest stays open for the next paragraph. A text without paragraphs is its first size
    characters.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step, laid, used = size - overlap, [], size
    for start, end in _paragraphs(text):
        length = end - start
        if used + length < size:
            first, stop = laid[-1][0]
            first += stop - first - len(text[first:stop].lstrip())  # a rest may begin with white space, a join may not
            laid[-1] = [(first, stop), *laid[-1][1:], (start, end)]
        else:
            cuts = max(0, -(-(length - size) // step))
            laid += [[(start + i * step, start + i * step + size)] for i in range(cuts)]
            laid.append([(start + cuts * step, end)])
        used = sum(e - s for s, e in laid[-1]) + 2 * (len(laid[-1]) - 1)
    return laid or [[(0, min(size, len(text)))]]


def _joined(text: str, spans: list[tuple[int, int]]) -> str:
    return "\n\n".join(text[s:e] for s, e in spans)


def chunk_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[str]:
    """The chunks of a text (see chunk_spans), paragraphs joined by a blank line."""
    return [_joined(text, spans) for spans in chunk_spans(text, size, overlap)]


def step_spans(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> list[list[tuple[int, int]]]:
    """The cuts of a text as it is, blank lines and edges included: each of size characters, size - overlap after the one
    before, and the rest; a text of at most size characters is one."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    cuts = max(0, -(-(len(text) - size) // step))
    return [[(i * step, min(i * step + size, len(text)))] for i in range(cuts + 1)]


def chunks(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, paragraphs: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """(document_id, ordinal, text, span_start, span_end, offset_start, *carry): chunks with nominal spans and true offsets.

    Chunks pack paragraphs (see chunk_spans), a null text is an empty one; without paragraphs they are cuts at fixed steps
    (see step_spans), and a null text has none. offset_start is where the chunk begins in the text; null where joining
    paragraphs changed the characters between. carry: columns that each chunk has from its row.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    spans_of = chunk_spans if paragraphs else step_spans

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("document_id", "ordinal", "text", "span_start", "span_end", "offset_start")
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32())
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            rows: list[list] = [[] for _ in names]
            parents: list[int] = []
            for parent, (doc, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                if text is None and not paragraphs:
                    continue
                whole = text or ""
                for i, spans in enumerate(spans_of(whole, size, overlap)):
                    c, start = _joined(whole, spans), spans[0][0]
                    true = start if whole.startswith(c, start) else None
                    for r, x in zip(rows, (doc, i, c, i * size, i * size + len(c), true), strict=True):
                        r.append(x)
                    parents.append(parent)
            own = [b.column(2 + i).take(pa.array(parents, pa.int32())) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*[pa.array(r, k) for r, k in zip(rows, kinds, strict=True)], *own], names=[*names, *carry])

    schema = "document_id string, ordinal int, text string, span_start int, span_end int, offset_start int"
    schema += "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), *carry).mapInArrow(run, schema)


def offline_propositions(text: Column) -> Column:
    """The extraction without a model: one statement about the chunk's first characters."""
    start = F.substring(text, 1, OFFLINE_CHARS)
    one = F.struct(start.alias("text"), F.lit("?").alias("subject"), F.lit("states").alias("predicate"), start.alias("object"), F.lit(True).alias("object_is_literal"))
    return F.array(one)


_KIND = {f.name: bool if isinstance(f.dataType, BooleanType) else str for f in PROPOSITION}
_DEFAULT = {"text": "", "object_is_literal": False}


def _objects(answer: str) -> Iterator[dict]:
    """The outermost JSON objects that can be read in an answer, whatever stands around them."""
    decoder, at = json.JSONDecoder(), answer.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(answer, at)
            yield value
        except json.JSONDecodeError:
            end = at + 1
        at = answer.find("{", end)


def parse_propositions(answer: str) -> list[dict]:
    """Propositions of a model's answer: the list in the first JSON object that has one, without malformed items."""
    items = next((x["propositions"] for x in _objects(answer) if isinstance(x.get("propositions"), list)), [])
    rows = [{c: (_DEFAULT | x).get(c) for c in _KIND} for x in items if isinstance(x, dict)]
    rows = [r for r in rows if all(type(r[c]) is kind for c, kind in _KIND.items())]
    return [r | {"text": r["text"] or " ".join((r["subject"], r["predicate"], r["object"])).strip()} for r in rows]


def extract(chunked: DataFrame, cache: DataFrame | None, model: str, extractor: Extractor | None = None) -> tuple[DataFrame, DataFrame]:
    """chunked plus cache_key and propositions, and the new cache rows. No extractor: offline, the cache stays untouched.

    Chunks that the cache has never reach the extractor; equal chunks reach it once.
    """
    keyed = chunked.withColumn("cache_key", cache_key(F.col("text"), model))
    if extractor is None:
        return keyed.withColumn("propositions", offline_propositions(F.col("text"))), keyed.limit(0).select("cache_key")
    call = extractor

    @F.pandas_udf(f"array<struct<{', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in PROPOSITION)}>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([x[:MAX_PROPOSITIONS] for x in call(texts.tolist())], index=texts.index)

    have = keyed.join(cache.select("cache_key", "propositions"), "cache_key", "left")
    new = have.filter("propositions IS NULL").select("cache_key", "text").dropDuplicates(["cache_key"])
    new = new.select("cache_key", chunk_hash(F.col("text")).alias("chunk_hash"), run("text").alias("propositions"))
    fresh = new.select("cache_key", F.col("propositions").alias("_new"))
    both = have.join(fresh, "cache_key", "left").withColumn("propositions", F.coalesce("propositions", "_new")).drop("_new")
    return both, new


def statements(extracted: DataFrame, fill: bool = True) -> DataFrame:
    """One row per proposition of a chunk: ..., number, p_text, subject, predicate, object, object_is_literal.

    fill: an empty text is made of subject, predicate and object; offline extraction leaves that of an empty chunk empty.
    """
    each = extracted.select(*[c for c in extracted.columns if c != "propositions"], F.posexplode("propositions").alias("number", "p"))
    said = statement(F.col("p.text"), F.col("p.subject"), F.col("p.predicate"), F.col("p.object")) if fill else F.col("p.text")
    return each.select("*", said.alias("p_text"), "p.subject", "p.predicate", "p.object", "p.object_is_literal").drop("p")
