"""Text analysis and string functions as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.stemmer import STOP_WORDS, stem

PROMPT_VERSION = "v1"
#: Words are runs of letters and digits of any script.
TOKEN = r"[\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
#: Texts whose words a worker holds as objects at once.
SLICE = 64


def english_lexemes(text: str | None) -> list[str]:
    """Lower-cased, stop words dropped, stemmed; duplicates and order stay."""
    return [stem(w) for w in _WORD.findall((text or "").lower()) if w not in STOP_WORDS]


def _english(texts: pa.Array) -> pa.Array:
    """english_lexemes of each text; the words of few texts at a time are objects, the others are in Arrow's buffers."""
    kind = pa.list_(pa.string())
    parts = [pa.array([english_lexemes(x) for x in texts.slice(at, SLICE).to_pylist()], kind) for at in range(0, len(texts), SLICE)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def lexemes(text: Column, analyzer: str = "simple") -> Column:
    """Lexemes of a text in order. "simple" stays in the JVM; "english" drops stop words and stems."""
    if analyzer == "english":
        return F.arrow_udf(_english, "array<string>")(text)
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def counted(words: Column) -> Column:
    """(lexeme, tf) of each distinct word of an array: the runs of the sorted words, without leaving the row."""

    def runs(s: Column) -> Column:
        last = F.size(s) - 1
        heads = F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (i <= last) & ((i == 0) | (F.get(s, i) != F.get(s, i - 1))))
        each = F.transform(F.array(heads), lambda h: F.transform(h, lambda i, k: F.struct(F.get(s, i).alias("lexeme"), (F.coalesce(F.get(h, k + 1), last + 1) - i).cast("long").alias("tf"))))
        return F.get(each, F.lit(0))

    # Arrays of one element give a name to what is used more than once.
    return F.get(F.transform(F.array(F.array_sort(words)), runs), F.lit(0))


def trigrams(text: Column) -> Column:
    """Distinct trigrams: words lower-cased, two spaces before and one after each."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams; a and b are trigram arrays."""
    every = F.size(F.array_union(a, b))
    return F.when(every > 0, F.size(F.array_intersect(a, b)) / every).otherwise(F.lit(0.0))


def normalised_answer(text: Column) -> Column:
    """Lower case without punctuation, for exact match."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""))


def exact_match(prediction: Column, gold: Column) -> Column:
    """Either normalised text holds the other."""
    p, g = normalised_answer(prediction), normalised_answer(gold)
    return F.contains(p, g) | F.contains(g, p)


def cache_key(chunk: Column, model: Column | str, version: str = PROMPT_VERSION) -> Column:
    model = F.lit(model) if isinstance(model, str) else model
    mark = F.lit("\x9f")
    return F.sha2(F.concat(chunk, mark, model, mark, F.lit(version)), 256)


def chunk_hash(chunk: Column) -> Column:
    return F.sha2(chunk, 256)


def statement(text: Column, subject: Column, predicate: Column, obj: Column) -> Column:
    """text, or subject, predicate and object in its place when it is empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.trim(F.concat_ws(" ", subject, predicate, obj))).otherwise(text)


def turn_text(speaker: Column, text: Column) -> Column:
    return F.concat(speaker, F.lit(": "), text)


def iso_timestamp(text: Column) -> Column:
    """ISO 8601 to timestamp; a time without a zone is in UTC, whatever the session's zone; unreadable text gives null."""
    plain = F.regexp_replace(F.trim(text), "[Zz]$", "+00:00")
    timed, zoned = plain.rlike(r"\d:\d\d"), plain.rlike(r"\d:\d\d.*[+-]\d\d(:?\d\d)?$")
    return F.try_to_timestamp(F.when(zoned, plain).when(timed, F.concat(plain, F.lit("+00:00"))).otherwise(F.concat(plain, F.lit("T00:00:00+00:00"))))
