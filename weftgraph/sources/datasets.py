"""Conversation question-answering datasets as relations, and result sinks."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.text import iso_timestamp

_TURNS = "namespace string, ordinal int, session_id string, turn int, speaker string, text string, stamp string, session_stamp string"
_QUESTIONS = "question_id string, namespace string, question string, answer string, category string"


def fetch(url: str, path: str) -> str:
    """path, downloaded from url unless it is there already."""
    if not os.path.exists(path):
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        urllib.request.urlretrieve(url, path + ".part")
        os.replace(path + ".part", path)
    return path


def _records(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(item, record): the records of a JSON file, as JSON, in order. The file is a list of them, an object that holds such
    a list or object under a known name, or an object of them."""
    text = spark.read.text(path, wholetext=True)
    whole = F.coalesce(*[F.get_json_object("value", f"$.{name}") for name in ("conversations", "data", "rows")], F.trim("value"))
    several = F.when(whole.startswith("["), F.from_json(whole, "array<string>")).otherwise(F.map_values(F.from_json(whole, "map<string,string>")))
    found = text.select(F.posexplode(several).alias("item", "record")).filter("record LIKE '{%'")
    return found if limit is None else found.filter(F.col("item") < limit)


def _first(x: dict, *names: str) -> object:
    """The first of the named values that is neither absent nor empty."""
    return next((x[n] for n in names if x.get(n)), None)


def _text(x: object) -> str | None:
    return None if x is None else x if isinstance(x, str) else json.dumps(x) if isinstance(x, (dict, list)) else str(x)


def _sessions(record: dict, *names: str) -> list:
    """Sessions in order; an object of sessions counts by its values."""
    found = _first(record, *names)
    return found if isinstance(found, list) else list(found.values()) if isinstance(found, dict) else []


def _said(session: object) -> list[dict]:
    """Turns of a session that is a list of them or an object that holds one."""
    if isinstance(session, dict):
        session = _first(session, "conversation", "messages", "turns")
    return [t for t in session if isinstance(t, dict)] if isinstance(session, list) else []


def _turn_rows(namespace: str, sessions: list, ids: list, stamps: list, speaker: str) -> Iterator[tuple]:
    for ordinal, session in enumerate(sessions):
        name = ids[ordinal] if ordinal < len(ids) else f"sess-{ordinal}"
        stamp = stamps[ordinal] if ordinal < len(stamps) else None
        for n, t in enumerate(_said(session)):
            said = _text(_first(t, "text", "content"))
            if said and said.strip():
                own = _first(t, "timestamp", "date", "time")
                yield namespace, ordinal, str(name), n, _text(_first(t, "speaker", "role")) or speaker, said, _text(own), _text(stamp)


def _dialogue_turns(item: int, record: dict, prefix: str) -> Iterator[tuple]:
    sessions = _sessions(record, "sessions", "conversation", "dialogues")
    rows = list(_turn_rows(f"{prefix}-{item}", sessions, [], [], "speaker"))
    # A conversation without sessions is one session itself.
    yield from rows or _turn_rows(f"{prefix}-{item}", [record.get("conversation")], [], [], "speaker")


def _dialogue_questions(item: int, record: dict, prefix: str) -> Iterator[tuple]:
    for n, x in enumerate(_first(record, "qa", "questions", "qas") or []):
        if isinstance(x, dict) and (question := _text(_first(x, "question", "q"))):
            answer, category = _text(_first(x, "answer", "a")) or "", _text(_first(x, "category", "type")) or "general"
            yield f"{prefix}-{item}-qa-{n}", f"{prefix}-{item}", question, answer, category


def _haystack_name(item: int, record: dict) -> str:
    return _text(_first(record, "question_id", "id")) or str(item)


def _haystack_turns(item: int, record: dict, prefix: str) -> Iterator[tuple]:
    if record.get("question"):
        sessions = _sessions(record, "haystack_sessions")
        stamps = _first(record, "haystack_dates", "haystack_session_timestamps") or []
        stamps = [*stamps, *[record.get("session_timestamp")] * (len(sessions) - len(stamps))]
        yield from _turn_rows(f"{prefix}-{_haystack_name(item, record)}", sessions, record.get("haystack_session_ids") or [], stamps, "user")


def _haystack_questions(item: int, record: dict, prefix: str) -> Iterator[tuple]:
    if question := _text(record.get("question")):
        name = _haystack_name(item, record)
        yield f"{name}-q0", f"{prefix}-{name}", question, _text(record.get("answer")) or "", _text(record.get("question_type")) or "general"


def _unfolded(records: DataFrame, rows_of: Callable[[int, dict, str], Iterator[tuple]], prefix: str, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = [pa.int32() if f.endswith(" int") else pa.string() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r for item, record in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows_of(item, json.loads(record), prefix)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return records.mapInArrow(run, schema)


def _loaded(spark: SparkSession, path: str, prefix: str, limit: int | None, turns: Callable, questions: Callable) -> tuple[DataFrame, DataFrame]:
    records = _records(spark, path, limit)
    said = _unfolded(records, turns, prefix, _TURNS).withColumn("asserted_at", F.coalesce(iso_timestamp(F.col("stamp")), iso_timestamp(F.col("session_stamp"))))
    return said.drop("stamp", "session_stamp"), _unfolded(records, questions, prefix, _QUESTIONS)


def load_dialogues(spark: SparkSession, path: str, prefix: str = "locomo", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of dialogues, each with sessions of turns and questions; limit: so many dialogues."""
    return _loaded(spark, path, prefix, limit, _dialogue_turns, _dialogue_questions)


def load_haystacks(spark: SparkSession, path: str, prefix: str = "lme", limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(turns, questions) of a file of questions, each with its own sessions and parallel lists of their ids and dates."""
    return _loaded(spark, path, prefix, limit, _haystack_turns, _haystack_questions)


def transcripts(turns: DataFrame) -> DataFrame:
    """(namespace, session_id, turns, text, asserted_at): what was said in each session, one line a turn, in order; the
    time is the first one that is known. turns: namespace, ordinal, session_id, turn, speaker, text, asserted_at."""
    line = F.concat("speaker", F.lit(": "), "text")
    said = turns.filter(F.length(F.trim("text")) > 0).groupBy("namespace", "ordinal", "session_id")
    said = said.agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line"), "asserted_at"))).alias("t"))
    times = F.filter(F.transform("t", lambda x: x["asserted_at"]), lambda x: x.isNotNull())
    return said.select("namespace", "session_id", F.size("t").alias("turns"), F.array_join("t.line", "\n").alias("text"), F.get(times, F.lit(0)).alias("asserted_at"))


def write_records(df: DataFrame, path: str) -> None:
    """One JSON record a line."""
    df.write.mode("append").json(path)
