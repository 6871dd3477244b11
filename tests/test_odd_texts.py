"""Queries on pieces of odd texts against their SQL: blank lines, white space at the edges, empty and null texts."""

import duckdb
import pytest

import __spark_entry__ as registry
from weftgraph.operators import ingest

TEXTS = [
    "one\n\ntwo\n\n\nthree", "  led by spaces and ended by a line\n", "x" * 1190 + " \n\n " + "y" * 1500, "", None, " " * 1500, "\n\n\n", "é東\U0001f600" * 900,
    "a" * 1200, "b" * 1201, "c" * 2300, "d" * 2301, " wide ", " " + "e" * 5000 + "\n\n", "plain",
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def both(spark, at, name):
    """The rows of a query and of its SQL, sorted."""
    found = registry.queries()[name](spark, at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}/documents.parquet/*.parquet'")
    want = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    return sorted(map(repr, map(tuple, found.select(*names).collect()))), sorted(map(repr, want.fetchall()))


def test_cache_key(spark, odd):
    got, want = both(spark, odd, "cache_key")
    assert got == want


def test_chunk_documents(spark, odd):
    got, want = both(spark, odd, "chunk_documents")
    assert got == want
    assert ["('4'" in "".join(x) for x in both(spark, odd, "chunk_paragraphs")] == [False, False]  # a null text has no chunk


def test_offline_extract(spark, odd):
    got, want = both(spark, odd, "offline_extract")
    assert got == want
    # What a model leaves without a text is still named by its parts.
    said = spark.createDataFrame([("", "a", "b", "c")], "text string, subject string, predicate string, object string")
    each = said.selectExpr("array(named_struct('text', text, 'subject', subject, 'predicate', predicate, 'object', object, 'object_is_literal', true)) AS propositions")
    assert [ingest.statements(each, fill=f).first().p_text for f in (True, False)] == ["a b c", ""]


def test_chunks_mode_rows(spark, odd):
    got, want = both(spark, odd, "chunks_mode_rows")
    assert got == want
    got, want = both(spark, odd, "delete_cascade")
    assert got == want
