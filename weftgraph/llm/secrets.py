"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, embedded checksums.

One pass of an Aho-Corasick automaton over the lower-cased bytes finds keyword hits; only at a hit is the kind's
pattern tried, anchored at the keyword. Hex runs have no keyword: a byte-class table and one substring search decide
whether a text holds 24 hex digits in a row, and only then is the pattern run.

Base kinds: ``assign``, ``access`` and ``hex`` (see ``BASE``). The method adds ``github`` and ``npm`` tokens, whose
last six base-62 digits must be the CRC-32 of what precedes them.

Cases: a null or empty text has no spans; a null id stays null; repeated rows each give a row; other columns, whatever
their names, are ignored; an empty table gives no rows; a text is scanned whole whatever its length.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from weftgraph.llm.common import as_bytes, batches, code_point_offsets, join_spans, sliced, with_text

BASE = ("assign", "access", "hex")
_ASSIGN = re.compile(
    rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE
)
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_HEX_CLASS = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_CHECKED = {"github": re.compile(rb"(gh[pousr])_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), "npm": re.compile(rb"(npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")}
_KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in _KEYWORDS.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def base62(value: int, width: int) -> bytes:
    out = bytearray()
    while value:
        value, r = divmod(value, 62)
        out.append(_DIGITS[r])
    return bytes(out[::-1]).rjust(width, b"0")


def checksum_holds(secret: bytes) -> bool:
    """The last six of the 36 characters are the base-62 CRC-32 of the first thirty."""
    return base62(zlib.crc32(secret[:-6]), 6) == secret[-6:]


def find_spans(raw: bytes) -> list[tuple[str, int, int]]:
    """(kind, byte start, byte end) of every accepted span; matches that fail a rule still consume their text."""
    found: list[tuple[str, int, int]] = []
    free = dict.fromkeys(_KEYWORDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(raw.lower().decode("latin-1")))
    for start, kind in hits:
        if start < free[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(raw, start):
                free[kind] = m.end()
                if m.end(2) - m.start(2) >= 6:
                    found.append((kind, start, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(raw, start):
                free[kind] = m.end()
                if m.end() - start >= 20:
                    found.append((kind, start, m.end()))
        elif (m := _CHECKED[kind].match(raw, start)) and checksum_holds(m[2]):
            free[kind] = m.end()
            found.append((kind, start, m.end()))
    if b"\x01" * 24 in raw.translate(_HEX_CLASS):
        found += [("hex", m.start(), m.end()) for m in _HEX.finditer(raw)]
    return found


def _scan(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*BASE, *_CHECKED))}
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string())])
    for b in sliced(batch_iter):
        rows: dict[str, list] = {f.name: [] for f in schema}
        for doc_id, raw in zip(b.column("doc_id").to_pylist(), as_bytes(b.column("text")), strict=True):
            spans = find_spans(raw)
            if spans:
                cp = code_point_offsets(raw, [x for _, s, e in spans for x in (s, e)])
                spans = [(k, cp[2 * i], cp[2 * i + 1]) for i, (k, _, _) in enumerate(spans)]
                spans.sort(key=lambda x: (x[1], order[x[0]]))
            base = [x for x in spans if x[0] in BASE]
            rows["doc_id"].append(doc_id)
            for k in BASE:
                rows[f"n_{k}"].append(sum(x[0] == k for x in base))
            rows["base_sha256"].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
            rows["spans"].append(join_spans(spans))
        yield batches(rows, schema)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of the base spans, and all spans."""
    return with_text(df, id_col, text_col).mapInArrow(_scan, SCHEMA)
