"""HTTP surface over a Memory: POST /memorize, /recall and /forget, GET /health. JSON in and out."""

from __future__ import annotations

import json
from dataclasses import asdict
from datetime import datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from weftgraph.memory import Memory

_RECALL = ("session_id", "k", "with_rerank", "with_mmr", "expand_graph")


class BadRequest(ValueError):
    pass


def _wanted(body: dict, name: str, kind: type, needed: bool = True):
    value = body.get(name)
    if value is None and not needed:
        return None
    if not isinstance(value, kind):
        raise BadRequest(f"{name}: {kind.__name__} expected")
    return value


def memorize(memory: Memory, body: dict) -> dict:
    at = _wanted(body, "asserted_at", str, False)
    return asdict(memory.ingest(
        _wanted(body, "text", str), source=_wanted(body, "source", str, False), session_id=_wanted(body, "session_id", str, False),
        asserted_at=datetime.fromisoformat(at) if at else None,
    ))


def recall(memory: Memory, body: dict) -> list[dict]:
    options = {c: body[c] for c in _RECALL if body.get(c) is not None}
    found = memory.recall(_wanted(body, "query", str), **options)
    names = ("proposition_id", "text", "score", "rrf_score", "source_kind", "chunk_id", "predicate", "asserted_at")
    return [{c: r[c] for c in names} | {"subject": None, "object": None} for r in found]


def forget(memory: Memory, body: dict) -> None:
    memory.forget(_wanted(body, "proposition_id", str), supersede_with=_wanted(body, "supersede_with", str, False))


def health(memory: Memory) -> dict:
    try:
        tables = memory.store.health()
        return {"status": "ok", "store": True, "tables": tables}
    except Exception as problem:  # the store is down, the server is not
        return {"status": "ok", "store": False, "problem": str(problem)[:200]}


def make_server(memory: Memory, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    routes = {"/memorize": memorize, "/recall": recall, "/forget": forget}

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, value: object = None) -> None:
            body = b"" if code == 204 else json.dumps(value, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def do_GET(self) -> None:
            self._send(200, health(memory)) if self.path == "/health" else self._send(404, {"error": "not found"})

        def do_POST(self) -> None:
            if self.path not in routes:
                return self._send(404, {"error": "not found"})
            try:
                body = json.loads(self.rfile.read(int(self.headers.get("Content-Length") or 0)) or b"{}")
                if not isinstance(body, dict):
                    raise BadRequest("an object expected")
                value = routes[self.path](memory, body)
            except (ValueError, TypeError) as problem:  # unreadable JSON and times are ValueErrors too
                return self._send(422, {"error": str(problem)})
            self._send(204) if value is None else self._send(200, value)

        def log_message(self, *_: object) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
