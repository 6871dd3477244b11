"""python -m weftgraph.cli --root PATH migrate | serve | ingest PATH | recall QUERY | forget ID | health | bench {locomo,longmemeval} PATH"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from weftgraph.memory import Memory, MemoryConfig
from weftgraph.sources.store import Store


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--root", required=True)
    p.add_argument("--namespace", default="default")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("migrate")
    sub.add_parser("health")
    s = sub.add_parser("serve")
    s.add_argument("--host", default="0.0.0.0")
    s.add_argument("--port", type=int, default=8000)
    i = sub.add_parser("ingest")
    i.add_argument("path")
    i.add_argument("--chunks-only", action="store_true")
    r = sub.add_parser("recall")
    r.add_argument("query")
    r.add_argument("--k", type=int, default=10)
    f = sub.add_parser("forget")
    f.add_argument("id")
    f.add_argument("--with", dest="replacement")
    b = sub.add_parser("bench")
    b.add_argument("dataset", choices=("locomo", "longmemeval"))
    b.add_argument("path")
    b.add_argument("--output", required=True)
    b.add_argument("--limit", type=int)
    b.add_argument("--k", type=int, default=20)
    b.add_argument("--model", help="answerer and judge behind an OpenAI-style endpoint; without it a dry run")
    b.add_argument("--base-url", default="https://api.openai.com/v1")
    b.add_argument("--key", help="environment variable with the API key")
    b.add_argument("--chunks-only", action="store_true")
    for name in ("rerank", "mmr", "graph-expansion"):
        b.add_argument(f"--no-{name}", action="store_true")
    return p


def _bench(a: argparse.Namespace, memory: Memory) -> dict:
    from weftgraph.benchmark import BenchConfig, run_bench
    from weftgraph.providers import chat_model
    from weftgraph.sources import datasets

    load = datasets.load_dialogues if a.dataset == "locomo" else datasets.load_haystacks
    turns, questions = load(memory.spark, a.path, limit=a.limit)
    chat = chat_model(a.model, base_url=a.base_url, key=a.key) if a.model else None
    config = BenchConfig(a.dataset, k=a.k, with_rerank=not a.no_rerank, with_mmr=not a.no_mmr, expand_graph=not a.no_graph_expansion, dry_run=chat is None)
    return run_bench(memory, turns, questions, config, a.output, answerer=chat, judge=chat)


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, a.root)
    if a.command == "migrate":
        print(json.dumps(store.migrate()))
        return
    memory = Memory(store, MemoryConfig(namespace=a.namespace, extract_propositions=not getattr(a, "chunks_only", False)))
    if a.command == "ingest":
        text = sys.stdin.read() if a.path == "-" else open(a.path).read()
        print(json.dumps(memory.ingest(text, source=a.path).__dict__))
    elif a.command == "recall":
        print(json.dumps([x.asDict() for x in memory.recall(a.query, k=a.k)], default=str))
    elif a.command == "forget":
        memory.forget(a.id, supersede_with=a.replacement)
    elif a.command == "health":
        print(json.dumps(store.health()))
    elif a.command == "bench":
        print(json.dumps(_bench(a, memory)))
    elif a.command == "serve":
        from weftgraph.server import make_server

        make_server(memory, a.host, a.port).serve_forever()


if __name__ == "__main__":
    main()
