"""Chat models over HTTP, and what is asked of them: extraction, answers and grades. All are optional hooks."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Sequence

from weftgraph.operators.ingest import MAX_PROPOSITIONS, Extractor, parse_propositions

Chat = Callable[[str, str], str]  # (system prompt, prompt) -> answer

EXTRACT = (
    "List the facts of the text as JSON: {{\"propositions\": [{{\"text\": ..., \"subject\": ..., \"predicate\": ..., \"object\": ..., "
    "\"object_is_literal\": true or false}}]}}. At most {limit} facts, each understandable by itself; an object that is a number, date or "
    "phrase rather than a thing with a name is literal. JSON only."
)
UNKNOWN = "I don't know"


def chat_model(model: str, *, base_url: str = "https://api.openai.com/v1", key: str | None = None, timeout: float = 120.0) -> Chat:
    """A model behind an OpenAI-style chat endpoint; key: name of the environment variable that holds the API key."""

    def ask(system: str, prompt: str) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {os.environ[key]}"} if key else {})
        body = json.dumps({"model": model, "messages": messages}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{base_url}/chat/completions", body, headers), timeout=timeout) as answer:
            return json.load(answer)["choices"][0]["message"]["content"]

    return ask


def ollama_model(model: str, *, base_url: str = "http://localhost:11434", timeout: float = 120.0) -> Chat:
    def ask(system: str, prompt: str) -> str:
        messages = [{"role": "system", "content": system}] * bool(system) + [{"role": "user", "content": prompt}]
        body = json.dumps({"model": model, "messages": messages, "stream": False}).encode()
        with urllib.request.urlopen(urllib.request.Request(f"{base_url}/api/chat", body, {"Content-Type": "application/json"}), timeout=timeout) as answer:
            return json.load(answer)["message"]["content"]

    return ask


def extractor(chat: Chat, limit: int = MAX_PROPOSITIONS) -> Extractor:
    """The extraction hook of Memory over a chat model."""

    def run(texts: list[str]) -> list[list[dict]]:
        return [parse_propositions(chat(EXTRACT.format(limit=limit), t))[:limit] for t in texts]

    return run


def answer_prompt(question: str, facts: Sequence[str]) -> str:
    listed = "\n".join(f"- {f}" for f in facts)
    return f"Facts:\n{listed}\n\nQuestion: {question}\n\nAnswer from these facts only. If they do not hold the answer, say '{UNKNOWN}'."


def judge_prompt(question: str, gold: str, predicted: str) -> str:
    return (
        f"Question: {question}\nRight answer: {gold}\nGiven answer: {predicted}\n\n"
        'Does the given answer say the same? Wording does not matter. JSON only: {"correct": true or false, "reasoning": "..."}'
    )


def parse_grade(answer: str) -> tuple[bool, str]:
    """(correct, reasoning) of a judge's answer; unreadable ones count as wrong."""
    decoder, at = json.JSONDecoder(), answer.find("{")
    while at >= 0:
        try:
            grade = decoder.raw_decode(answer, at)[0]
            if "correct" in grade:
                return bool(grade["correct"]), str(grade.get("reasoning", ""))
        except json.JSONDecodeError:
            pass
        at = answer.find("{", at + 1)
    return False, f"parse error: {answer[:100]}"
