"""Settings in layers: defaults, a file, the environment, flags; unknown paths and wrong types are all reported at once."""

from __future__ import annotations

import copy
import json

#: Defaults (fixed values).
DEFAULTS = {
    "ingestion": {"loader": "pdfjs", "cleaners": ["unicode", "page-numbers", "headers-footers", "dehyphenate"]},
    "chunking": {"strategy": "recursive", "tokenizer": "approx", "maxTokens": 400, "overlapTokens": 60},
    "embedding": {"provider": "ollama", "model": "all-minilm", "batchSize": 32},
    "vectorStore": {"type": "in-memory", "path": "data/index"},
    "retrieval": {"strategy": "hybrid", "k": 5, "fusion": "rrf"},
    "rerank": {"enabled": False, "type": "llm", "candidates": 20, "concurrency": 4},
    "pricing": {"currency": "USD"},
    "resilience": {"retries": 2, "backoffMs": 500, "maxBackoffMs": 8000, "llmTimeoutMs": 120000, "embedderTimeoutMs": 60000},
    "queryTransform": {"rewrite": True, "historyTurns": 4, "hyde": False, "multiQuery": False, "variants": 3},
    "generation": {"temperature": 0.2, "maxOutputTokens": 1024, "contextBudgetTokens": 3000, "ordering": "sandwich"},
    "judge": {"maxOutputTokens": 700},
    "grounding": {"minScore": 0.0},
}


def _typed(text: str, like):
    if isinstance(like, bool):
        if text.lower() not in ("true", "false", "1", "0"):
            raise ValueError(f"{text!r} is no boolean")
        return text.lower() in ("true", "1")
    if isinstance(like, list):
        return json.loads(text) if text.startswith("[") else [x.strip() for x in text.split(",")]
    return type(like)(text)


def load(file: dict | None = None, env: dict[str, str] | None = None, flags: dict[str, str] | None = None) -> dict:
    out, problems = copy.deepcopy(DEFAULTS), []

    def put(section: str, key: str, value, source: str, text: bool) -> None:
        flat = lambda n: n.replace("_", "").lower()  # noqa: E731  MAX_TOKENS, MAXTOKENS and maxTokens are one name
        known = next((s for s in out if flat(s) == flat(section)), None)
        name = next((k for k in out.get(known, {}) if flat(k) == flat(key)), None)
        if name is None:
            problems.append(f"{source}: unknown setting {section}.{key}")
            return
        try:
            value = _typed(value, out[known][name]) if text else value
        except ValueError as e:
            problems.append(f"{source}: {section}.{key}: {e}")
            return
        if not text and isinstance(value, bool) != isinstance(out[known][name], bool):
            problems.append(f"{source}: {section}.{key}: wrong type")
            return
        out[known][name] = value

    for section, values in (file or {}).items():
        for key, value in values.items():
            put(section, key, value, "file", False)
    for name, value in (env or {}).items():
        if name.startswith("RAG_") and "__" in name:
            put(*name[4:].split("__", 1), value, "environment", True)
    for name, value in (flags or {}).items():
        put(*name.lstrip("-").split(".", 1), value, "flag", True)
    if out["chunking"]["overlapTokens"] >= out["chunking"]["maxTokens"]:
        problems.append("chunking: the overlap must be smaller than the size")
    if out["resilience"]["maxBackoffMs"] < out["resilience"]["backoffMs"]:
        problems.append("resilience: the longest wait must not be shorter than the first")
    if out["rerank"]["enabled"] and out["rerank"]["candidates"] < out["retrieval"]["k"]:
        problems.append("rerank: fewer candidates than k")
    if problems:
        raise ValueError("; ".join(problems))
    return out
