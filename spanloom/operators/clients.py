"""HTTP clients of the three named backends, on the standard library alone. Importing this module registers them.

Keys come from the environment, after ``load_env`` from a file of NAME=value lines if one is there.
"""

from __future__ import annotations

import json
import os
import urllib.request
from pathlib import Path

from spanloom.operators.generation import MAX_TOKENS, TEMPERATURE, register_backend


def load_env(path: str | Path) -> bool:
    """Set variables from an environment file given by its absolute path, without replacing any; False if there is no such file."""
    file = Path(path)
    if not file.is_absolute():
        raise ValueError("give the file's absolute path")
    if not file.is_file():
        return False
    for line in file.read_text(encoding="utf-8").splitlines():
        name, found, value = line.strip().partition("=")
        if found and name and not name.startswith("#"):
            os.environ.setdefault(name.strip(), value.strip().strip("\"'"))
    return True


def _post(url: str, body: dict, headers: dict[str, str], timeout: float = 120.0) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.loads(reply.read())
    except urllib.error.HTTPError as e:
        raise RuntimeError(f"{e.code} {e.reason}: {e.read()[:300]!r}") from e


def _key(name: str) -> str:
    if not (key := os.environ.get(name)):
        raise RuntimeError(f"{name} is not set")
    return key


def ollama(model: str = "llama3.2:3b", temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS):
    def call(prompt: str, system: str | None) -> str:
        body = {"model": model, "prompt": prompt, "stream": False, "options": {"temperature": temperature, "num_predict": max_tokens}}
        return _post(os.environ.get("OLLAMA_HOST", "http://127.0.0.1:11434") + "/api/generate", body | ({"system": system} if system else {}), {})["response"]

    return call


def gemini(model: str = "gemini-3.1-flash-lite", temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS):
    def call(prompt: str, system: str | None) -> str:
        body: dict = {"contents": [{"parts": [{"text": prompt}]}], "generationConfig": {"temperature": temperature, "maxOutputTokens": max_tokens}}
        if system:
            body["systemInstruction"] = {"parts": [{"text": system}]}
        got = _post(f"https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", body, {"x-goog-api-key": _key("GEMINI_API_KEY")})
        return "".join(p.get("text", "") for p in got["candidates"][0]["content"].get("parts", []))

    return call


def groq(model: str = "openai/gpt-oss-120b", temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS, reasoning_effort: str | None = None):
    def call(prompt: str, system: str | None) -> str:
        messages = [*([{"role": "system", "content": system}] if system else []), {"role": "user", "content": prompt}]
        body = {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens}
        if reasoning_effort and "gpt-oss" in model:
            body["reasoning_effort"] = reasoning_effort
        return _post("https://api.groq.com/openai/v1/chat/completions", body, {"Authorization": f"Bearer {_key('GROQ_API_KEY')}"})["choices"][0]["message"]["content"]

    return call


register_backend("ollama", "llama3.2:3b", ollama)
register_backend("gemini", "gemini-3.1-flash-lite", gemini)
register_backend("groq", "openai/gpt-oss-120b", groq)
