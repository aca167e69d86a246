"""Clients of model services over HTTP, with the standard library: one function from prompt to answer each."""

from __future__ import annotations

import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from quillon.operators import models

#: What a service that is asked too much, or is down for a moment, answers with.
PASSING = (408, 409, 425, 429, 500, 502, 503, 504)


@dataclass(frozen=True)
class Service:
    """How a service is asked: its address, headers from a key, the body of a request, and where in the reply the answer stands."""

    url: str
    model: str
    small: str
    variable: str
    headers: Callable[[str], dict[str, str]]
    body: Callable[[str, str, str, float, int], dict]
    answer: Callable[[dict], str]


def _bearer(key: str) -> dict[str, str]:
    return {"Authorization": f"Bearer {key}"} if key else {}


def _chat(model: str, system: str, prompt: str, heat: float, most: int) -> dict:
    told = [{"role": "system", "content": system}] if system else []
    return {"model": model, "messages": [*told, {"role": "user", "content": prompt}], "temperature": heat, "max_tokens": most}


def _first_choice(reply: dict) -> str:
    return reply["choices"][0]["message"]["content"] or ""


SERVICES: dict[str, Service] = {
    "openai": Service("https://api.openai.com/v1/chat/completions", "gpt-4o", "gpt-4o-mini", "OPENAI_API_KEY", _bearer, _chat, _first_choice),
    "deepseek": Service("https://api.deepseek.com/chat/completions", "deepseek-chat", "deepseek-chat", "DEEPSEEK_API_KEY", _bearer, _chat, _first_choice),
    "openrouter": Service("https://openrouter.ai/api/v1/chat/completions", "openai/gpt-4o", "openai/gpt-4o-mini", "OPENROUTER_API_KEY", _bearer, _chat, _first_choice),
    "anthropic": Service(
        "https://api.anthropic.com/v1/messages", "claude-3-5-sonnet-latest", "claude-3-5-haiku-latest", "ANTHROPIC_API_KEY", lambda key: {"x-api-key": key, "anthropic-version": "2023-06-01"},
        lambda model, system, prompt, heat, most: {"model": model, "max_tokens": most, "temperature": heat, "messages": [{"role": "user", "content": prompt}]} | ({"system": system} if system else {}),
        lambda reply: "".join(part.get("text", "") for part in reply["content"]),
    ),
    "gemini": Service(
        "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "gemini-1.5-pro", "gemini-1.5-flash", "GEMINI_API_KEY", lambda key: {"x-goog-api-key": key},
        lambda model, system, prompt, heat, most: {"contents": [{"parts": [{"text": f"{system}\n\n{prompt}" if system else prompt}]}], "generationConfig": {"temperature": heat, "maxOutputTokens": most}},
        lambda reply: "".join(part.get("text", "") for part in reply["candidates"][0]["content"]["parts"]),
    ),
    "ollama": Service(
        "http://localhost:11434/api/chat", "qwen2.5:14b", "qwen2.5:14b", "", _bearer,
        lambda model, system, prompt, heat, most: {"model": model, "stream": False, "messages": _chat(model, system, prompt, heat, most)["messages"], "options": {"temperature": heat, "num_predict": most}},
        lambda reply: reply["message"]["content"],
    ),
}


def asked(service: Service, prompt: str, key: str = "", model: str = "", url: str = "", system: str = "", heat: float = 0.2, most: int = 2000, seconds: float = 120, tries: int = 3, wait: float = 1.0) -> str:
    """The answer to one prompt. Passing errors are tried again after growing pauses; others, and the last one, are raised."""
    address = (url or service.url).replace("{model}", model or service.model)
    data = json.dumps(service.body(model or service.model, system, prompt, heat, most)).encode()
    for n in range(tries):
        request = urllib.request.Request(address, data, {"Content-Type": "application/json", **service.headers(key)})
        try:
            with urllib.request.urlopen(request, timeout=seconds) as reply:
                return service.answer(json.loads(reply.read()))
        except urllib.error.HTTPError as problem:
            if problem.code not in PASSING or n + 1 == tries:
                raise
        except (urllib.error.URLError, TimeoutError):
            if n + 1 == tries:
                raise
        time.sleep(wait * 2**n)
    raise RuntimeError("not asked")


def connect(name: str, key: str | None = None, model: str = "", url: str = "", **calls) -> None:
    """Register a service under its name, and its smaller model under ``NAME-small``; without a key, that of the service's usual variable on the driver."""
    service = SERVICES[name]
    held = os.environ.get(service.variable, "") if key is None and service.variable else key or ""
    for registered, chosen in ((name, model or service.model), (f"{name}-small", service.small)):
        models.register(registered, lambda chosen=chosen: lambda prompt: asked(service, prompt, held, chosen, url, tries=1, **calls))
