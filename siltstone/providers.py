"""Embedding and language models behind HTTP, in the two public dialects, and how they are configured.

A dialect says where requests go, what they hold and where the answer lies; one client serves both.
Keys are sent, never shown: they stand in no error, representation or log.
"""

from __future__ import annotations

import json
import math
import os
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol
from urllib.parse import urlsplit

from siltstone.operators.embed import InputTooLong, TransientError

DIALECTS = ("ollama", "openai")
LOCAL = "http://localhost:11434"


class ProviderError(RuntimeError):
    """A provider's answer cannot be used."""


@dataclass(frozen=True)
class Request:
    prompt: str
    system: str | None = None
    temperature: float = 0.0
    most_tokens: int | None = None
    as_json: bool = False

    def __post_init__(self):
        if not self.prompt.strip():
            raise ValueError("the prompt is blank")
        if isinstance(self.temperature, bool) or self.temperature < 0:
            raise ValueError("the temperature must not be negative")
        if self.most_tokens is not None and (isinstance(self.most_tokens, bool) or self.most_tokens < 1):
            raise ValueError("the most tokens must be a positive number")


@dataclass(frozen=True)
class Reply:
    text: str
    model: str
    provider: str
    finish_reason: str | None = None


class LLMProvider(Protocol):
    def generate(self, request: Request) -> Reply: ...


def checked_url(url: str) -> str:
    """An absolute HTTP address without credentials, query or fragment, and without a slash at its end."""
    p = urlsplit(url.strip().rstrip("/"))
    if p.scheme not in ("http", "https") or not p.netloc or p.username or p.password or p.query or p.fragment:
        raise ValueError("the base address must be a plain http(s) URL")
    return url.strip().rstrip("/")


@dataclass
class Client:
    """POSTs JSON to one server; failures worth another try are TransientError."""

    endpoint: str
    key: str | None = field(default=None, repr=False)
    seconds: float = 60.0

    def __post_init__(self):
        self.endpoint = checked_url(self.endpoint)
        if self.seconds <= 0:
            raise ValueError("the timeout must be positive")

    def post(self, path: str, body: dict) -> dict:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        asked = urllib.request.Request(f"{self.endpoint}/{path}", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(asked, timeout=self.seconds) as answer:
                got = json.loads(answer.read())
        except urllib.error.HTTPError as bad:
            said = bad.read(2000).decode("utf-8", "replace").lower()
            if bad.code == 429 or bad.code >= 500:
                raise TransientError(f"HTTP {bad.code}") from None
            if bad.code == 400 and "context length" in said:
                raise InputTooLong(f"HTTP {bad.code}") from None
            raise ProviderError(f"HTTP {bad.code}") from None
        except OSError as bad:  # timeouts and lost connections
            raise TransientError(type(bad).__name__) from None
        except ValueError:
            raise ProviderError("the answer is no JSON") from None
        if not isinstance(got, dict):
            raise ProviderError("the answer is no JSON object")
        return got


def _by_index(rows: Any, count: int) -> list:
    """Vectors in the order of their ``index``; each has to be there once."""
    if not isinstance(rows, list) or sorted(r.get("index", k) if isinstance(r, dict) else -1 for k, r in enumerate(rows)) != list(range(count)):
        raise ProviderError("the answer does not hold each vector once")
    return [r.get("embedding") for r in sorted(rows, key=lambda r: r.get("index", rows.index(r)))]


#: path, body and reader of embeddings, by dialect.
EMBEDDINGS: dict[str, tuple[str, Callable, Callable]] = {
    "ollama": ("api/embed", lambda model, texts: {"model": model, "input": texts, "truncate": False}, lambda got, n: got.get("embeddings")),
    "openai": ("embeddings", lambda model, texts: {"model": model, "input": texts, "encoding_format": "float"}, lambda got, n: _by_index(got.get("data"), n)),
}


def _chat(model: str, r: Request) -> dict:
    messages = ([{"role": "system", "content": r.system}] if r.system is not None else []) + [{"role": "user", "content": r.prompt}]
    more = ({"max_tokens": r.most_tokens} if r.most_tokens else {}) | ({"response_format": {"type": "json_object"}} if r.as_json else {})
    return {"model": model, "messages": messages, "temperature": float(r.temperature)} | more


def _plain(model: str, r: Request) -> dict:
    options = {"temperature": float(r.temperature)} | ({"num_predict": r.most_tokens} if r.most_tokens else {})
    more = ({"system": r.system} if r.system is not None else {}) | ({"format": "json"} if r.as_json else {})
    return {"model": model, "prompt": r.prompt, "stream": False, "options": options} | more


def _choice(got: dict) -> tuple[Any, Any]:
    first = (got.get("choices") or [{}])[0]
    return (first.get("message") or {}).get("content"), first.get("finish_reason")


TEXTS: dict[str, tuple[str, Callable, Callable]] = {
    "ollama": ("api/generate", _plain, lambda got: (got.get("response"), got.get("done_reason"))),
    "openai": ("chat/completions", _chat, _choice),
}


class HttpEmbedder:
    """An embedding provider; its size is that of the first answer, if none is given."""

    def __init__(self, dialect: str, model: str, client: Client, dimensions: int | None = None):
        self.dialect, self.model, self.client, self.endpoint = dialect, model, client, client.endpoint
        self._dimensions = dimensions

    @property
    def dimensions(self) -> int:
        if self._dimensions is None:
            self._dimensions = len(self.embed_texts(["size"])[0])
        return self._dimensions

    def embed_text(self, text: str) -> list[float]:
        return self.embed_texts([text])[0]

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        """Vectors in the order of the texts."""
        if not texts:
            return []
        if any(not isinstance(t, str) or not t for t in texts):
            raise ValueError("an embedding text is empty")
        path, body, read = EMBEDDINGS[self.dialect]
        got = read(self.client.post(path, body(self.model, list(texts))), len(texts))
        if not isinstance(got, list) or len(got) != len(texts):
            raise ProviderError("the answer holds another number of vectors")
        sizes = {len(v) if isinstance(v, list) else 0 for v in got}
        if len(sizes) != 1 or 0 in sizes or self._dimensions not in (None, *sizes):
            raise ProviderError("the vectors have another size")
        if any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for v in got for x in v):
            raise ProviderError("a vector holds something that is no number")
        return [[float(x) for x in v] for v in got]


class HttpWriter:
    """A language model; also callable with (system, prompt), as the engine calls it."""

    def __init__(self, dialect: str, model: str, client: Client):
        self.dialect, self.model, self.client = dialect, model, client

    def generate(self, request: Request) -> Reply:
        path, body, read = TEXTS[self.dialect]
        got = self.client.post(path, body(self.model, request))
        text, reason = read(got)
        if not isinstance(text, str) or not text.strip():
            raise ProviderError("the answer holds no text")
        model = got.get("model")
        return Reply(text, model if isinstance(model, str) else self.model, self.dialect, reason if isinstance(reason, str) else None)

    def __call__(self, system: str, prompt: str) -> str:
        return self.generate(Request(prompt, system)).text


@dataclass(frozen=True)
class Config:
    """Explicit values first, then the environment (SILTSTONE_...), then defaults."""

    dialect: str = "ollama"
    endpoint: str | None = None
    key: str | None = field(default=None, repr=False)
    embedding_model: str | None = None
    llm_model: str | None = None
    seconds: float = 60.0
    dimensions: int | None = None

    @classmethod
    def read(cls, environment: Mapping[str, str] | None = None, **given) -> Config:
        kinds = {"seconds": float, "dimensions": int}
        values = os.environ if environment is None else environment
        found = {}
        for name in cls.__dataclass_fields__:
            raw = values.get(f"SILTSTONE_{name.upper()}") or None
            if given.get(name) is not None:
                found[name] = given[name]
            elif raw is not None:
                try:
                    found[name] = kinds.get(name, str)(raw)
                except ValueError:
                    raise ValueError(f"SILTSTONE_{name.upper()} must be a number") from None
        return cls(**found)

    def _client(self) -> Client:
        if self.dialect not in DIALECTS:
            raise ValueError(f"the dialect must be one of {DIALECTS}")
        if not self.endpoint and self.dialect != "ollama":
            raise ValueError("this dialect needs an endpoint")
        return Client(self.endpoint or LOCAL, self.key, self.seconds)

    def embedder(self) -> HttpEmbedder:
        if self.dimensions is not None and self.dimensions < 1:
            raise ValueError("the dimensions must be positive")
        client = self._client()
        if not (self.embedding_model or "").strip():
            raise ValueError("no embedding model is named")
        return HttpEmbedder(self.dialect, self.embedding_model, client, self.dimensions)

    def writer(self) -> HttpWriter:
        client = self._client()
        if not (self.llm_model or "").strip():
            raise ValueError("no language model is named")
        return HttpWriter(self.dialect, self.llm_model, client)
