"""Embedding texts in batches through a pluggable provider, with retries, splitting, compaction and a cache."""

from __future__ import annotations

import hashlib
import math
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, RETRIES, DELAY = 32, 2, 0.5


class TransientError(RuntimeError):
    """Worth trying again: timeouts, lost connections, rate limits, server errors."""


class InputTooLong(ValueError):
    """The provider refuses a text for its length."""


class EmbeddingProvider(Protocol):
    model: str
    dimensions: int

    def embed_texts(self, texts: list[str]) -> list[list[float]]: ...


class HashEmbedder:
    """Deterministic vectors of hashed words, for tests and offline use."""

    def __init__(self, dimensions: int = 64, limit: int | None = None):
        self.model, self.dimensions, self.limit = f"hash-{dimensions}", dimensions, limit

    def embed_texts(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            if self.limit is not None and len(text) > self.limit:
                raise InputTooLong(str(len(text)))
            v = [0.0] * self.dimensions
            for word in text.lower().split():
                h = int.from_bytes(hashlib.sha256(word.encode()).digest()[:8], "big")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            length = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / length for x in v])
        return out


class AskedCache:
    """Vectors of questions asked before, by provider and text, the ``most`` last used."""

    def __init__(self, provider: EmbeddingProvider, most: int = 1000):
        self.provider, self.most, self.held = provider, most, {}

    def vector(self, text: str) -> list[float]:
        key = hashlib.sha256("\0".join([*map(str, identity(self.provider).values()), text]).encode()).hexdigest()
        if key not in self.held:
            self.held[key] = embed_batch(self.provider, [text])[0]
            if len(self.held) > self.most:
                del self.held[next(iter(self.held))]
        self.held[key] = self.held.pop(key)  # the last used stands last
        return self.held[key]


def identity(provider: EmbeddingProvider, endpoint: str | None = None) -> dict:
    """What an index remembers of its provider; queries must match it. The endpoint is the provider's own, if not given."""
    endpoint = getattr(provider, "endpoint", "") if endpoint is None else endpoint
    name = getattr(provider, "name", None) or type(provider).__name__
    return {"provider": name, "model": provider.model, "dimensions": provider.dimensions, "endpoint_sha256": hashlib.sha256(canonical_endpoint(endpoint).encode()).hexdigest()}


def canonical_endpoint(url: str) -> str:
    """Lower-case scheme and host, no credentials, default port or trailing slash."""
    from urllib.parse import urlsplit

    p = urlsplit(url)
    port = p.port if p.port and p.port != {"http": 80, "https": 443}.get(p.scheme) else None
    return f"{p.scheme}://{(p.hostname or '').lower()}{f':{port}' if port else ''}{p.path.rstrip('/')}" if p.scheme else url


def compacted(text: str, fits: Callable[[str], bool], marker: str = "[...]") -> str:
    """The text with as many of its first and last lines as fit, found by bisection."""
    lines = text.split("\n")

    def cut(k: int) -> str:
        return text if k >= len(lines) else "\n".join([*lines[: (k + 1) // 2], marker, *lines[len(lines) - k // 2 :]])

    low, high = 0, len(lines)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if fits(cut(mid)) else (low, mid - 1)
    return cut(low)


def embed_batch(provider: EmbeddingProvider, texts: list[str], sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in order; transient failures are tried again, too long inputs halve the batch and then compact the text."""
    for attempt in range(RETRIES + 1):
        try:
            got = provider.embed_texts(texts)
            if len(got) != len(texts) or any(len(v) != provider.dimensions or not all(math.isfinite(x) for x in v) for v in got):
                raise ValueError("the provider gave wrong vectors")
            return got
        except TransientError:
            if attempt == RETRIES:
                raise
            sleep(DELAY * 2**attempt)
        except InputTooLong:
            if len(texts) > 1:
                half = len(texts) // 2
                return embed_batch(provider, texts[:half], sleep) + embed_batch(provider, texts[half:], sleep)

            def fits(candidate: str) -> bool:
                try:
                    provider.embed_texts([candidate])
                except InputTooLong:
                    return False
                return True

            return provider.embed_texts([compacted(texts[0], fits)])
    raise AssertionError


def embed(texts: DataFrame, provider: EmbeddingProvider, batch: int = BATCH) -> DataFrame:
    """(key, vector) of every distinct text of (key, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield pd.DataFrame({"key": part["key"], "vector": embed_batch(provider, part["text"].tolist())})

    return texts.select("key", "text").mapInPandas(run, "key string, vector array<double>")


def embed_with_cache(texts: DataFrame, cache: DataFrame, provider: EmbeddingProvider, namespace: str) -> tuple[DataFrame, DataFrame]:
    """(chunk_id, vector) for (chunk_id, text), and the new cache rows: only texts the cache lacks are sent, once each."""
    keyed = texts.withColumn("key", F.sha2(F.concat_ws("\0", F.lit(namespace), F.col("text")), 256))
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    fresh = embed(missing, provider)
    return keyed.select("chunk_id", "key").join(cache.select("key", "vector").unionByName(fresh), "key").select("chunk_id", "vector"), fresh
