"""Text embedders: lists of texts to rows of unit vectors."""

from __future__ import annotations

import json
import os
import urllib.request
from typing import Protocol

import numpy as np

from ..functions.hashing import U, mix

REQUEST_ROWS = 256


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; rows of zeros stay."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def model_name(embedder) -> str:
    """What tells the vectors of one embedder from those of another: its ``name``, or else its class."""
    return getattr(embedder, "name", None) or f"{type(embedder).__module__}.{type(embedder).__qualname__}"


class HashingEmbedder:
    """Deterministic and offline: signed counts of hashed character trigrams of the words. ``metrics`` (a RunMetrics)
    counts what it is asked for as a model's requests."""

    def __init__(self, dim: int = 256, metrics=None):
        self.dim, self.metrics = dim, metrics
        self.name = f"hashed-trigrams/{dim}"

    def _counts(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        if not words:
            return np.zeros(self.dim)
        # Each word stands between spaces of its own; trigrams with two spaces in a row lie across words.
        sign = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        blank = sign == U(32)
        twice = blank[1:] & blank[:-1]
        within = ~(twice[1:] | twice[:-1])
        gram = mix((sign[:-2] | sign[1:-1] << U(21) | sign[2:] << U(42))[within])
        return np.bincount((gram % U(self.dim)).astype(np.int64), np.where(gram >> U(63), 1.0, -1.0), self.dim)

    def embed(self, texts: list[str]) -> np.ndarray:
        if self.metrics:
            self.metrics.add(embedding_requests=-(-len(texts) // REQUEST_ROWS))
        out = np.zeros((len(texts), self.dim), np.float32)
        for k, text in enumerate(texts):
            out[k] = self._counts(text)
        return unit(out)


class HTTPEmbedder:
    """An HTTP embeddings endpoint, 256 texts a request."""

    def __init__(self, model: str = "text-embedding-3-small", api_base: str = "https://api.openai.com/v1", api_key: str | None = None, timeout: int = 120, metrics=None):
        self.model, self.api_base, self.api_key, self.timeout, self.metrics = model, api_base.rstrip("/"), api_key, timeout, metrics
        self.name = f"{self.api_base}/{model}"

    def embed(self, texts: list[str]) -> np.ndarray:
        rows = []
        key = self.api_key or os.environ.get("OPENAI_API_KEY", "")
        for k in range(0, len(texts), REQUEST_ROWS):
            body = json.dumps({"model": self.model, "input": texts[k : k + REQUEST_ROWS]}).encode()
            request = urllib.request.Request(f"{self.api_base}/embeddings", body, {"Content-Type": "application/json", "Authorization": f"Bearer {key}"})
            if self.metrics:
                self.metrics.add(embedding_requests=1)
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:  # noqa: S310
                rows += [d["embedding"] for d in sorted(json.load(reply)["data"], key=lambda d: d["index"])]
        return unit(np.array(rows, np.float32))
