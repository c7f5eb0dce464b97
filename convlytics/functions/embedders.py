"""Text -> vector functions usable inside ``mapInPandas``.

An embedding model is any callable ``list[str] -> list[list[float]]``.  The
reference calls an external embedding server; offline we ship a
deterministic feature-hashing embedder so every operator runs end to end.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

EmbedFn = Callable[[list[str]], list[list[float]]]


@dataclass(frozen=True)
class ModelFactory:
    """A model that is opened where it runs, once in each Python worker.

    ``open`` loads it (weights, a client, a tokenizer); only the factory
    travels to the tasks.  ``max_tokens`` bounds the padded size of a call:
    the number of its texts times the words of its longest one.
    """

    name: str
    open: Callable[[], EmbedFn]
    max_tokens: int = 16_384


#: models open in this Python process, by name
_OPEN: dict[str, EmbedFn] = {}


def opened(model: EmbedFn | ModelFactory) -> EmbedFn:
    """The function itself, or what the factory opens, kept for the tasks to come."""
    if not isinstance(model, ModelFactory):
        return model
    if model.name not in _OPEN:
        _OPEN[model.name] = model.open()
    return _OPEN[model.name]


def call_slices(sizes: np.ndarray, most_texts: int, most_tokens: int | None) -> Iterator[np.ndarray]:
    """Row numbers of each call: texts of like length together, the longest first.

    A text beyond the budget is a call of its own.
    """
    order = np.argsort(-sizes, kind="stable")
    lo = 0
    while lo < len(order):
        n = most_texts
        if most_tokens is not None:
            n = min(n, max(1, most_tokens // max(1, int(sizes[order[lo]]))))
        yield order[lo:lo + n]
        lo += n


class HashingEmbedder:
    """Signed feature hashing of whitespace tokens, L2-normalised.

    Deterministic across processes (CRC32, not Python's salted ``hash``).
    """

    def __init__(self, dim: int = 64, name: str | None = None):
        self.dim = dim
        self.name = name or f"hashing-{dim}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        tokens = [(t or "").split() for t in texts]
        h = np.fromiter((zlib.crc32(tok.encode("utf-8")) for row in tokens for tok in row), np.int64)
        at = np.repeat(np.arange(len(texts)), [len(row) for row in tokens])
        np.add.at(out, (at, h % self.dim), np.where((h >> 31) & 1, 1.0, -1.0))
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, norms, out=np.zeros_like(out), where=norms > 0)
        return out.astype(np.float32).tolist()


class DigestEmbedder:
    """Vectors from the SHA-256 digest of a text: byte i is ``(byte - 128) / 128``.

    Equal texts get equal vectors and others unrelated ones, exact in single
    precision; any SQL engine can compute them, which checks a whole pipeline.
    """

    def __init__(self, dim: int = 8, name: str | None = None):
        self.dim = dim
        self.name = name or f"digest-{dim}"

    def __call__(self, texts: list[str]) -> list[list[float]]:
        return [[(b - 128) / 128.0 for b in hashlib.sha256((t or "").encode("utf-8")).digest()[:self.dim]] for t in texts]
