"""Providers by name: chat, embedding, tokenizer and reranker, with deterministic local ones; unknown names are refused."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Sequence
from typing import Any, Protocol


class Chat(Protocol):
    def __call__(self, prompt: str) -> str: ...


class Embedding(Protocol):
    width: int

    def __call__(self, texts: list[str]) -> list[list[float]]: ...


class Tokenizer(Protocol):
    def __call__(self, text: str) -> list[str]: ...


class Reranker(Protocol):
    """Places of the texts with their scores, best first."""

    def __call__(self, query: str, texts: list[str]) -> list[tuple[int, float]]: ...


class HashedEmbedding:
    """A deterministic embedding: every word adds to one of `width` numbers, by its digest; the vector has length 1."""

    def __init__(self, width: int = 64) -> None:
        self.width = width

    def __call__(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.width
            for word in words(text):
                d = hashlib.md5(word.encode()).digest()
                v[int.from_bytes(d[:4], "big") % self.width] += 1.0 if d[4] & 1 else -1.0
            norm = sum(x * x for x in v) ** 0.5 or 1.0
            out.append([x / norm for x in v])
        return out


_WIDE = r"[\u2e80-\u9fff\uf900-\ufaff\u3040-\u30ff\uac00-\ud7af]"


def words(text: str) -> list[str]:
    """Words of spaced scripts in small letters; of spaceless ones every two neighbouring characters (one alone stays)."""
    out: list[str] = []
    for run in re.findall(rf"{_WIDE}+|(?:(?!{_WIDE})[^\W_])+", text.lower()):
        if re.match(_WIDE, run) and len(run) > 1:
            out += [run[i : i + 2] for i in range(len(run) - 1)]
        else:
            out.append(run)
    return out


def overlap_rerank(query: str, texts: list[str]) -> list[tuple[int, float]]:
    """Texts by the share of the query's words that they have; ties keep their order."""
    asked = set(words(query))
    scores = [(i, len(asked & set(words(t))) / max(1, len(asked))) for i, t in enumerate(texts)]
    return sorted(scores, key=lambda x: (-x[1], x[0]))


def echo(prompt: str) -> str:
    """A chat that finds nothing."""
    return '{"entities": [], "relations": []}'


_MAKERS: dict[str, dict[str, Callable[..., Any]]] = {
    "chat": {"mock": lambda **_: echo},
    "embedding": {"hashed": lambda width=64, **_: HashedEmbedding(width), "none": lambda **_: None},
    "tokenizer": {"words": lambda **_: words, "spaces": lambda **_: str.split, "none": lambda **_: None},
    "reranker": {"overlap": lambda **_: overlap_rerank, "none": lambda **_: None},
}


def add(kind: str, name: str, maker: Callable[..., Any]) -> None:
    """Registers a provider: maker is called with the settings and gives the callable, or None for "not used"."""
    if kind not in _MAKERS:
        raise ValueError(f"unknown kind of provider: {kind}")
    _MAKERS[kind][name] = maker


def make(kind: str, name: str, **settings: object) -> Any:
    """The provider of that name; unknown kinds and names are errors."""
    if kind not in _MAKERS or name not in _MAKERS[kind]:
        raise ValueError(f"unknown {kind} provider: {name}")
    return _MAKERS[kind][name](**settings)


def names(kind: str) -> list[str]:
    return sorted(_MAKERS[kind])


class Chain:
    """Asks providers in turn until one answers; if all fail, the last error is raised."""

    def __init__(self, providers: Sequence[Callable[..., Any]]) -> None:
        if not providers:
            raise ValueError("a chain needs a provider")
        self.providers = tuple(providers)

    def __call__(self, *arguments: object) -> Any:
        error: Exception | None = None
        for provider in self.providers:
            try:
                return provider(*arguments)
            except Exception as e:
                error = e
        raise error


class Patient:
    """Asks again after a failure, waiting a little longer each time; an answer later than `timeout` seconds is a failure."""

    def __init__(self, provider: Callable[..., Any], waits: Sequence[float] = (0.5, 1.0, 2.0), timeout: float = 120.0) -> None:
        self.provider, self.waits, self.timeout = provider, tuple(waits), timeout

    def __call__(self, *arguments: object) -> Any:
        from concurrent.futures import ThreadPoolExecutor

        error: Exception | None = None
        for wait in self.waits:
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(self.provider, *arguments).result(self.timeout)
            except Exception as e:
                error = e
                time.sleep(wait)
            finally:
                pool.shutdown(wait=False, cancel_futures=True)
        raise error


def embed_query(embedding: Embedding | None, text: str) -> list[float] | None:
    """The query's vector, or None without an embedding or if it fails: the search then goes on without vectors."""
    if embedding is None:
        return None
    try:
        return list(embedding([text])[0])
    except Exception:
        return None
