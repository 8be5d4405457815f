"""Byte-pair encoding of whole tables with a public rank file; merges are found by a segment tree."""

from __future__ import annotations

import base64
import importlib.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 62
#: Distinct pieces kept by one Python worker; above this its cache starts anew (a bound on memory, not on the work).
CACHE = 400_000
_encoders: dict[str, Encoder] = {}


def rank_file(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of a rank file among the installed public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    if spec is None:
        return f"/opt/tokenizers/{name}"
    return f"{spec.submodule_search_locations[0]}/{name}"


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece.

    A segment tree over the byte positions holds rank and position of each live pair as one number, so its root is the
    leftmost pair of least rank. A merge changes three leaves (the merged pair, its left neighbour, the pair that is
    gone), each a point update of logarithmic length that ends where a node keeps its value.
    """
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts = [piece[i : i + 1] for i in range(n)]
    bits = n.bit_length()
    mask, size = (1 << bits) - 1, 1 << (n - 1).bit_length()
    tree = [NONE] * (2 * size)
    get = ranks.get
    for i in range(n - 1):
        rank = get(piece[i : i + 2])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after, before = list(range(1, n + 1)), list(range(-1, n))
    while (top := tree[1]) < NONE:
        i = top & mask
        j = after[i]
        k = after[j]
        parts[i] += parts[j]
        after[i] = k
        if k < n:
            before[k] = i
        h = before[i]
        for at in (j, i, h):
            if at < 0:
                continue
            value = NONE
            if at != j and after[at] < n:
                rank = get(parts[at] + parts[after[at]])
                if rank is not None:
                    value = rank << bits | at
            node = size + at
            tree[node] = value
            while node > 1:
                a, b = tree[node], tree[node ^ 1]
                node >>= 1
                least = a if a < b else b
                if tree[node] == least:
                    break
                tree[node] = least
    ids, i = [], 0
    while i < n:
        ids.append(ranks[parts[i]])
        i = after[i]
    return ids


class Encoder:
    """One rank file in one Python worker, with the pieces it has met."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(PATTERN).findall
        self.cache: dict[str, list[int]] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for null and empty texts. Lone surrogates can't occur in Spark strings."""
        out: list[int] = []
        if not text:
            return out
        cache, extend = self.cache, out.extend
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = cache[piece] = merge(piece.encode(), self.ranks)
            extend(ids)
        return out

    def count(self, text: str | None) -> int:
        return len(self.encode(text))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key and ids (array of int) of every row by the tokenizer's rank file.

    Null and empty texts have the empty list; strings that look like special tokens are ordinary text. Rows come out
    as often as they come in, whatever their key. No shuffle: a scan of two columns, then Arrow batches.
    """
    path = path or rank_file()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            flat, ends = [], np.zeros(len(texts) + 1, "int32")
            for n, value in enumerate(texts.to_pylist()):
                flat.extend(encoder.encode(value))
                ends[n + 1] = len(flat)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, "int32")))
            yield pa.RecordBatch.from_arrays([keys, ids], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
