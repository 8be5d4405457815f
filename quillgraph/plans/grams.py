"""Texts that may contain names, met by grams of bytes: a bitmap of the names' grams is laid over the texts, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import written

#: Bytes of a gram: a name has grams of the largest of these sizes that it can fill. A gram is the number its bytes make.
SIZES = (8, 4, 2, 1)
#: Bits of a bitmap for each gram, and of one bitmap: at most so many (16 MB) are sent at once, more grams make more bitmaps.
BITS, MOST_BITS = 32, 1 << 27
#: Two places in a bitmap for each gram, by multiplication.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Positions of text looked at together, and bytes of texts whose grams are held together (a longer text stands alone).
STEP, TOGETHER = 1 << 18, 1 << 22


def grams_of(names: DataFrame, name: str) -> DataFrame:
    """name, size, gram: the distinct grams of every name that isn't empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers: list[int] = []
            sizes: list[int] = []
            grams: list[int] = []
            for number, raw in enumerate(batch.column(1).to_pylist()):
                size = next((s for s in SIZES if s <= len(raw)), 0)
                own = {int.from_bytes(raw[i : i + size], "little", signed=size == 8) for i in range(len(raw) - size + 1)} if size else ()
                numbers.extend([number] * len(own))
                sizes.extend([size] * len(own))
                grams.extend(own)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(numbers, pa.int64())), pa.array(sizes, pa.int32()), pa.array(grams, pa.int64())], [name, "size", "gram"])

    return names.select(name, F.col(name).cast("binary").alias("__raw")).mapInArrow(run, f"`{name}` string, size int, gram long")


def slots(grams: np.ndarray, factor: np.uint64, n_bits: int) -> np.ndarray:
    """The places of grams in a bitmap of n_bits (a power of two)."""
    return ((grams * factor) >> np.uint64(65 - n_bits.bit_length())).view(np.int64)


def holds(bitmap: np.ndarray, places: np.ndarray) -> np.ndarray:
    return (bitmap[places >> 6] >> (places & 63).view(np.uint64)) & np.uint64(1)


def found(texts: pa.Array, bitmap: np.ndarray, sizes: tuple[int, ...], step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the texts (bytes) and grams of theirs that the bitmap holds, each pair once.

    All texts are one array of bytes, on which the grams at all positions are made together, each size from two halves;
    those that reach over the end of their text are dropped.
    """
    if not len(texts):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    numbers, kept = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for start in range(0, len(data), step):
        grams = data[start : start + step + SIZES[0] - 1].astype(np.uint64)
        for size in reversed(SIZES):
            if half := size // 2:
                if len(grams) <= half:
                    break
                grams = grams[:-half] | (grams[half:] << np.uint64(8 * half))
            if size not in sizes:
                continue
            at = np.flatnonzero(holds(bitmap, slots(grams[:step], FACTORS[0], len(bitmap) * 64)))
            at = at[holds(bitmap, slots(grams[at], FACTORS[1], len(bitmap) * 64)) > 0]
            number = np.searchsorted(ends, start + at, "right") - 1
            whole = start + at + size <= ends[number + 1]
            numbers.append(number[whole])
            kept.append(grams[at[whole]])
    number, gram = np.concatenate(numbers), np.concatenate(kept).view(np.int64)
    order = np.lexsort((gram, number))
    number, gram = number[order], gram[order]
    first = np.ones(len(gram), bool)
    first[1:] = (number[1:] != number[:-1]) | (gram[1:] != gram[:-1])
    return number[first], gram[first]


def parts_of(batch: pa.RecordBatch, most: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about `most` bytes of its second column."""
    ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy().astype(np.int64))
    for a, b in pairwise([0, *(np.flatnonzero(np.diff(ends // most)) + 1).tolist(), len(ends)]):
        yield batch.slice(a, b - a)


def bitmap_of(grams: DataFrame, n: int) -> np.ndarray:
    """The bitmap of n distinct grams (column gram) as 64-bit words; the words are made by bit_or before they are collected."""
    n_bits = min(MOST_BITS, 1 << max(16, (n * BITS - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            places = np.concatenate([slots(own, f, n_bits) for f in FACTORS])
            yield pa.RecordBatch.from_arrays([pa.array(places >> 6), pa.array((np.uint64(1) << (places & 63).view(np.uint64)).view(np.int64))], ["word", "bits"])

    words = grams.select("gram").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bitmap = np.zeros(n_bits >> 6, np.uint64)
    bitmap[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def texts_with(grams: DataFrame, texts: DataFrame, key: str, body: str, count: bool = False) -> DataFrame:
    """key, gram (or, with count, gram, n: in how many texts) of the texts that have one of the grams (columns size, gram).

    The texts are read once for each bitmap. Of the grams that aren't meant, one in two hundred or fewer come out too. No
    more than a bitmap and the few sizes reaches the driver.
    """
    distinct = written(grams.select("size", "gram").distinct(), "grams")
    sizes, n = tuple(r[0] for r in distinct.select("size").distinct().collect()), distinct.count()
    n_maps = max(1, -(-n * BITS // MOST_BITS))
    rows = texts.select(F.col(key).cast("long").alias(key), F.col(body).cast("binary"))
    out = None
    for at in range(n_maps):
        mine = distinct.filter(F.pmod(F.xxhash64("gram"), F.lit(n_maps)) == at) if n_maps > 1 else distinct
        bitmap = bitmap_of(mine, -(-n // n_maps))

        def run(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray = bitmap) -> Iterator[pa.RecordBatch]:
            for part in (p for batch in batches for p in parts_of(batch)):
                number, gram = found(part.column(1), bitmap, sizes)
                if count:
                    gram, times = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(times.astype(np.int64))], ["gram", "n"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(number)), pa.array(gram)], [key, "gram"])

        part = rows.mapInArrow(run, "gram long, n long" if count else f"`{key}` long, gram long")
        part = written(part.groupBy("gram").agg(F.sum("n").alias("n")) if count else part, "texts-with")
        out = part if out is None else out.unionByName(part)
    # a gram that isn't meant may come out of several bitmaps; one that is meant comes out of its own at least
    return out.distinct() if n_maps > 1 else out
