"""Splitting oversized texts at natural boundaries, with content-defined cuts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1500, 150
#: Characters in the rolling hash's window.
WIDTH = 24
# Characters that show nothing, besides white space.
BLANK = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ"
_SHOWS = re.compile(rf"[^\s{BLANK}]")
_BREAK = re.compile(r"\r\n|\n")
_SENTENCE = re.compile(r"[。！？!?…।؟]+[”’»」』）)\]\"']*\s*|(?<=[^\W\d_]{2})\.[”’»)\]\"']*\s+(?=[^\sa-z])")
_GAP = re.compile(r"\s+")
_SHOWN = regex.compile(r"\X")
#: Kinds of boundary, best first.
PARAGRAPH, LINE, SENTENCE, WORD, INNER = range(5)


def level(text: str, limit: int = LIMIT) -> str:
    """'paragraph' if every paragraph keeps the limit, else 'line' if every line does, else 'inner'.

    Lines end at LF or CRLF, which counts as one character; a paragraph is a run of lines that show something.
    """
    longest_line = longest = run = 0
    for line in _BREAK.split(text):
        if _SHOWS.search(line):
            run += len(line) + (run > 0)
            longest, longest_line = max(longest, run), max(longest_line, len(line))
        else:
            longest_line, run = max(longest_line, len(line)), 0
    return "paragraph" if longest <= limit else "line" if longest_line <= limit else "inner"


def boundaries(text: str) -> list[list[int]]:
    """Positions where a new unit may begin, by kind (PARAGRAPH, LINE, SENTENCE, WORD), each list ascending."""
    found: list[list[int]] = [[], [], [], []]
    blank = False
    start = 0
    for m in _BREAK.finditer(text):
        shows = _SHOWS.search(text, start, m.start()) is not None
        found[LINE].append(m.end())
        if not shows or blank:
            found[PARAGRAPH].append(m.end())
        blank = not shows
        start = m.end()
    found[SENTENCE] = [m.end() for m in _SENTENCE.finditer(text)]
    found[WORD] = [m.end() for m in _GAP.finditer(text)]
    return found


def landmarks(text: str) -> np.ndarray:
    """A rolling hash of the WIDTH characters before each position: the same text has the same values wherever it stands."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    gear = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    gear ^= gear >> np.uint64(29)
    gear *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(len(gear), "u8")
    for back in range(min(WIDTH, len(gear))):
        total[back:] += gear[: len(gear) - back] << np.uint64(back)
    total ^= total >> np.uint64(32)
    return total * np.uint64(0x94D049BB133111EB)


def _nearest(places: list[np.ndarray], low: int, high: int, wanted: int) -> tuple[int, int] | None:
    """The natural boundary in (low, high] nearest to wanted, of the best kind that has one there."""
    for kind, at in enumerate(places):
        a, b = np.searchsorted(at, low, "right"), np.searchsorted(at, high, "right")
        if a < b:
            some = at[a:b]
            return int(some[np.abs(some - wanted).argmin()]), kind
    return None


def _plain(text: str, at: int) -> bool:
    """Whether a shown character surely begins anew at a place: a letter, number or space that nothing joins to the left."""
    c = text[at]
    return (c.isalnum() or c.isspace()) and not ("\u1100" <= c <= "\u11ff" or "\ua960" <= c <= "\ua97f" or "\ud7b0" <= c <= "\ud7ff") and text[at - 1] not in "\u200d\r" and not unicodedata.category(c).startswith("M")


def whole(text: str, at: int, low: int) -> int:
    """The place nearest before (or, if that isn't past low, after) `at` that parts no shown character.

    A letter stays with its marks, joined signs and flags stay together, CR stays with LF.
    """
    if not 0 < at < len(text):
        return at
    begin = at - 1
    while begin > 0 and not _plain(text, begin):
        begin -= 1
    for m in _SHOWN.finditer(text, begin):
        if m.end() == at or m.start() == at:
            return at
        if m.end() > at:
            return m.start() if m.start() > low else m.end()
    return at


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """Pieces (start, end, kind of the boundary at the end) that cover the text.

    A text within the limit is one piece. Else each cut lies between `least` and `most` characters after the last one:
    the position whose rolling hash is least there is the landmark, and the cut is the natural boundary nearest to it,
    paragraphs before lines, lines before sentences, sentences before word gaps; without any it is the landmark itself,
    moved so that it parts no shown character. Landmarks depend on the text around them only, so an edit moves cuts in
    its neighbourhood and the later ones fall where they did. The next piece starts `overlap` before the cut, or at the
    natural boundary nearest to that, if one lies within a sixth of the overlap. A single shown character that is
    longer than the limit is the only thing ever parted.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)] if n else []
    if not 0 <= overlap <= limit // 3:
        raise ValueError("the overlap must be at most a third of the limit")
    places = [np.array(x, "i8") for x in boundaries(text)]
    every = np.unique(np.concatenate(places))
    hashes = landmarks(text)
    slack = overlap // 6
    most = limit - overlap - slack
    least = most // 3
    pieces, start, last = [], 0, 0
    while n - start > limit:
        low, high = last + least, min(last + most, start + limit)
        mark = low + 1 + int(hashes[low:high].argmin())
        end, kind = _nearest(places, low, high, mark) or (mark, INNER)
        if kind == INNER:
            moved = whole(text, end, max(low, start))
            end = moved if moved <= start + limit else end
        pieces.append((start, end, kind))
        wanted = end - overlap
        begin = _nearest([every], wanted - slack - 1, wanted + slack, wanted) if overlap else None
        start = begin[0] if begin else max(whole(text, wanted, wanted - slack - 1), pieces[-1][0] + 1) if overlap else end
        last = end
    pieces.append((start, n, PARAGRAPH))
    return pieces


def checked(text: str, pieces: list[tuple[int, int, int]], limit: int) -> list[tuple[int, int, int]]:
    """The pieces, if they cover the text in order, each within the limit; anything else is an error."""
    at = 0
    for start, end, _ in pieces:
        if not (start <= at < end and end - start <= limit):
            raise ValueError(f"pieces don't cover the text at {at}")
        at = end
    if at != len(text):
        raise ValueError(f"pieces end at {at} of {len(text)}")
    return pieces


KINDS = ("paragraph", "line", "sentence", "word", "inner")


def split(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, level, piece (0-based), start, end, overlap (with the piece before), ends_at, text and the kept columns: the pieces of texts over the limit.

    level describes the whole text (see level). Texts within the limit, empty and null ones don't come out: they need
    no split. Every row is split by itself (no shuffle); rows with equal keys give equal pieces, so deduplicate first.
    A surplus column whose name clashes is not touched, as only key, text and keep are read.
    """
    kept = [c for c in keep if c not in (key, text)]
    big = df.filter(F.length(text) > limit).select(F.col(key).alias("key"), F.col(text).alias("body"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for at, body in enumerate(batch.column(1).to_pylist()):
                grade = level(body, limit)
                parts = checked(body, cut(body, limit, overlap), limit)
                rows += [(at, grade, n, s, e, parts[n - 1][1] - s if n else 0, KINDS[k], body[s:e]) for n, (s, e, k) in enumerate(parts)]
            if not rows:
                continue
            at, grade, piece, start, end, shared, kind, part = zip(*rows, strict=True)
            take = pa.array(at)
            columns = [batch.column(0).take(take), pa.array(grade), pa.array(piece, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(shared, pa.int32()), pa.array(kind), pa.array(part)]
            yield pa.RecordBatch.from_arrays([*columns, *(batch.column(2 + i).take(take) for i in range(len(kept)))], ["key", "level", "piece", "start_pos", "end_pos", "overlap", "ends_at", "piece_text", *kept])

    kinds = {f.name: f.dataType.simpleString() for f in big.schema}
    schema = f"key {kinds['key']}, level string, piece int, start_pos int, end_pos int, overlap int, ends_at string, piece_text string" + "".join(f", `{c}` {kinds[c]}" for c in kept)
    return big.mapInArrow(run, schema).withColumnRenamed("key", key)
