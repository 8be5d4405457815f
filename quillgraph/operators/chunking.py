"""Cutting whole documents into chunks: Markdown sections and sliding windows."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import strip

SIZE, OVERLAP = 1500, 150
MANY, LONG = 5, 100_000


def window_cuts(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Start and end of each window of a stripped text; a window ends at its last blank line if that lies past its middle."""
    if not 0 <= overlap <= size // 2:
        raise ValueError("the overlap must be at most half the size, or windows wouldn't advance")
    gaps = [m.start() for m in re.finditer("\n(?=\n)", text)]
    ends: list[int] = []
    while text and (not ends or ends[-1] < len(text)):
        start = ends[-1] - overlap if ends else 0
        limit = start + size
        last = bisect_right(gaps, limit - 2) - 1
        natural = last >= 0 and gaps[last] > start + size // 2
        ends.append(len(text) if limit >= len(text) else gaps[last] if natural else limit)
    return list(zip([0, *(e - overlap for e in ends[:-1])], ends, strict=False))


def windows(df: DataFrame, key: str, text: str, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key, section_path, heading_level, body, line_start (the window's offset): a fold over each text, no shuffle.

    Null and blank texts have no windows; windows of white space only are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, value in enumerate(batch.column(1).to_pylist()):
                whole = (value or "").strip()
                rows += [(at, f"chunk-{s}", body, s) for s, e in window_cuts(whole, size, overlap) if (body := whole[s:e].strip())]
            if rows:
                at, section, body, start = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(section), pa.array([0] * len(rows), pa.int32()), pa.array(body), pa.array(start, pa.int32())], ["key", "section_path", "heading_level", "body", "line_start"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, section_path string, heading_level int, body string, line_start int").withColumnRenamed("key", key)


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, section_path, heading_level, body, line_start (0-based line): Markdown sections by headings of level 1 to 3.

    Sections without a body are left out but keep their lines' count. All JVM side; the running line count is a window
    over one document's sections.
    """
    parts = df.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.split(text, r"\n(?=#{1,3}\s)")).alias("pos", "part"))
    lines = F.split("part", "\n")
    first = F.element_at(lines, 1)
    marks = F.regexp_extract(first, r"^(#{1,3})\s+(.+)", 1)
    body = F.when(marks != "", strip(F.array_join(F.slice(lines, 2, 1_000_000), "\n"))).otherwise(strip(F.col("part")))
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    out = parts.select(key, strip(F.regexp_extract(first, r"^(#{1,3})\s+(.+)", 2)).alias("section_path"), F.length(marks).alias("heading_level"), body.alias("body"), F.coalesce(F.sum(F.size(lines)).over(w), F.lit(0)).cast("int").alias("line_start"))
    return out.filter("body <> ''")


def chunked(df: DataFrame, key: str, text: str, markdown: bool, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sections for Markdown, windows otherwise; long Markdown (over LONG characters) with fewer than MANY sections gets windows."""
    if not markdown:
        return windows(df, key, text, size, overlap)
    cut = sections(df, key, text)
    few = df.select(key, F.length(text).alias("n")).filter(F.col("n") > LONG).join(cut.groupBy(key).count(), key, "left").filter(F.coalesce("count", F.lit(0)) < MANY).select(key)
    return cut.join(few, key, "left_anti").unionByName(windows(df.join(few, key, "left_semi"), key, text, size, overlap))


def repeated_sections(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with two chunks of one section path: they break the uniqueness of (document, section)."""
    return chunks.groupBy(key, "section_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
