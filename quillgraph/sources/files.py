"""Files as sources and sinks: Markdown, text and EPUB books; note files; Parquet replaced by path."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions.text import title_of

SUFFIXES = (".md", ".txt", ".epub")


def check_paths(paths: list[str]) -> None:
    """Raises ValueError on a suffix that can't be read."""
    for path in paths:
        if posixpath.splitext(path.lower())[1] not in SUFFIXES:
            raise ValueError(f"Unsupported file: {path}")


def within(path: str, root: str) -> str:
    """The path, if it lies under root as a plain name: no parent steps, no absolute escape. Links are looked at unresolved."""
    import os

    joined = os.path.normpath(os.path.join(root, path))
    if os.path.commonpath([os.path.abspath(root), os.path.abspath(joined)]) != os.path.abspath(root) or os.path.islink(joined) or not os.path.isfile(joined):
        raise ValueError(f"not a readable file under {root}: {path}")
    return joined


class _Page(HTMLParser):
    """The blocks of a page as Markdown: headings, items and paragraphs; what isn't shown is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[str] = []
        self.line: list[str] = []
        self.mark, self.hidden, self.kept = "", 0, 0

    def flush(self, mark: str = "") -> None:
        raw = "".join(self.line)
        text = raw.strip("\n") if self.kept else re.sub(r"[ \t]*\n[ \t]*", "\n", re.sub(r"[^\S\x00]+", " ", raw).replace("\x00", "\n")).strip()
        if text.strip() and self.mark.startswith("#"):
            self.blocks.append(self.mark + text.replace("\n", " "))
        elif text.strip():
            self.blocks.append(self.mark + re.sub(r"(?m)^(?=#{1,6}\s)", r"\\", text))
        if text.strip() or mark or self.mark.startswith("#"):
            self.mark = mark
        self.line = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _HIDDEN:
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush("#" * int(tag[1]) + " ")
        elif tag == "li":
            self.flush("- ")
        elif tag == "br":
            self.line.append("\x00" if not self.kept else "\n")
        elif tag in ("td", "th"):
            self.line.append(" ")
        elif tag in _BLOCKS:
            self.flush()
            self.kept += tag == "pre"

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _HIDDEN:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()
            self.mark = ""
            self.kept = max(0, self.kept - (tag == "pre"))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.line.append(data)


_HIDDEN = frozenset("head script style template".split())
_BLOCKS = frozenset("p div section article aside header footer main body blockquote pre ul ol dl dt dd table tr figure figcaption hr address center".split())


def _page_markdown(page: str) -> str:
    # what HTML closes by an end tag only, XHTML may close in place
    parser = _Page()
    parser.feed(re.sub(r"<(script|style|title)\b([^<>]*)/>", "", page, flags=re.I))
    parser.close()
    parser.flush()
    return "\n\n".join(parser.blocks)


def _decoded(data: bytes) -> str:
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16", "replace")
    named = re.match(rb"\s*<\?xml[^>]*encoding=[\"']([\w.-]+)", data)
    try:
        return data.decode(named[1].decode() if named else "utf-8-sig", "replace")
    except LookupError:
        return data.decode("utf-8-sig", "replace")


def _spine(book: zipfile.ZipFile) -> list[str] | None:
    """The members of the package's reading order without its navigation; None if there is no readable package."""
    try:
        root = next(e for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile")).get("full-path", "")
        package = list(ElementTree.fromstring(book.read(root)).iter())
    except (KeyError, StopIteration, ElementTree.ParseError):
        return None
    called = lambda name: [e for e in package if e.tag.rsplit("}", 1)[-1] == name]
    place = lambda href: posixpath.normpath(posixpath.join(posixpath.dirname(root), unquote(href.split("#")[0])))
    items = {e.get("id"): e for e in called("item") if e.get("href")}
    navigation = {place(e.get("href", "")) for e in called("reference") if e.get("type") == "toc"}
    read = [items[e.get("idref")] for e in called("itemref") if e.get("idref") in items]
    pages = [place(e.get("href")) for e in read if "html" in (e.get("media-type") or "html") and "nav" not in (e.get("properties") or "").split()]
    # a page that the guide calls the contents may still be the book's only one
    return [p for p in pages if p not in navigation] or pages


def epub_text(data: bytes) -> str:
    """All pages of an EPUB but its navigation as Markdown, in the order of its spine; empty for broken archives.

    Without a readable package document, the plain text of all pages in the order of their names.
    """
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as book:
            there = set(book.namelist())
            spine = [n for n in _spine(book) or () if n in there]
            if spine:
                return "\n\n".join(t for n in spine if (t := _page_markdown(_decoded(book.read(n)))))
            natural = lambda n: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"[0-9]+|[^0-9]+", n)]
            pages = [n for n in sorted(there, key=natural) if re.search(r"\.x?html?$", n, re.I) and not re.match(r"(?:nav|toc)\b", posixpath.basename(n), re.I)]
            plain = [re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", _decoded(book.read(n)))).strip() for n in pages]
    except zipfile.BadZipFile:
        return ""
    return "\n\n".join(t for t in plain if t)


def read_books(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, title, author, text, markdown of each file; the author is empty. Files are read by tasks, not by the driver."""
    check_paths(paths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, epub_text(c) if p.lower().endswith(".epub") else c.decode("utf-8", "replace")) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows]), pa.array([t for _, t in rows])], ["path", "text"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(run, "path string, text string")
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1)
    markdown = F.lower("path").endswith(".md") | F.lower("path").endswith(".epub")
    title = F.when(F.lower("path").endswith(".txt"), stem).otherwise(F.coalesce(title_of(F.col("text")), stem))
    return files.select("path", title.alias("title"), F.lit("").alias("author"), "text", markdown.alias("markdown"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """path, modified, slug_default, text of the .md files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    return files.select("path", F.col("modificationTime").alias("modified"), F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug_default"), F.decode("content", "utf-8").alias("text"))


def replace_by_path(old: DataFrame, new: DataFrame) -> DataFrame:
    """old without the paths that new brings, and new."""
    return old.join(new.select("path").distinct(), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def sync_plan(files: DataFrame, known: DataFrame) -> DataFrame:
    """slug, action ("added", "updated", "skipped") of note files (slug, modified) against known notes (slug, updated_at).

    All times are UTC; a file no newer than its note is skipped.
    """
    met = files.join(known.select("slug", "updated_at").withColumn("known", F.lit(True)), "slug", "left")
    return met.select("slug", F.when(F.col("known").isNull(), "added").when(F.col("modified") > F.col("updated_at"), "updated").otherwise("skipped").alias("action"))
