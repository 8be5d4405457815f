"""The engine as a library: ingest, read, think, navigate, record, study over one set of tables."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import providers
from quillgraph.functions.text import even_space, without_residue
from quillgraph.operators import build, chunking, curate, graph, notes, search
from quillgraph.session import written
from quillgraph.sources import files, model, note_files

MOST, USUAL = 20, 3


def clamp(n: object, usual: int = USUAL) -> int:
    """A count between 1 and MOST; None is the usual one, anything that isn't a number an error."""
    if n is None:
        return usual
    if isinstance(n, bool) or not re.fullmatch(r"[+-]?\d+", str(n)):
        raise ValueError(f"not a count: {n!r}")
    return max(1, min(int(n), MOST))


@dataclass(frozen=True)
class Hooks:
    """Extension points: text before chunking, (entities, relations) after extraction, rules for triplets."""

    pre_ingest: Sequence[Callable[[Column], Column]] = (without_residue, even_space)
    post_extract: Sequence[Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]] = (curate.without_noise,)
    validators: Sequence[Callable] = ()


@dataclass
class Engine:
    """Tables and providers; methods return DataFrames, or dictionaries where a caller wants a few rows."""

    spark: SparkSession
    docs: DataFrame
    chunks: DataFrame
    entities: DataFrame
    relations: DataFrame
    insights: DataFrame
    traces: DataFrame
    books_dir: str = "."
    tokenizer: Callable[[str], list[str]] | None = str.split
    rerank: Callable[[str, list[str]], list[tuple[int, float]]] | None = None
    embedding: providers.Embedding | None = None
    vectors: DataFrame | None = None
    note_vectors: DataFrame | None = None
    extractor: curate.Extractor = field(default=curate.capitalised)
    hooks: Hooks = field(default_factory=Hooks)

    @classmethod
    def of(cls, spark: SparkSession, folder: str, **more: object) -> Engine:
        views = (model.docs, model.chunks, model.entities, model.relations, model.insights, model.traces)
        return cls(spark, *(v(spark, folder) for v in views), **more)

    def _terms(self, query: str) -> list[str] | None:
        return [t.lower() for t in self.tokenizer(query)] if self.tokenizer else None

    def read(self, query: str, source: str | None = None, top_n: object = None) -> dict:
        """Passages for a query: in all books, or in one of exactly this title."""
        if not isinstance(query, str) or not query.strip():
            raise ValueError("query is empty")
        n, terms = clamp(top_n), self._terms(query)
        asked = providers.embed_query(self.embedding, query)
        if source:
            rows = search.in_book(self.chunks, self.docs, query, source, terms, n).orderBy("pos").collect()
            out = {"results": [{"book": r.book, "section": r.section, "body": r.body} for r in rows]}
            return out if rows else out | {"message": f"nothing found in {source}"}
        rows = search.hybrid(self.chunks, self.docs, query, terms, n, self.vectors, asked, body_max=None, rerank=self.rerank).orderBy("pos").collect()
        return {"results": [{"book": r.title, "section": r.section_path, "body": r.body} for r in rows]}

    def think(self, anchor: str, mode: str = "divergent", max_depth: int | None = None, book: str | None = None) -> dict:
        """Thinking from the entity an anchor stands for; candidates where it stands for none."""
        if mode not in ("divergent", "deep"):
            raise ValueError(f"unknown mode: {mode}")
        named = graph.anchors(self.entities, self.spark.createDataFrame([(anchor,)], "query string")).first()
        if named is None:
            return {"anchor": anchor, "found": False, "candidates": [r.name for r in graph.candidates(self.entities, anchor).collect()]}
        book_id = None
        if book is not None:
            row = self.docs.filter(F.col("title") == book).select("doc_id").first()
            book_id = row[0] if row else None
        topic = graph.topics(self.entities, self.spark.createDataFrame([(named.name,)], "anchor string"), book_id, book)
        rows = graph.think(self.relations, self.entities, self.traces, topic, mode, max_depth).orderBy("depth", "pos").collect()
        depths: dict[int, list[dict]] = {}
        for r in rows:
            depths.setdefault(r.depth, []).append({"name": r.name, "type": r.type, "relation": r.relation, "in_books": r.in_books, "coherence": r.coherence})
        return {"anchor": named.name, "found": True, "depths": depths}

    def navigate(self, seed: str, depth: int = 1) -> dict | None:
        """Anchored and exploration edges of an entity; its footprints and those of what is shown are kept."""
        known = self.entities.filter(F.col("name") == seed).select("name").first() or search.entities_like(self.entities, seed).orderBy("entity_id").select("name").first()
        if known is None:
            return None
        shown = graph.navigate(self.relations, self.entities, self.spark.createDataFrame([(known[0],)], "seed string"), depth).orderBy("bucket", "pos").collect()
        now = self.traces.schema["last_seen"].dataType
        seen = self.spark.createDataFrame([(n,) for n in [known[0], *(r.neighbor for r in shown)]], "name string").select("name", F.lit("navigate").alias("source"), F.lit(1).cast("long").alias("count"), F.current_timestamp().cast(now).alias("last_seen"))
        self.traces = notes.merge_traces(self.traces, seen)
        of = lambda bucket: [{"neighbor": r.neighbor, "relation": r.relation, "weight": r.weight} for r in shown if r.bucket == bucket]
        return {"position": known[0], "anchored": of("anchored"), "exploration": of("exploration"), "is_end": not shown}

    def record(self, content: str, title: str | None = None, sources: Sequence[str] = ()) -> dict:
        """A new note; empty contents are an error, known ones a duplicate."""
        wanted = self.spark.createDataFrame([(1, title, content)], "ord int, title string, content string")
        row = notes.write(self.insights, wanted).first()
        if row.status == "empty":
            raise ValueError("content is empty")
        if row.status == "new":
            note = self.spark.createDataFrame([(row.slug, row.title, row.content, list(sources))], "slug string, title string, content string, source_docs array<string>")
            self.insights = self.insights.unionByName(note, allowMissingColumns=True)
        return {"ok": True, "slug": row.slug, "duplicate": row.status == "duplicate"}

    def ingest(self, path: str) -> dict:
        """A book file below books_dir: read, cleaned, chunked, extracted and merged; an older one of its path is replaced."""
        book = files.read_books(self.spark, [files.within(path, self.books_dir)])
        for hook in self.hooks.pre_ingest:
            book = book.withColumn("text", hook(F.col("text")))
        head = book.select("path", "title", "author", "markdown").first()
        top = self.docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        doc = book.select(F.lit(top + 1).cast("long").alias("doc_id"), "path", "title", "author", "text")
        cut = chunking.chunked(doc, "doc_id", "text", head.markdown)
        clash = chunking.repeated_sections(cut).first()
        if clash:
            raise ValueError(f"two sections are called {clash.section_path!r}")
        gone = self.docs.join(doc.select("path"), "path", "left_semi").select("doc_id")
        base = self.chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(0))).first()[0]
        from pyspark.sql import Window

        fresh = cut.withColumn("chunk_id", (F.lit(base) + F.row_number().over(Window.partitionBy("doc_id").orderBy("line_start", "section_path"))).cast("long"))  # one book's sections
        self.chunks = self.chunks.join(gone, "doc_id", "left_anti").unionByName(fresh, allowMissingColumns=True)
        self.docs = files.replace_by_path(self.docs, doc.drop("text"))
        out = {"ok": True, "doc_id": top + 1, "title": head.title, "author": head.author, "chunks": fresh.count(), "vectors": self._embed(fresh, gone)}
        try:
            made = build.build(self.docs, self.chunks, self.entities, self.relations, [top + 1], self.extractor, post=self.hooks.post_extract, validators=self.hooks.validators)
        except Exception as e:  # the book is in all the same
            return out | {"entities_found": 0, "relations_added": 0, "graph_error": str(e)[:300]}
        self.entities, self.relations = made.entities, made.relations
        return out | {"entities_found": made.stats["entities_merged"], "relations_added": made.stats["relations_added"], "graph_error": None}

    def _embed(self, fresh: DataFrame, gone: DataFrame) -> int:
        """Vectors of new chunks; those of replaced documents' chunks go. Without an embedding there are none."""
        if self.embedding is None:
            return 0
        made = written(curate.embed(fresh, "chunk_id", "body", self.embedding, self.embedding.width), "vectors")
        old = self.vectors.join(self.chunks.select("chunk_id"), "chunk_id", "left_semi") if self.vectors is not None else None
        self.vectors = made if old is None else old.unionByName(made)
        return made.count()

    def search_notes(self, query: str, top_n: object = None) -> list[dict]:
        """Notes by full text, substrings and vectors."""
        rows = search.notes(self.insights, query, self._terms(query) or [], clamp(top_n), self.note_vectors, providers.embed_query(self.embedding, query))
        return [{"slug": r.slug, "title": r.title, "content": r.content} for r in rows.orderBy("pos").collect()]

    def link_notes(self) -> dict:
        """Extracts names from notes that have none, links them, and brings the counts of what they name up to date."""
        told = written(notes.extracted(self.insights, self.extractor), "notes")
        fresh, edges, prints = notes.link(told, self.entities, self.relations)
        fresh, edges = written(fresh, "note-entities"), written(edges, "note-edges")
        names = told.select(F.explode("entities").alias("name")).distinct()
        self.insights = told
        self.relations = self.relations.unionByName(edges, allowMissingColumns=True)
        self.entities = written(build.counted(self.entities.unionByName(fresh, allowMissingColumns=True), self.chunks, self.docs, names), "entities")
        now = self.traces.schema["last_seen"].dataType
        self.traces = notes.merge_traces(self.traces, prints.select("name", "source", F.col("count").cast("long").alias("count"), F.current_timestamp().cast(now).alias("last_seen")))
        return {"registered": fresh.count(), "edges_added": edges.count()}

    def sync_notes(self, folder: str) -> dict:
        """Brings the notes in step with a folder of note files."""
        self.insights, counts = note_files.sync(self.spark, folder, self.insights)
        return counts

    def study(self) -> dict:
        """Row counts and relation types."""
        counts = {r.what: r.n for r in graph.stats(self.docs, self.entities, self.relations, self.insights).collect()}
        return counts | {"relation_types": {r.relation_type: r.n for r in graph.relation_types(self.relations).collect()}}

    def call(self, name: str, arguments: dict) -> dict:
        """A tool by name with checked arguments."""
        tools = {"read": self.read, "think": self.think, "navigate": self.navigate, "record": self.record, "ingest": self.ingest, "study": self.study, "search_notes": self.search_notes, "link_notes": self.link_notes, "sync_notes": self.sync_notes}
        if name not in tools:
            raise ValueError(f"unknown tool: {name}")
        try:
            return tools[name](**arguments)
        except TypeError as e:
            raise ValueError(f"wrong arguments for {name}: {e}") from None
