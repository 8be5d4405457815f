"""Notes: writing, linking them to entities, and importing tables of an older layout."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import note_title, slug_of, strip
from quillgraph.operators.curate import Extractor, extract

LINKED = "l3_insight"


def write(known: DataFrame, wanted: DataFrame) -> DataFrame:
    """title, slug, content, status for wanted rows (content, and title or null): "empty", "duplicate" or "new".

    The slug has the content's digest, so a note is a duplicate if its slug is known or came earlier (by ord).
    """
    title = F.coalesce("title", note_title(F.col("content")))
    rows = wanted.withColumn("title", title).withColumn("slug", slug_of(F.col("title"), F.col("content")))
    first = F.row_number().over(Window.partitionBy("slug").orderBy("ord"))
    rows = rows.withColumn("rn", first).join(known.select("slug", F.lit(True).alias("known")).distinct(), "slug", "left")
    blank = F.coalesce(strip(F.col("content")) == "", F.lit(True))
    return rows.select("ord", "title", "slug", "content", F.when(blank, "empty").when(F.col("known") | (F.col("rn") > 1), "duplicate").otherwise("new").alias("status"))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Notes by slug after new ones came: ids and creation stay, title, content and sources are replaced."""
    n = new.select("slug", F.col("title").alias("nt"), F.col("content").alias("nc"), F.col("source_docs").alias("ns"))
    both = old.join(n, "slug", "full")
    return both.select("insight_id", "slug", F.coalesce("nt", "title").alias("title"), F.coalesce("nc", "content").alias("content"), F.coalesce("ns", "source_docs").alias("source_docs"))


def link(insights: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New entities, new relations and footprints that notes' entities bring.

    Entities without a row are registered (source LINKED); each note's title mentions its entities; entities of one note
    are tied pairwise in their order (a note names few, so pairs stay within it); nothing is tied to itself; known
    relations are left out.
    """
    named = insights.select("insight_id", "title", F.posexplode(F.array_distinct(F.filter(F.transform("entities", lambda e: strip(e)), lambda e: e != ""))).alias("pos", "name"))
    fresh = named.select("name").distinct().join(entities.select("name"), "name", "left_anti").select("name", F.lit("concept").alias("entity_type"), F.lit(LINKED).alias("source"))
    star = named.select(F.col("title").alias("entity_a"), F.col("name").alias("entity_b"))
    a, b = named.alias("a"), named.alias("b")
    pairs = a.join(b, (F.col("a.insight_id") == F.col("b.insight_id")) & (F.col("a.pos") < F.col("b.pos"))).select(F.col("a.name").alias("entity_a"), F.col("b.name").alias("entity_b"))
    edges = star.unionByName(pairs).filter("entity_a <> entity_b").distinct().withColumn("relation_type", F.lit("MENTIONS"))
    edges = edges.join(relations, ["entity_a", "entity_b", "relation_type"], "left_anti").select("entity_a", "entity_b", "relation_type", F.lit(1.0).alias("weight"))
    prints = named.groupBy("name").agg(F.count(F.lit(1)).alias("count")).withColumn("source", F.lit(LINKED))
    return fresh, edges, prints


def extracted(insights: DataFrame, extractor: Extractor) -> DataFrame:
    """insights whose entities are those the extractor finds in their content, where they name none; others stay as they are."""
    open_ = insights.filter(F.size(F.coalesce("entities", F.array().cast("array<string>"))) == 0)
    asked = open_.select(F.col("insight_id").alias("batch"), F.lit(0).alias("part"), F.col("content").alias("prompt"))
    found, _ = extract(asked, extractor)
    names = found.groupBy(F.floor(F.col("ord") / 100_000_000).cast("long").alias("insight_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]).alias("__names"))
    told = insights.join(names, "insight_id", "left")
    return told.withColumn("entities", F.when(F.size(F.coalesce("entities", F.array().cast("array<string>"))) == 0, F.array_distinct(F.coalesce("__names", F.array().cast("array<string>")))).otherwise(F.col("entities"))).select(*insights.columns)


def frontmatter(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, meta (map of texts), lists (map of lists), body of notes with a "---" head; without one meta is null and body is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("key", pa.string()), ("meta", pa.map_(pa.string(), pa.string())), ("lists", pa.map_(pa.string(), pa.list_(pa.string()))), ("body", pa.string())])
        for batch in batches:
            rows = []
            for k, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                meta, lists, body = parse_head(value or "")
                rows.append({"key": k, "meta": None if meta is None else list(meta.items()), "lists": None if meta is None else list(lists.items()), "body": body})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return df.select(F.col(key).cast("string").alias("key"), text).mapInArrow(run, "key string, meta map<string,string>, lists map<string,array<string>>, body string").withColumnRenamed("key", key)


def parse_head(text: str) -> tuple[dict[str, str] | None, dict[str, list[str]], str]:
    """Single values, lists and body; the first is None if there is no complete head."""
    text = text.strip()
    head, mark, body = text[3:].partition("\n---") if text.startswith("---") else ("", "", "")
    if not mark:
        return None, {}, text
    meta: dict[str, str] = {}
    lists: dict[str, list[str]] = {}
    open_key = None
    for line in map(str.strip, head.strip().split("\n")):
        if line.startswith("- ") and open_key is not None:
            meta.pop(open_key, None)
            lists.setdefault(open_key, []).append(line[2:].strip())
        elif line and not line.startswith(("#", "- ")) and ":" in line:
            name, value = (x.strip() for x in line.split(":", 1))
            open_key = name if value in ("", "[]") else None
            if value == "[]":
                lists[name] = []
            else:
                meta[name] = value
    return meta, lists, body.strip()


def head_text(meta: dict[str, str], lists: dict[str, list[str]], body: str) -> str:
    """A note file; parse_head reads it back."""
    lines = ["---", *(f"{k}: {v}" for k, v in meta.items())]
    for name, items in lists.items():
        lines += [f"{name}: []"] if not items else [f"{name}:", *(f"- {x}" for x in items)]
    return "\n".join([*lines, "---", "", body])


# Importing an older layout.


def import_entities(rows: DataFrame) -> DataFrame:
    """name, entity_type, aliases, cross_doc_count from rows of (name, alias, entity_type, cross_doc_count): the type goes with the largest count."""
    grouped = rows.groupBy("name").agg(F.array_sort(F.collect_set("alias")).alias("aliases"), F.max("cross_doc_count").alias("cross_doc_count"), F.max_by("entity_type", F.struct("cross_doc_count", "entity_type")).alias("entity_type"))
    return grouped.select("name", "entity_type", F.array_remove("aliases", F.col("name")).alias("aliases"), "cross_doc_count")


def import_relations(rows: DataFrame) -> DataFrame:
    """entity_a, entity_b, relation_type in upper case (MENTIONS for null), books as a list; the first of equal keys stays."""
    kind = F.upper(F.coalesce("relation_type", F.lit("MENTIONS")))
    parsed = F.from_json("books", "array<string>")
    books = F.when(parsed.isNotNull(), parsed).when(F.coalesce("books", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.array("books"))
    ready = rows.select("id", "entity_a", "entity_b", kind.alias("relation_type"), "weight", books.alias("source_docs"))
    return ready.groupBy("entity_a", "entity_b", "relation_type").agg(F.min_by(F.struct("weight", "source_docs"), "id").alias("r")).select("entity_a", "entity_b", "relation_type", "r.*")


def sourced(rows: DataFrame) -> DataFrame:
    """name, description with the books it comes from appended."""
    told = F.concat(F.lit("来源: "), F.array_join("books", ", "))
    return rows.select("name", F.when(F.size("books") == 0, F.col("description")).when(F.coalesce("description", F.lit("")) == "", told).otherwise(F.concat_ws("; ", "description", told)).alias("description"))


def last_traces(rows: DataFrame) -> DataFrame:
    """name, source, count, last_seen: the latest row of each (name, source) replaces earlier ones."""
    return rows.groupBy("name", "source").agg(F.max_by("count", F.struct("last_seen", "count")).alias("count"), F.max("last_seen").alias("last_seen"))


def merge_traces(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counts added and times kept latest for each (name, source)."""
    return old.unionByName(new).groupBy("name", "source").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))


def first_sections(chunks: DataFrame) -> DataFrame:
    """Chunks with the least id of each (doc_id, section_path); null documents count as one."""
    least = chunks.groupBy("doc_id", "section_path").agg(F.min("chunk_id").alias("chunk_id"))
    return chunks.join(least.select("chunk_id"), "chunk_id", "left_semi")
