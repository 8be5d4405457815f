"""Importing an older layout in named stages, and additive schema migrations."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.notes import import_entities, import_relations, last_traces, sourced
from quillgraph.plans.skew import in_order

# Stages. Each takes the old rows and what is there, and gives what is to be added.


def new_docs(old: DataFrame, known: DataFrame) -> DataFrame:
    """path, title of indexed Markdown books that aren't known: the file's stem without a leading number.

    Where that leaves nothing, the first level-one heading of the text (column text, if there is one).
    """
    books = old.filter(F.contains("path", F.lit("/books/")) & F.col("path").endswith(".md"))
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]*$", 1)
    title = F.regexp_replace(stem, r"^\d+_", "")
    if "text" in books.columns:
        title = F.when(title != "", title).otherwise(F.coalesce(F.regexp_extract("text", r"(?m)^# (.+)$", 1), F.lit("")))
    return books.select("path", title.alias("title")).dropDuplicates(["path"]).join(known.select("path"), "path", "left_anti")


def new_chunks(old: DataFrame, meta: DataFrame, docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, section_path, heading_level, body, line_start of old rows (id, path, section_path, body) of known documents.

    Levels and lines come from section meta (0 without it); the first of equal (document, section) stays, and what is
    known isn't added again, so a repeated stage adds nothing.
    """
    placed = old.join(docs.select("path", "doc_id"), "path").join(meta.select("path", "section_path", "heading_level", "line_start"), ["path", "section_path"], "left")
    first = placed.groupBy("doc_id", "section_path").agg(F.min_by(F.struct("body", "heading_level", "line_start"), "id").alias("r"))
    ready = first.select("doc_id", "section_path", F.coalesce("r.heading_level", F.lit(0)).alias("heading_level"), "r.body", F.coalesce("r.line_start", F.lit(0)).alias("line_start"))
    return ready.join(known.select("doc_id", "section_path"), ["doc_id", "section_path"], "left_anti")


def new_vectors(old: DataFrame, known: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Vectors whose key has none yet."""
    return old.dropDuplicates([key]).join(known.select(key), key, "left_anti")


def history(old: DataFrame, known: DataFrame) -> DataFrame:
    """query_text, tool_name, top_results, created_at of old queries (timestamp, query, tool, results), once each by their natural key."""
    rows = old.select(F.col("query").alias("query_text"), F.coalesce("tool", F.lit("")).alias("tool_name"), F.coalesce("results", F.lit("[]")).alias("top_results"), F.col("timestamp").alias("created_at"))
    key = ["query_text", "tool_name", "created_at"]
    return rows.dropDuplicates(key).join(known.select(*key), key, "left_anti")


def interest_points(old: DataFrame) -> DataFrame:
    """key, value: the active points (id, name, status) as one JSON text of the settings table; they are a user's few own marks."""
    active = old.filter("status = 'active'").select(F.struct("id", "name").alias("p"))
    return active.agg(F.to_json(F.transform(F.array_sort(F.collect_list("p")), lambda p: p)).alias("value")).select(F.lit("interest_points").alias("key"), "value")


def old_insights(files: DataFrame) -> DataFrame:
    """title, slug, content, source_docs of JSON note files (column text); the slug is the title in lower case, cut to 80."""
    parsed = F.from_json("text", "title string, content string, source_docs array<string>")
    return files.select(parsed.alias("j")).filter("j.title IS NOT NULL").select("j.title", F.substring(F.lower("j.title"), 1, 80).alias("slug"), F.coalesce("j.content", F.lit("")).alias("content"), F.coalesce("j.source_docs", F.array().cast("array<string>")).alias("source_docs"))


def upsert_insights(known: DataFrame, new: DataFrame) -> DataFrame:
    """slug, title, content, source_docs after an import: equal slugs are replaced (the last title wins), others stay."""
    last = new.groupBy("slug").agg(F.max(F.struct("title", "content", "source_docs")).alias("n"), F.lit(True).alias("told"))
    both = known.select("slug", F.struct("title", "content", "source_docs").alias("o")).join(last, "slug", "full")
    return both.select("slug", F.coalesce("n", "o").alias("r")).select("slug", "r.*")


@dataclass
class Store:
    """Tables as Parquet folders below one root; put() replaces a table only when its new rows are written."""

    spark: SparkSession
    root: str

    def get(self, name: str, schema: str) -> DataFrame:
        try:
            version = self.spark.read.schema("name string, v int").parquet(f"{self.root}/_versions").filter(F.col("name") == name).agg(F.max("v")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            version = None
        return self.spark.createDataFrame([], schema) if version is None else self.spark.read.schema(schema).parquet(f"{self.root}/{name}/v={version}")

    def put(self, name: str, df: DataFrame) -> None:
        try:
            version = self.spark.read.schema("name string, v int").parquet(f"{self.root}/_versions").filter(F.col("name") == name).agg(F.coalesce(F.max("v"), F.lit(0))).first()[0] + 1
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            version = 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={version}")
        self.spark.createDataFrame([(name, version)], "name string, v int").coalesce(1).write.mode("append").parquet(f"{self.root}/_versions")


# The imported tables' columns.
SCHEMAS = {
    "docs": "doc_id long, path string, title string",
    "chunks": "chunk_id long, doc_id long, section_path string, heading_level int, body string, line_start int",
    "vectors": "chunk_id long, embedding array<float>",
    "entities": "name string, entity_type string, aliases array<string>, cross_doc_count long",
    "relations": "entity_a string, entity_b string, relation_type string, weight double, source_docs array<string>",
    "traces": "name string, source string, count long, last_seen string",
    "concepts": "name string, description string",
    "insights": "slug string, title string, content string, source_docs array<string>",
    "history": "query_text string, tool_name string, top_results string, created_at string",
    "settings": "key string, value string",
}


def _numbered(rows: DataFrame, column: str, known: DataFrame, *order: str) -> DataFrame:
    """rows with new ids after the known ones, in order."""
    top = known.agg(F.coalesce(F.max(column), F.lit(0))).first()[0]
    return in_order(rows, column, *order, first=top + 1)


def import_all(store: Store, old: dict[str, DataFrame]) -> dict[str, object]:
    """Imports an older layout's tables (those of old that are there) in ten named stages; a finished import is refused.

    Returns which stages ran and each table's rows. A run that broke off goes on with the stage it stopped in; every
    stage adds only what its table lacks.
    """
    spark, marks = store.spark, f"{store.root}/_stages"
    try:
        if spark.read.schema("stage string").parquet(marks).filter("stage = 'completed'").count():
            raise ValueError("the import is completed already")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    get = lambda name: store.get(name, SCHEMAS[name])
    columns = lambda name: [c.split()[0] for c in SCHEMAS[name].split(", ")]

    def add(name: str, rows: DataFrame) -> None:
        store.put(name, get(name).unionByName(rows.select(*columns(name))))

    def whole(name: str, rows: DataFrame) -> None:
        store.put(name, rows.select(*columns(name)))

    def once(name: str, rows: DataFrame, *key: str) -> None:
        add(name, rows.dropDuplicates(list(key)).join(get(name).select(*key), list(key), "left_anti"))

    steps: dict[str, Callable[[], None]] = {
        "docs": lambda: add("docs", _numbered(new_docs(old["docs"], get("docs")), "doc_id", get("docs"), "path")),
        "chunks": lambda: add("chunks", _numbered(new_chunks(old["chunks"], old["meta"], get("docs"), get("chunks")), "chunk_id", get("chunks"), "doc_id", "line_start", "section_path")),
        "vectors": lambda: add("vectors", new_vectors(old["vectors"], get("vectors"))),
        "entities": lambda: once("entities", import_entities(old["entities"]), "name"),
        "relations": lambda: once("relations", import_relations(old["relations"]), "entity_a", "entity_b", "relation_type"),
        "traces": lambda: whole("traces", last_traces(get("traces").unionByName(old["traces"].select(*columns("traces"))))),
        "concepts": lambda: once("concepts", sourced(old["concepts"]), "name"),
        "insights": lambda: whole("insights", upsert_insights(get("insights"), old_insights(old["insights"]))),
        "history": lambda: add("history", history(old["history"], get("history"))),
        "settings": lambda: once("settings", interest_points(old["points"]), "key"),
    }
    needs = {"chunks": ("chunks", "meta"), "settings": ("points",)}
    stages = [(name, step if all(x in old for x in needs.get(name, (name,))) else lambda: None) for name, step in steps.items()]
    ran = run_stages(spark, marks, [*stages, ("completed", lambda: None)])
    return {"ran": ran, "rows": {name: get(name).count() for name in SCHEMAS}}


def run_stages(spark: SparkSession, marks: str, stages: Sequence[tuple[str, Callable[[], None]]]) -> list[str]:
    """Runs the stages whose marks are missing from the folder `marks`, in order, and marks each when it is done.

    A run that broke off goes on where it stopped; a finished one does nothing. Returns what ran.
    """
    try:
        done = {r["stage"] for r in spark.read.schema("stage string").parquet(marks).collect()}  # one row a stage
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = set()
    ran = []
    for name, stage in stages:
        if name not in done:
            stage()
            spark.createDataFrame([(name,)], "stage string").coalesce(1).write.mode("append").parquet(marks)
            ran.append(name)
    return ran


# Migrations: name, table, and what it does to the table.


def _with_default(column: str, value: str, kind: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df if column in df.columns else df.withColumn(column, F.lit(value).cast(kind))


def _unique_sections(df: DataFrame) -> DataFrame:
    least = df.groupBy("doc_id", "section_path").agg(F.min("chunk_id").alias("chunk_id"))
    return df.join(least.select("chunk_id"), "chunk_id", "left_semi")


def _with_key(df: DataFrame) -> DataFrame:
    """Footprints are one row for each name and source."""
    return last_traces(df)


#: Applied in this order. A change of None takes the table away; a name may be in several entries, which then go together.
MIGRATIONS: tuple[tuple[str, str, Callable[[DataFrame], DataFrame] | None], ...] = (
    ("relation notes", "relations", _with_default("metadata", "{}", "string")),
    ("entity times", "entities", _with_default("created_at", None, "string")),
    ("entity times", "entities", _with_default("last_accessed_at", None, "string")),
    ("no summaries", "entity_summaries", None),
    ("footprints", "traces", _with_key),
    ("text index", "chunks_index", None),  # the index is written anew from the chunks when a search needs it
    ("entity sources", "entities", _with_default("source_docs_json", "[]", "string")),
    ("unique sections", "chunks", _unique_sections),
)
VERSION = "0.2"


def pending(applied: Sequence[str]) -> list[str]:
    return [name for name in dict.fromkeys(n for n, _, _ in MIGRATIONS) if name not in set(applied)]


def status(applied: Sequence[str]) -> dict[str, object]:
    """The version and which migrations are applied and pending."""
    return {"version": VERSION if not pending(applied) else None, "applied": [n for n in dict.fromkeys(applied)], "pending": pending(applied)}


def migrate(tables: dict[str, DataFrame], applied: Sequence[str] = ()) -> tuple[dict[str, DataFrame], list[str]]:
    """The tables after the pending migrations, and their names; tables that aren't there are passed over."""
    out, ran = dict(tables), pending(applied)
    for name, table, change in MIGRATIONS:
        if name in ran and table in out:
            if change is None:
                del out[table]
            else:
                out[table] = change(out[table])
    return out, ran
