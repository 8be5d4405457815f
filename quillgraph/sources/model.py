"""The document, graph and note tables as the operators see them: one row a key, JSON parsed, nulls filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.sources.tables import last_delivery, raw


def names_of(column: str) -> Column:
    """A JSON array of texts; anything else counts as empty."""
    return F.coalesce(F.from_json(F.col(column), "array<string>"), F.array().cast("array<string>"))


def docs(spark: SparkSession, d: str) -> DataFrame:
    df = last_delivery(raw(spark, d, "docs").select("id", "path", "title", "author", "loaded_at"), "id", "path")
    return df.select(F.col("id").alias("doc_id"), "path", "title", F.coalesce("author", F.lit("")).alias("author"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    df = last_delivery(raw(spark, d, "chunks"), "id", "body")
    return df.select(F.col("id").alias("chunk_id"), "doc_id", F.coalesce("section_path", F.lit("")).alias("section_path"), F.coalesce("heading_level", F.lit(0)).alias("heading_level"), F.coalesce("body", F.lit("")).alias("body"), "line_start")


def entities(spark: SparkSession, d: str) -> DataFrame:
    df = last_delivery(raw(spark, d, "entities"), "id", "canonical_name")
    kind = F.lower(F.coalesce("entity_type", F.lit("concept")))
    return df.select(
        F.col("id").alias("entity_id"), F.col("canonical_name").alias("name"), kind.alias("entity_type"), F.split_part(kind, F.lit("."), F.lit(1)).alias("root"), names_of("aliases_json").alias("aliases"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("source", F.lit("auto")).alias("source"), F.coalesce("cross_doc_count", F.lit(0)).cast("long").alias("cross_doc_count"), names_of("source_docs_json").alias("source_docs"),
    )


def relations(spark: SparkSession, d: str) -> DataFrame:
    """Edges between named ends, one row for each (entity_a, entity_b, relation_type): the one with the least id."""
    df = last_delivery(raw(spark, d, "relations").select("id", "entity_a", "entity_b", "relation_type", "weight", "first_seen", "loaded_at"), "id", "first_seen")
    df = df.filter("entity_a IS NOT NULL AND entity_b IS NOT NULL").withColumns({"relation_type": F.upper(F.coalesce("relation_type", F.lit("MENTIONS"))), "weight": F.coalesce("weight", F.lit(1.0))})
    return df.groupBy("entity_a", "entity_b", "relation_type").agg(F.min("id").alias("rel_id"), F.min_by("weight", "id").alias("weight"))


def insights(spark: SparkSession, d: str) -> DataFrame:
    df = last_delivery(raw(spark, d, "insights"), "id", "slug")
    return df.select(F.col("id").alias("insight_id"), "slug", "title", "content", "created_at", names_of("source_docs_json").alias("source_docs"), names_of("entities_json").alias("entities"))


#: What an event tells about a trace.
TRACE_OF = {"purchase": "record", "view": "navigate", "click": "navigate"}


def trace_log(spark: SparkSession, d: str) -> DataFrame:
    """entity_id, source, ts: the events as footprints on the entity with the user's number plus one."""
    kind = F.col("event_type")
    source = F.when(kind == "purchase", "record").when(kind.isin("view", "click"), "navigate").otherwise("search")
    return raw(spark, d, "events").select((F.col("user_id") + 1).alias("entity_id"), source.alias("source"), "ts")


def traces(spark: SparkSession, d: str) -> DataFrame:
    """name, source, count, last_seen: footprints counted for each entity and source."""
    log = trace_log(spark, d).groupBy("entity_id", "source").agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_seen"))
    return log.join(entities(spark, d).select("entity_id", "name"), "entity_id").select("name", "source", "count", "last_seen")


# The same views for DuckDB.
SQL = r"""
md AS (SELECT id AS doc_id, path, title, coalesce(author, '') AS author FROM (SELECT DISTINCT ON (id) * FROM docs ORDER BY id, loaded_at DESC)),
mc AS (SELECT id AS chunk_id, doc_id, coalesce(section_path, '') AS section_path, coalesce(heading_level, 0) AS heading_level, coalesce(body, '') AS body, line_start FROM (SELECT DISTINCT ON (id) * FROM chunks ORDER BY id, loaded_at DESC)),
me AS (SELECT id AS entity_id, canonical_name AS name, lower(coalesce(entity_type, 'concept')) AS entity_type, split_part(lower(coalesce(entity_type, 'concept')), '.', 1) AS root,
  CASE WHEN json_valid(aliases_json) AND json_type(aliases_json) = 'ARRAY' THEN from_json(aliases_json, '["VARCHAR"]') ELSE [] END AS aliases, coalesce(description, '') AS description, coalesce(source, 'auto') AS source,
  CAST(coalesce(cross_doc_count, 0) AS BIGINT) AS cross_doc_count, CASE WHEN json_valid(source_docs_json) AND json_type(source_docs_json) = 'ARRAY' THEN from_json(source_docs_json, '["VARCHAR"]') ELSE [] END AS source_docs
  FROM (SELECT DISTINCT ON (id) * FROM entities ORDER BY id, loaded_at DESC)),
mr0 AS (SELECT id, entity_a, entity_b, upper(coalesce(relation_type, 'MENTIONS')) AS relation_type, coalesce(weight, 1.0) AS weight FROM (SELECT DISTINCT ON (id) * FROM relations ORDER BY id, loaded_at DESC) WHERE entity_a IS NOT NULL AND entity_b IS NOT NULL),
mr AS (SELECT entity_a, entity_b, relation_type, min(id) AS rel_id, arg_min(weight, id) AS weight FROM mr0 GROUP BY ALL),
mi AS (SELECT id AS insight_id, slug, title, content, created_at, CASE WHEN json_valid(source_docs_json) AND json_type(source_docs_json) = 'ARRAY' THEN from_json(source_docs_json, '["VARCHAR"]') ELSE [] END AS source_docs,
  CASE WHEN json_valid(entities_json) AND json_type(entities_json) = 'ARRAY' THEN from_json(entities_json, '["VARCHAR"]') ELSE [] END AS entities FROM (SELECT DISTINCT ON (id) * FROM insights ORDER BY id, loaded_at DESC)),
mt AS (SELECT e.name, t.source, count(*) AS count, max(t.ts) AS last_seen FROM (SELECT user_id + 1 AS entity_id, CASE WHEN event_type = 'purchase' THEN 'record' WHEN event_type IN ('view', 'click') THEN 'navigate' ELSE 'search' END AS source, ts FROM events) t JOIN me e USING (entity_id) GROUP BY ALL)
"""
