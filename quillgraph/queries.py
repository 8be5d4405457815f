"""Registered queries of the core and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog
from quillgraph.operators import instants, references
from quillgraph.session import scratch
from quillgraph.sources.tables import raw

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every orphan or late reference of relations and chunks, with the month it was first seen."""
    relations, removals = raw(spark, sf_dir, "relations"), raw(spark, sf_dir, "removals")
    refs = [references.references(relations, "relations", f, "entities") for f in ("entity_a", "entity_b")]
    refs.append(references.references(raw(spark, sf_dir, "chunks"), "chunks", "doc_id", "docs"))
    known = [references.parents(raw(spark, sf_dir, "entities"), "entities", "canonical_name", removals), references.parents(raw(spark, sf_dir, "docs"), "docs", "id", removals)]
    return references.orphans(reduce(DataFrame.unionByName, refs), reduce(DataFrame.unionByName, known))


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p1_found counted for each table, field, kind and month."""
    return references.orphan_report(p1_found(spark, sf_dir))


def _times(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(table: str, field: str) -> DataFrame:
        df = raw(spark, sf_dir, table).select("id", "loaded_at", F.struct("writer_id", F.col(field).alias("raw_time")).alias("r"))
        return df.groupBy("id").agg(F.max_by("r", F.struct("loaded_at", "r")).alias("r")).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "r.*")

    return rows("docs", "ingested_at").unionByName(rows("relations", "last_seen")).unionByName(rows("insights", "updated_at"))


def p3_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every id of the three tables with its time text and instant; null where the text names none."""
    # a cluster names the dictionary that it keeps from run to run; without one each run parses every distinct text
    store = spark.conf.get("spark.quillgraph.instants", None) or scratch(spark, "instants")
    return instants.normalise(_times(spark, sf_dir), raw(spark, sf_dir, "writers"), store).select("table_name", "row_id", "writer_id", "raw_time", "utc_micros")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose text names an instant, in microseconds since 1970-01-01 UTC."""
    return p3_instants(spark, sf_dir).filter(F.col("utc_micros").isNotNull()).select("table_name", "row_id", "utc_micros")


def p3_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two runs over one new store parse: first the rows of docs and insights, then those of all three tables."""
    store = scratch(spark, "instants")
    times, writers = _times(spark, sf_dir), raw(spark, sf_dir, "writers")
    sizes = []
    for rows in (times.filter("table_name <> 'relations'"), times):
        instants.normalise(rows, writers, store)
        sizes.append(instants.stored(spark, store).count())
    return spark.createDataFrame([(1, sizes[0], sizes[0]), (2, sizes[1], sizes[1] - sizes[0])], "increment int, n_words long, n_new long")


QUERIES: dict[str, Query] = {"p3_increments": p3_increments, "p1_found": p1_found, "p1_report": p1_report, "p3_found": p3_found, "p3_instants": p3_instants}

_P1 = """
WITH gone AS (SELECT table_name, row_key, max(removed_at) AS removed FROM removals GROUP BY ALL),
known AS (
  SELECT 'entities' AS parent, canonical_name AS key, min(loaded_at) AS first, max(loaded_at) AS last FROM entities WHERE canonical_name IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'docs', CAST(id AS VARCHAR), min(loaded_at), max(loaded_at) FROM docs GROUP BY id),
refs AS (
  SELECT 'relations' AS table_name, 'entity_a' AS field_name, id AS row_id, 'entities' AS parent, entity_a AS key, min(loaded_at) AS seen FROM relations WHERE entity_a IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'relations', 'entity_b', id, 'entities', entity_b, min(loaded_at) FROM relations WHERE entity_b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT 'chunks', 'doc_id', id, 'docs', CAST(doc_id AS VARCHAR), min(loaded_at) FROM chunks WHERE doc_id IS NOT NULL GROUP BY ALL),
judged AS (
  SELECT r.*, CASE WHEN k.key IS NULL OR coalesce(g.removed > k.last, false) THEN CASE WHEN g.row_key IS NULL THEN 'missing' ELSE 'removed' END
                   WHEN k.first > r.seen THEN 'late' END AS kind
  FROM refs r LEFT JOIN known k ON r.parent = k.parent AND r.key = k.key LEFT JOIN gone g ON r.parent = g.table_name AND r.key = g.row_key)
"""
ORACLE: dict[str, str] = {
    "p1_found": _P1 + "SELECT table_name, field_name, row_id, kind, strftime(seen, '%Y-%m') AS period FROM judged WHERE kind IS NOT NULL",
    "p1_report": _P1 + "SELECT table_name, field_name, kind, strftime(seen, '%Y-%m') AS period, count(*) AS n_references, count(DISTINCT row_id) AS n_rows FROM judged WHERE kind IS NOT NULL GROUP BY ALL",
}
_TIMES = " UNION ALL ".join(f"SELECT '{t}' AS table_name, id, writer_id, {f} AS raw_time, row_number() OVER (PARTITION BY id ORDER BY loaded_at DESC, writer_id DESC NULLS LAST, {f} DESC NULLS LAST) AS rn FROM {t}" for t, f in (("docs", "ingested_at"), ("relations", "last_seen"), ("insights", "updated_at")))
ORACLE["p3_increments"] = f"""
WITH t AS (SELECT t.table_name, t.raw_time, coalesce(w.tz_name, '') AS zone, coalesce(w.day_first, false) AS day_first FROM ({_TIMES}) t LEFT JOIN writers w USING (writer_id) WHERE rn = 1 AND raw_time IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT raw_time, zone, day_first FROM t WHERE table_name <> 'relations')) AS a, (SELECT count(*) FROM (SELECT DISTINCT raw_time, zone, day_first FROM t)) AS b)
SELECT 1 AS increment, a AS n_words, a AS n_new FROM n UNION ALL SELECT 2, b, b - a FROM n"""
QUERIES |= catalog.QUERIES
ORACLE |= catalog.ORACLE
