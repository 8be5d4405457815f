"""Building the graph of documents as one operator: sample, ask, merge, check, upsert, count."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import curate
from quillgraph.session import written


@dataclass
class Built:
    """The graph after a run, and the run's figures."""

    entities: DataFrame
    relations: DataFrame
    stats: dict[str, int]


def counted(entities: DataFrame, chunks: DataFrame, docs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """entities with cross_doc_count brought up to date: the larger of mentions in chunks and source documents that exist.

    With names (a table with the name of each entity to be counted) the others keep their count.
    """
    asked = entities.select("name").distinct() if names is None else names.select("name").distinct()
    found = curate.mention_counts(asked, chunks).withColumnRenamed("n_docs", "__said")
    told = curate.verified_counts(entities.join(asked, "name", "left_semi"), docs).withColumnRenamed("n_docs", "__told")
    base = entities if "cross_doc_count" in entities.columns else entities.withColumn("cross_doc_count", F.lit(None).cast("long"))
    both = base.join(found, "name", "left").join(told, "name", "left").join(asked.withColumn("__asked", F.lit(True)), "name", "left")
    count = F.when(F.col("__asked"), F.greatest(F.coalesce("__said", F.lit(0)), F.coalesce("__told", F.lit(0)))).otherwise(F.col("cross_doc_count"))
    return both.withColumn("cross_doc_count", count.cast("long")).select(*base.columns)


def build(docs: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, doc_ids: Sequence[int] | None, extractor: curate.Extractor = curate.capitalised, mode: str = "sample", most: int = curate.MOST_CHUNKS, post: Sequence[Callable] = (curate.without_noise,), validators: Sequence[Callable[[Column, Column, Column], Column]] = (), strict: bool = False) -> Built:
    """The graph after extraction from the chunks of some documents (None: of all).

    Chunks are sampled, asked for in prompts, merged by name, cleaned by the hooks, checked against the domain, and
    upserted; new relations get their type's weight; entities that were found are counted over all chunks. Documents
    without chunks give the graph as it was.
    """
    own = chunks if doc_ids is None else chunks.filter(F.col("doc_id").isin([int(i) for i in doc_ids])) if doc_ids else chunks.filter(F.lit(False))
    asked = curate.prompts(curate.sample(own.select("chunk_id", "body"), mode, most=most))
    asked = written(asked, "prompts")
    found, ties = curate.extract(asked, extractor)
    found, ties = written(found, "extracted"), written(ties, "extracted-ties")
    n_found = found.count()
    found = curate.merge_entities(found)
    for hook in post:
        found, ties = hook(found, ties)
    found = written(found, "found")
    edges = written(curate.new_relations(relations, curate.checked_relations(ties, found, validators, strict)), "edges")
    registered = found.join(entities.select("name"), "name", "left_anti").count()
    after = written(curate.upsert_entities(entities, found, [str(i) for i in doc_ids or ()]), "entities")
    kept = entities.select("name", *[c for c in ("cross_doc_count",) if c in entities.columns])
    after = after.join(kept, "name", "left") if len(kept.columns) > 1 else after
    after = written(counted(after, chunks, docs, found.select("name")), "entities")
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).first()
    stats = {"chunks_processed": int(sizes["chunks"]), "prompts": sizes["n"], "entities_found": n_found, "entities_merged": found.count(), "entities_registered": registered, "relations_added": edges.count()}
    return Built(after, relations.unionByName(edges, allowMissingColumns=True), stats)
