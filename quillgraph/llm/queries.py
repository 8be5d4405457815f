"""Registered queries of the llm operators and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe, lookalike, markup, names, packing, personal, pieces, sentences
from quillgraph.plans.skew import Bloom
from quillgraph.sources.tables import last_delivery, raw

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ids whose names or bodies differ as stored but look the same."""
    names = lookalike.look_pairs(raw(spark, sf_dir, "entities"), "id", "canonical_name", "entities")
    return names.unionByName(lookalike.look_pairs(raw(spark, sf_dir, "chunks"), "id", "body", "chunks"))


def p2_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name and body with the class of its look and its number of links; copies aren't expanded into pairs."""
    names = lookalike.look_classes(raw(spark, sf_dir, "entities"), "id", "canonical_name", "entities")
    return names.unionByName(lookalike.look_classes(raw(spark, sf_dir, "chunks"), "id", "body", "chunks"))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored name and body with its one consistent form."""

    def forms(table: str, text: str) -> DataFrame:
        return lookalike.consistent(raw(spark, sf_dir, table), "id", text).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "same_look")

    return forms("entities", "canonical_name").unionByName(forms("chunks", "body"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entity id with its group of ids that mean the same, and its number of links."""
    groups = names.link(raw(spark, sf_dir, "entities"), raw(spark, sf_dir, "name_forms"))
    return names.classes(groups).select("id", F.col("group").alias("group_id"), "n_links")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of entity ids that mean the same person, work, idea, school, event or place."""
    return names.pairs(names.link(raw(spark, sf_dir, "entities"), raw(spark, sf_dir, "name_forms")))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(table: str, text: str) -> DataFrame:
        return markup.cleaned(raw(spark, sf_dir, table), "id", text).select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "clean", "markup", "blocks")

    return rows("chunks", "body").unionByName(rows("docs", "title"))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every body and title as clean text, with where its headings, items, code, formulas, quotes and tables lie."""
    return _marked(spark, sf_dir)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The markup languages left in each body and title."""
    return _marked(spark, sf_dir).select("table_name", F.col("row_id").cast("bigint"), F.explode("markup").alias("markup")).distinct()


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all chunks over 1,500 characters; of several such deliveries of an id the latest counts."""
    big = raw(spark, sf_dir, "chunks").select("id", "body", "section_path", "heading_level", "loaded_at").filter(F.length("body") > pieces.LIMIT)
    chunks = last_delivery(big, "id", "body")
    out = pieces.split(chunks, "id", "body", pieces.LIMIT, pieces.OVERLAP, ("section_path", "heading_level"))
    return out.withColumnRenamed("id", "chunk_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that were split, with the finest boundary that keeps all their units within the limit."""
    return p6_pieces(spark, sf_dir).filter("piece = 0").select("chunk_id", "level")


def p7_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every chunk; repeated deliveries give the same ones, which count once."""
    found = sentences.sentences(raw(spark, sf_dir, "chunks"), "id", "body").withColumnRenamed("id", "chunk_id")
    return found.select("chunk_id", "start_pos", "end_pos").distinct()


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the sentences of the sampled chunks end.

    A Bloom filter of the sample's ids spares most other bodies the shuffle; the exact semi-join follows, and only the
    bodies that are left are split.
    """
    sample = raw(spark, sf_dir, "sentence_sample").select(F.col("chunk_id").alias("id")).distinct()
    chunks = raw(spark, sf_dir, "chunks").select("id", "body", "loaded_at").filter(F.col("body").isNotNull())
    chunks = chunks.withColumn("k", F.col("id").cast("string"))
    chunks = Bloom(sample.select(F.col("id").cast("string").alias("k")), "k").test(chunks, "k").filter("maybe").drop("k", "maybe")
    bodies = last_delivery(chunks.join(sample, "id", "left_semi"), "id", "body")
    return sentences.sentences(bodies, "id", "body").select(F.col("id").alias("chunk_id"), "end_pos")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as its list of byte_bpe_50k ids."""
    return bpe.encode(raw(spark, sf_dir, "documents"), "doc_id", "text")


CAPACITY = 2048


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place (or places, if it is longer than a container) in containers of 2,048 tokens."""
    return packing.pack(packing.sized(raw(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p9_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    full = p9_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n").alias("used"), F.count(F.lit(1)).alias("items"))
    return full.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"), F.round(F.sum("used") / (F.count(F.lit(1)) * CAPACITY), 6).alias("fill"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of a private person, with its kind and place."""
    return personal.find(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "entities"), raw(spark, sf_dir, "name_forms"))


def p10_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many mentions of each kind the patterns and forms of each round tell, and how many of these are seeds."""
    found = personal.judged(raw(spark, sf_dir, "documents"), raw(spark, sf_dir, "entities"), raw(spark, sf_dir, "name_forms"))
    return found.groupBy("kind", "round").agg(F.count(F.lit(1)).alias("n_mentions"), F.sum(F.when(F.col("seed") != "", 1).otherwise(0)).alias("n_seeds"))


def p10_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its mentions replaced by typed placeholders."""
    return personal.mask(raw(spark, sf_dir, "documents"), p10_found(spark, sf_dir))


QUERIES: dict[str, Query] = {"p2_found": p2_found, "p2_classes": p2_classes, "p2_forms": p2_forms, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_clean": p5_clean, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_found": p7_found, "p7_sentences": p7_sentences, "p8_ids": p8_ids, "p9_containers": p9_containers, "p9_fill": p9_fill, "p10_found": p10_found, "p10_masked": p10_masked, "p10_rounds": p10_rounds}
ORACLE: dict[str, str] = {}
