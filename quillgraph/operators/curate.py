"""Building the graph from chunks: sampling, prompts, extraction, validation, merging; and keeping it up."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.domain import is_noise, valid_triplets
from quillgraph.functions.text import ascii_lower, strip
from quillgraph.plans.grams import grams_of, texts_with
from quillgraph.plans.skew import Bloom, in_order, join_many, join_unique
from quillgraph.session import written

MOST_CHUNKS, PER_PROMPT, PROMPT_CHARS, JOINT = 30, 3, 15_000, "\n\n---\n\n"
BATCH, BATCH_CHARS, TEXT_CHARS, LEAST_CHARS = 32, 80_000, 30_000, 10


class Extractor(Protocol):
    """Finds entities and relations in a prompt; runs in executors, so it must be picklable."""

    def __call__(self, prompt: str) -> dict: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def capitalised(prompt: str) -> dict:
    """The deterministic extractor: capitalised words of at least six letters are concepts, neighbours mention each other."""
    import re

    names = list(dict.fromkeys(w for w in re.split(r"[^A-Za-z]+", prompt) if re.fullmatch(r"[A-Z][a-z]{5,}", w)))
    return {"entities": [{"name": n, "type": "concept", "aliases": [], "description": ""} for n in names], "relations": [{"entity_a": a, "entity_b": b, "type": "MENTIONS"} for a, b in zip(names, names[1:], strict=False)]}


def sample(chunks: DataFrame, mode: str = "sample", rate: float = 0.3, most: int = MOST_CHUNKS) -> DataFrame:
    """chunk_id, body: all chunks (full) or evenly spaced ones, max(10, sqrt(characters) * rate) of them; at most `most` (MOST_CHUNKS).

    Two passes: the count and sum first, then the rows whose number (by id) is floor(i * step); numbers come from one
    ordered window over ids alone, bodies join at the end.
    """
    ids = chunks.select("chunk_id", F.length("body").alias("n"))
    total, chars = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    target = max(10, int(chars**0.5 * rate))
    if mode == "full" or target >= total:
        every = chunks.select("chunk_id", "body")
        return every if total <= most else every.orderBy("chunk_id").limit(most)
    step = total / target
    wanted = [int(i * step) for i in range(min(target, most))]
    # only the first max(wanted) + 1 ids can be meant: a top-k, not a global window
    low = ids.orderBy("chunk_id").limit(max(wanted) + 1).withColumn("rn", F.row_number().over(Window.orderBy("chunk_id")) - 1)
    return chunks.join(F.broadcast(low.filter(F.col("rn").isin(wanted)).select("chunk_id")), "chunk_id").select("chunk_id", "body")  # at most `most` ids


def prompts(sampled: DataFrame) -> DataFrame:
    """batch, part, prompt, n_chunks: groups of PER_PROMPT chunks in id order, split where PROMPT_CHARS would be passed.

    Its input may be a sample or all chunks: rows are numbered by ranges. The fold over a group is a higher-order aggregate.
    """
    rows = in_order(sampled, "place", "chunk_id").withColumn("batch", F.floor(F.col("place") / PER_PROMPT))
    groups = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("chunk_id", "body"))).alias("items"))
    start = F.struct(F.array().cast("array<struct<part:int,body:string>>").alias("done"), F.lit(0).alias("part"), F.lit(0).alias("used"))

    def add(state: Column, item: Column) -> Column:
        n = F.length(item["body"])
        over = (state["used"] + n > PROMPT_CHARS) & (state["used"] > 0)
        part = state["part"] + over.cast("int")
        done = F.concat(state["done"], F.array(F.struct(part.alias("part"), item["body"].alias("body"))))
        return F.struct(done.alias("done"), part.alias("part"), F.when(over, n).otherwise(state["used"] + n).alias("used"))

    placed = groups.select("batch", F.explode(F.aggregate("items", start, add, lambda s: s["done"])).alias("x"))
    return placed.groupBy("batch", F.col("x.part").alias("part")).agg(F.array_join(F.collect_list("x.body"), JOINT).alias("prompt"), F.count(F.lit(1)).alias("n_chunks"))


def extract(asked: DataFrame, extractor: Extractor = capitalised, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """Entities (name, type, aliases, description, ord) and relations (entity_a, entity_b, relation_type, ord) found in prompts.

    Each task asks the extractor, again after a failure, and skips prompts that fail every time or give no dictionary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("what", pa.string()), ("a", pa.string()), ("b", pa.string()), ("kind", pa.string()), ("aliases", pa.list_(pa.string())), ("ord", pa.int64())])
        for batch in batches:
            rows = []
            for number, part, prompt in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                answer = None
                for _ in range(attempts):
                    try:
                        answer = extractor(prompt)
                        break
                    except Exception:  # asked again
                        continue
                if not isinstance(answer, dict) or "entities" not in answer:
                    continue
                base = (number * 1000 + part) * 100_000
                rows += [{"what": "entity", "a": (e.get("name") or "").strip(), "b": e.get("description") or "", "kind": e.get("type") or "concept", "aliases": list(e.get("aliases") or []), "ord": base + i} for i, e in enumerate(answer["entities"])]
                rows += [{"what": "relation", "a": (r.get("entity_a") or "").strip(), "b": (r.get("entity_b") or "").strip(), "kind": (r.get("type") or "").strip(), "aliases": [], "ord": base + i} for i, r in enumerate(answer.get("relations") or [])]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    found = asked.select(F.col("batch").cast("long"), F.col("part").cast("long"), "prompt").mapInArrow(run, "what string, a string, b string, kind string, aliases array<string>, ord long")
    entities = found.filter("what = 'entity' AND a <> ''").select(F.col("a").alias("name"), F.col("kind").alias("type"), "aliases", F.col("b").alias("description"), "ord")
    relations = found.filter("what = 'relation' AND a <> '' AND b <> '' AND kind <> ''").select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"), F.col("kind").alias("relation_type"), "ord")
    return entities, relations


def merge_entities(found: DataFrame) -> DataFrame:
    """One row a name: the first mention's type and description, all mentions' aliases (without the name itself)."""
    first = F.min_by(F.struct("type", "description"), "ord")
    merged = found.groupBy("name").agg(first.alias("f"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"))
    return merged.select("name", "f.type", "f.description", F.array_remove("aliases", F.col("name")).alias("aliases"))


def without_noise(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities that carry knowledge, and relations none of whose ends is one of the noise entities."""
    noise = entities.filter(is_noise(F.col("name"))).select("name").distinct()
    kept = relations.join(noise.withColumnRenamed("name", "entity_a"), "entity_a", "left_anti").join(noise.withColumnRenamed("name", "entity_b"), "entity_b", "left_anti")
    return entities.filter(~is_noise(F.col("name"))), kept


def checked_relations(relations: DataFrame, entities: DataFrame, validators: Sequence[Callable[[Column, Column, Column], Column]] = (), strict: bool = False) -> DataFrame:
    """Relations whose ends are among the entities and whose triplet the domain and all validators allow; each once."""
    kinds = entities.select("name", "type")
    typed = relations.join(kinds.withColumnsRenamed({"name": "entity_a", "type": "type_a"}), "entity_a").join(kinds.withColumnsRenamed({"name": "entity_b", "type": "type_b"}), "entity_b")
    good = valid_triplets(typed, strict)
    for check in validators:
        good = good.filter(check(F.split_part("type_a", F.lit("."), F.lit(1)), F.col("relation_type"), F.split_part("type_b", F.lit("."), F.lit(1))))
    return good.select("entity_a", "entity_b", "relation_type", "schema_weight").dropDuplicates(["entity_a", "entity_b", "relation_type"])


def upsert_entities(old: DataFrame, new: DataFrame, docs: Sequence[str]) -> DataFrame:
    """name, entity_type, aliases, description, source, source_docs after a run over docs.

    Known entities keep their type; description and aliases are replaced if the new description isn't empty; documents
    are united. New ones come with source "auto". One full outer join on the name.
    """
    n = new.select("name", F.col("type").alias("new_type"), F.col("aliases").alias("new_aliases"), F.col("description").alias("new_description"), F.lit(True).alias("told"))
    o = old.select("name", "entity_type", "aliases", "description", "source", "source_docs", F.lit(True).alias("known"))
    both = o.join(n, "name", "full")
    fresh = F.col("told") & (F.coalesce(F.length("new_description"), F.lit(0)) > 0)
    run_docs = F.array(*[F.lit(str(d)) for d in docs]) if docs else F.array().cast("array<string>")
    empty = F.array().cast("array<string>")
    return both.select(
        "name", F.coalesce("entity_type", "new_type").alias("entity_type"), F.when(F.col("known").isNull() | fresh, F.coalesce("new_aliases", "aliases")).otherwise(F.col("aliases")).alias("aliases"),
        F.when(F.col("known").isNull() | fresh, F.coalesce("new_description", "description")).otherwise(F.col("description")).alias("description"), F.coalesce("source", F.lit("auto")).alias("source"),
        F.when(F.col("told"), F.array_union(F.coalesce("source_docs", empty), run_docs)).otherwise(F.col("source_docs")).alias("source_docs"),
    )


def new_relations(old: DataFrame, found: DataFrame) -> DataFrame:
    """Relations of found that old lacks, each once, with the weight the domain gives their type (1 if none)."""
    once = found.dropDuplicates(["entity_a", "entity_b", "relation_type"])
    return once.join(old.select("entity_a", "entity_b", "relation_type"), ["entity_a", "entity_b", "relation_type"], "left_anti").select("entity_a", "entity_b", "relation_type", F.coalesce("schema_weight", F.lit(1.0)).alias("weight"))


def mention_counts(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, n_docs: in how many documents the name occurs, by containment without ASCII case; names that don't occur are left out.

    Every text gives its grams of bytes that names have, and they are counted; a name is then met by the one of its
    grams that the fewest texts have, so what many names share, or many texts, doesn't pair them. A name with a gram
    that no text has occurs nowhere. Containment is checked on the bodies of the texts that met a name. Neither names
    nor texts are limited or reach the driver. Empty names and null documents don't count.
    """
    folded = written(names.select("name", ascii_lower(F.col("name")).alias("low")).filter("low <> ''").distinct(), "mention-names")
    texts = chunks.filter("body <> '' AND doc_id IS NOT NULL").select(F.monotonically_increasing_id().alias("__row"), F.col("doc_id").cast("string"), ascii_lower(F.col("body")).alias("body"))
    texts = written(texts, "mention-texts")
    grams = written(grams_of(folded.select("low").distinct(), "low"), "mention-grams")
    held = join_unique(grams, texts_with(grams, texts, "__row", "body", count=True), "gram")
    rarest = held.groupBy("low").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "size")).alias("r"))
    rarest = written(rarest.filter("r.n > 0").select("low", "r.gram", "r.size"), "mention-rarest")
    some = texts_with(rarest, texts, "__row", "body")
    met = written(join_many(some, rarest.select("low", "gram"), "gram").select("__row", "low"), "mention-pairs")
    asked = Bloom(met, "__row").test(texts, "__row").filter("maybe").select("__row", "doc_id", "body")
    hits = join_unique(met, asked, "__row", "inner").filter(F.contains("body", "low"))
    return folded.join(hits.groupBy("low").agg(F.countDistinct("doc_id").alias("n_docs")), "low").select("name", "n_docs")


def verified_counts(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """name, n_docs: how many of an entity's source documents exist."""
    told = entities.select("name", F.explode("source_docs").alias("d")).distinct()
    return told.join(docs.select(F.col("doc_id").cast("string").alias("d")), "d").groupBy("name").agg(F.countDistinct("d").alias("n_docs"))


def embed_batches(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, batch, part, n_chars: how rows are sent to an embedder: BATCH rows by key, split at BATCH_CHARS.

    Texts are cut to TEXT_CHARS; those under LEAST_CHARS are skipped. Numbers come from a window within ranges of keys
    (key divided by BATCH), so no task numbers the whole table; the fold over a batch is a higher-order aggregate.
    """
    cut = rows.select(F.col(key).alias("key"), F.floor((F.col(key) - 1) / BATCH).alias("batch"), F.substring(text, 1, TEXT_CHARS).alias("t"))
    kept = cut.filter(F.length(strip(F.col("t"))) >= LEAST_CHARS).select("key", "batch", F.length("t").alias("n"))
    groups = kept.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("items"))
    start = F.struct(F.array().cast("array<struct<key:bigint,part:int,n:int>>").alias("done"), F.lit(0).alias("part"), F.lit(0).alias("used"))

    def add(state: Column, item: Column) -> Column:
        over = (state["used"] + item["n"] > BATCH_CHARS) & (state["used"] > 0)
        part = state["part"] + over.cast("int")
        done = F.concat(state["done"], F.array(F.struct(item["key"].alias("key"), part.alias("part"), item["n"].alias("n"))))
        return F.struct(done.alias("done"), part.alias("part"), F.when(over, item["n"]).otherwise(state["used"] + item["n"]).alias("used"))

    return groups.select("batch", F.explode(F.aggregate("items", start, add, lambda s: s["done"])).alias("x")).select(F.col("x.key").alias(key), "batch", F.col("x.part").alias("part"), F.col("x.n").cast("bigint").alias("n_chars"))


def embed(rows: DataFrame, key: str, text: str, embedder: Embedder, width: int) -> DataFrame:
    """key, embedding of every row with a text worth it; a batch that fails is skipped, a vector of another width is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at in range(0, len(keys), BATCH):
                some = [(k, t[:TEXT_CHARS]) for k, t in zip(keys[at : at + BATCH], texts[at : at + BATCH], strict=True) if t and len(t.strip()) >= LEAST_CHARS]
                if not some:
                    continue
                try:
                    vectors = embedder([t for _, t in some])
                except Exception:  # a failed batch is skipped
                    continue
                if any(len(v) != width for v in vectors):
                    raise ValueError(f"vectors must have {width} numbers")
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], pa.int64()), pa.array(vectors, pa.list_(pa.float32()))], ["key", "embedding"])

    return rows.select(F.col(key).cast("long").alias("key"), text).mapInArrow(run, "key long, embedding array<float>").withColumnRenamed("key", key)


# Keeping the graph up.


def register(entities: DataFrame, wanted: DataFrame) -> DataFrame:
    """name, ok, reason for wanted rows (name, entity_type, book, target): known names and rows without any tie are refused.

    The ties must exist as entities, so no orphan is made.
    """
    known = entities.select("name").distinct()
    flag = lambda c: known.select(F.col("name").alias(c), F.lit(True).alias(f"has_{c}"))
    joined = wanted.join(known.withColumn("exists", F.lit(True)), "name", "left").join(flag("book"), "book", "left").join(flag("target"), "target", "left")
    reason = F.when(F.col("exists"), "known").when(F.col("book").isNull() & F.col("target").isNull(), "no tie").when(F.col("book").isNotNull() & F.col("has_book").isNull() | F.col("target").isNotNull() & F.col("has_target").isNull(), "unknown tie").otherwise("")
    return joined.select("name", (reason == "").alias("ok"), reason.alias("reason"))


def connect(entities: DataFrame, relations: DataFrame, wanted: DataFrame, weight: float = 3.0) -> DataFrame:
    """New relations of wanted (entity_a, entity_b, relation_type): both ends must exist, known ones are left out."""
    known = entities.select("name").distinct()
    ends = wanted.dropDuplicates(["entity_a", "entity_b", "relation_type"]).join(known.withColumnRenamed("name", "entity_a"), "entity_a", "left_semi").join(known.withColumnRenamed("name", "entity_b"), "entity_b", "left_semi")
    return ends.join(relations, ["entity_a", "entity_b", "relation_type"], "left_anti").select("entity_a", "entity_b", "relation_type", F.lit(weight).alias("weight"))


def annotate(relations: DataFrame, remarks: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """rel_id, notes: remarks (entity_a, entity_b, relation_type or null for all, note) on edges, each note once.

    Stored notes (rel_id, notes: array) are kept and united with the new ones; edges with neither don't come out.
    """
    r = relations.alias("r")
    n = remarks.alias("n")
    met = r.join(n, (F.col("r.entity_a") == F.col("n.entity_a")) & (F.col("r.entity_b") == F.col("n.entity_b")) & (F.col("n.relation_type").isNull() | (F.col("r.relation_type") == F.col("n.relation_type"))))
    every = met.select("r.rel_id", "n.note")
    if stored is not None:
        every = every.unionByName(stored.select("rel_id", F.explode("notes").alias("note")))
    return every.groupBy("rel_id").agg(F.array_sort(F.collect_set("note")).alias("notes"))
