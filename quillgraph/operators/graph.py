"""The graph of entities and typed weighted relations: neighbours, navigation, anchors and guided thinking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.domain import root_of
from quillgraph.functions.text import has_text
from quillgraph.operators.search import entities_like
from quillgraph.session import written

HOPS_WIDE, HOPS_DEEP, WIDTH, DECAY = 6, 10, 3, 2.0
FOOTPRINT = {"record": 3, "navigate": 2, "search": 1}


def adjacency(relations: DataFrame) -> DataFrame:
    """src, dst, relation_type, weight, side (0 outgoing), rel_id: each edge from both ends, a loop once.

    Turns "either end is x" into an equality, so expansions are ordinary joins.
    """
    out = relations.select(F.col("entity_a").alias("src"), F.col("entity_b").alias("dst"), "relation_type", "weight", F.lit(0).alias("side"), "rel_id")
    back = relations.filter("entity_a <> entity_b").select(F.col("entity_b").alias("src"), F.col("entity_a").alias("dst"), "relation_type", "weight", F.lit(1).alias("side"), "rel_id")
    return out.unionByName(back)


def neighbours(adj: DataFrame, entities: DataFrame, names: DataFrame) -> DataFrame:
    """src, name, type, relation, weight, cross_doc_count, source_docs, side, rel_id of the neighbours of names (column src).

    Neighbours without a row have the type "unknown", no documents and no description.
    """
    known = entities.select("name", "entity_type", "cross_doc_count", "source_docs", "description")
    met = adj.join(names.select("src").distinct(), "src").join(known, F.col("dst") == F.col("name"), "left")
    return met.select(
        "src", F.col("dst").alias("name"), F.coalesce("entity_type", F.lit("unknown")).alias("type"), F.col("relation_type").alias("relation"), "weight", F.coalesce("cross_doc_count", F.lit(0)).alias("cross_doc_count"),
        F.coalesce("source_docs", F.array().cast("array<string>")).alias("source_docs"), F.coalesce("description", F.lit("")).alias("description"), "side", "rel_id",
    )


def navigate(relations: DataFrame, entities: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """seed, bucket ("anchored" or "exploration"), pos, neighbor, relation, weight for each seed (column seed).

    Anchored neighbours have a row and a weight of at least 1. At depth 2 the first 15 and 10 of the seed's own edges
    are followed by 10 and 10 of its best anchored neighbour's; 15 and 20 are shown. Ties go by side and edge id.
    """
    adj = adjacency(relations)
    known = entities.select(F.col("name").alias("dst"), F.lit(True).alias("has_row"))
    best_first = Window.partitionBy("seed").orderBy(F.col("weight").desc(), "side", "rel_id")

    def expand(frontier: DataFrame, anchored: int, exploration: int) -> DataFrame:
        # a literal limit a bucket: each task cuts a hub's edges before they are shuffled
        met = adj.join(frontier, "src").join(known, "dst", "left")
        firm = F.coalesce("has_row", F.lit(False)) & F.coalesce(F.col("weight") >= 1.0, F.lit(False))
        first = met.filter(firm).withColumns({"bucket": F.lit("anchored"), "pos": F.row_number().over(best_first)}).filter(F.col("pos") <= anchored)
        return first.unionByName(met.filter(~firm).withColumns({"bucket": F.lit("exploration"), "pos": F.row_number().over(best_first)}).filter(F.col("pos") <= exploration))

    shown = ["seed", "bucket", "hop", "pos", F.col("dst").alias("neighbor"), F.col("relation_type").alias("relation"), "weight"]
    start = seeds.join(entities.select(F.col("name").alias("seed")), "seed", "left_semi").withColumn("src", F.col("seed"))
    one = expand(start, 15, 20).withColumn("hop", F.lit(1))
    if depth < 2:
        return one.select(*shown).drop("hop")
    one = written(one, "first-hop")
    step = one.filter("bucket = 'anchored' AND pos = 1").select("seed", F.col("dst").alias("src"))
    two = expand(step, 10, 10).withColumn("hop", F.lit(2))
    two = two.withColumn("relation_type", F.when(F.col("bucket") == "anchored", F.concat("seed", F.lit("→"), "src", F.lit("→"))).otherwise(F.col("relation_type")))
    cut = one.join(step.select("seed", F.lit(True).alias("goes_on")), "seed", "left").filter("goes_on IS NULL OR bucket = 'anchored' OR pos <= 10")
    every = cut.select(*shown).unionByName(two.select(*shown))
    # at most 45 rows a seed are left
    every = every.withColumn("pos", F.row_number().over(Window.partitionBy("seed", "bucket").orderBy("hop", "pos")))
    return every.filter("pos <= CASE WHEN bucket = 'anchored' THEN 15 ELSE 20 END").drop("hop")


def footprint(traces: DataFrame) -> DataFrame:
    """name, footprint (0 to 1), hot: record counts three, navigate two, anything else one; hot by attention or sum."""
    worth = F.when(F.col("source") == "record", 3).when(F.col("source") == "navigate", 2).otherwise(1)
    keen = ((F.col("source") == "record") & (F.col("count") >= 2)) | ((F.col("source") == "navigate") & (F.col("count") >= 5))
    total = F.sum(F.col("count") * worth)
    return traces.groupBy("name").agg(F.least(total / 50.0, F.lit(1.0)).alias("footprint"), (F.max(keen.cast("int")) == 1).alias("keen"), (total >= 10).alias("much")).select("name", "footprint", (F.col("keen") | F.col("much")).alias("hot"))


def type_compat(anchor: Column, candidate: Column) -> Column:
    return (
        F.when(candidate.isNull() | candidate.isin("", "unknown"), 0.2).when(anchor == candidate, 1.0).when(root_of(candidate).isin("stem_branch", "element"), 0.1).when(root_of(anchor) == root_of(candidate), 0.7).otherwise(0.2)
    )


def coherence(anchor_type: Column, anchor_docs: Column, kind: Column, docs: Column, depth: Column | int) -> Column:
    """How well a candidate fits an anchor's topic: shared documents, type and depth; without documents type and depth."""
    fade = F.exp(-(F.lit(depth) if isinstance(depth, int) else depth) / DECAY)
    shared = F.size(F.array_intersect(anchor_docs, docs)) / F.greatest(F.size(anchor_docs), F.lit(1))
    with_docs = shared * 0.5 + type_compat(anchor_type, kind) * 0.3 + fade * 0.2
    return F.when(F.size(anchor_docs) > 0, with_docs).otherwise(type_compat(anchor_type, kind) * 0.6 + fade * 0.4)


def anchors(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """query, name, entity_type, tier: the entity each query (column query) stands for; queries without one are left out.

    Tiers: equal name; equal alias; an equal name or alias of one of its words, in order; the longest of its prefixes
    of 6 down to 2 characters that a name or alias contains. Ties go to the least entity id. The first three tiers are
    equi-joins on exploded names; a prefix is met by the pairs of neighbouring characters of names that equal its first
    two, and containment is checked among those that met.
    """
    entities = written(entities.select("entity_id", "name", "entity_type", "aliases"), "anchor-entities")
    queries = written(queries.select("query").distinct(), "anchor-queries")
    known = entities.select("entity_id", "name", "entity_type", F.col("name").alias("term"), F.lit(0).alias("by_alias")).unionByName(entities.select("entity_id", "name", "entity_type", F.explode("aliases").alias("term"), F.lit(1).alias("by_alias")))
    whole = queries.select("query", F.col("query").alias("term"), F.lit(0).alias("place"))
    words = queries.select("query", F.posexplode(F.filter(F.split("query", r"\s+"), lambda w: w != "")).alias("place", "term"))
    exact = whole.join(known, "term").withColumn("tier", F.col("by_alias") + 1)
    by_word = words.join(known, "term").withColumn("tier", F.lit(3))
    closed = exact.select("query").unionByName(by_word.select("query")).distinct()
    prefixes = queries.join(closed, "query", "left_anti").filter(F.length("query") >= 2).select("query", F.explode(F.sequence(F.least(F.length("query"), F.lit(6)), F.lit(2))).alias("n")).withColumn("term", F.substring(F.col("query"), F.lit(1), F.col("n")))
    asked = prefixes.select(F.lower("term").alias("prefix")).distinct().withColumn("pair", F.substring("prefix", 1, 2))
    pairs = F.array_distinct(F.regexp_extract_all(F.lower("term"), F.lit("(?s)(?=(..))"), F.lit(1)))
    low = known.select(F.lower("term").alias("low"), "entity_id", "name", "entity_type", F.explode(pairs).alias("pair"))
    met = low.join(asked, "pair").filter(F.contains("low", "prefix"))
    hits = met.groupBy("prefix").agg(F.min_by(F.struct("entity_id", "name", "entity_type"), "entity_id").alias("e"))
    like = prefixes.join(hits, F.lower("term") == F.col("prefix")).select("query", "e.*", F.lit(4).alias("tier"), (6 - F.col("n")).alias("place"))
    columns = ["query", "entity_id", "name", "entity_type", "tier", "place"]
    every = exact.select(*columns).unionByName(by_word.select(*columns)).unionByName(like.select(*columns))
    first = Window.partitionBy("query").orderBy("tier", "place", "entity_id")
    return every.withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("query", "name", "entity_type", "tier")


def candidates(entities: DataFrame, query: str, n: int = 10) -> DataFrame:
    """What to offer where no anchor is found."""
    return entities_like(entities, query).orderBy("entity_id").limit(n)


def topics(entities: DataFrame, names: DataFrame, book_id: int | None = None, book: str | None = None) -> DataFrame:
    """anchor, anchor_type, anchor_docs: the anchors' own documents, or the given book's (an unknown book gives none)."""
    if book is not None:
        ids = F.array(F.lit(str(book_id))) if book_id is not None else F.array().cast("array<string>")
    else:
        ids = F.col("source_docs")
    return entities.join(names.select(F.col("anchor").alias("name")).distinct(), "name", "left_semi").select(F.col("name").alias("anchor"), F.col("entity_type").alias("anchor_type"), ids.alias("anchor_docs"))


def think(relations: DataFrame, entities: DataFrame, traces: DataFrame, topic: DataFrame, mode: str = "divergent", max_depth: int | None = None) -> DataFrame:
    """anchor, depth, pos, name, type, relation, in_books, coherence, score: thinking from many anchors at once.

    Divergent thinking goes breadth first: per depth and anchor the WIDTH best unseen coherent neighbours, until one is
    hot, none is left or max_depth is reached. Deep thinking follows the one most coherent neighbour under a stricter
    threshold. A neighbour is seen once it is met, even if it was too incoherent (divergent mode); the first edge to it
    counts, by frontier order, side and edge id. A loop of at most max_depth rounds; each is one join over the adjacency
    and a written table, so plans don't grow and nothing is collected.
    """
    wide = mode == "divergent"
    depth_limit = max_depth or (HOPS_WIDE if wide else HOPS_DEEP)
    limit = F.when(F.size("anchor_docs") > 0, 0.3 if wide else 0.6).otherwise(0.2 if wide else 0.4)
    adj = written(adjacency(relations), "adjacency")
    most = relations.agg(F.greatest(F.coalesce(F.max("weight"), F.lit(1.0)), F.lit(1.0)).alias("most"))
    facts = entities.select(F.col("name").alias("dst"), "entity_type", "cross_doc_count", "source_docs")
    prints = footprint(traces).withColumnRenamed("name", "dst")
    seen = topic.select("anchor", F.col("anchor").alias("dst"))
    frontier = topic.select("anchor", F.col("anchor").alias("src"), F.lit(1).alias("place"))
    found = None
    for depth in range(1, depth_limit + 1):
        # the frontier is a few names an anchor; the first edge to each name is kept by an aggregate that is partial on the map side
        met = adj.join(frontier, "src").join(seen, ["anchor", "dst"], "left_anti").groupBy("anchor", "dst")
        met = met.agg(F.min(F.struct("place", "side", "rel_id")).alias("ord"), F.min_by(F.struct("relation_type", "weight"), F.struct("place", "side", "rel_id")).alias("e")).select("anchor", "dst", "ord", "e.*")
        met = met.join(topic, "anchor").join(facts, "dst", "left").join(prints, "dst", "left").crossJoin(F.broadcast(most))  # most is one row
        kind, docs = F.coalesce("entity_type", F.lit("unknown")), F.coalesce("source_docs", F.array().cast("array<string>"))
        scored = met.withColumn("fit", coherence(F.col("anchor_type"), F.col("anchor_docs"), kind, docs, depth)).withColumn("close", F.col("fit") >= limit)
        strength = F.least(F.col("weight") / F.col("most"), F.lit(1.0)) * (0.5 ** (depth - 1))
        score = strength * 0.5 + F.coalesce("footprint", F.lit(0.0)) * 0.3 + F.least(F.coalesce("cross_doc_count", F.lit(0)) / 50.0, F.lit(1.0)) * 0.2
        scored = scored.withColumn("score", score if wide else F.col("fit"))
        scored = scored.select("anchor", F.lit(depth).alias("depth"), "dst", kind.alias("type"), F.col("relation_type").alias("relation"), F.coalesce("cross_doc_count", F.lit(0)).alias("in_books"), "fit", "score", "close", "ord", F.coalesce("hot", F.lit(False)).alias("hot"))
        best = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "ord")
        if wide:  # every neighbour met counts as seen, so all are kept for the later rounds
            step = written(scored, "thought")
        top = (step if wide else scored).filter("close").withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= (WIDTH if wide else 1)).drop("close", "ord")
        kept = top if wide else written(top, "thought")
        found = kept if found is None else found.unionByName(kept)
        seen = seen.unionByName((step if wide else kept).select("anchor", "dst"))
        going = kept
        if wide:
            going = kept.join(kept.filter("hot").select("anchor").distinct(), "anchor", "left_anti")
        frontier = going.select("anchor", F.col("dst").alias("src"), F.col("pos").alias("place"))
        if not frontier.limit(1).count():
            break
    return found.select("anchor", "depth", "pos", F.col("dst").alias("name"), "type", "relation", "in_books", F.round("fit", 3).alias("coherence"), "score")


def stats(docs: DataFrame, entities: DataFrame, relations: DataFrame, insights: DataFrame) -> DataFrame:
    """what, n: how many rows each table has."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in (("docs", docs), ("entities", entities), ("relations", relations), ("insights", insights))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relation_types(relations: DataFrame) -> DataFrame:
    return relations.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"))


def entity_card(name: str, entities: DataFrame, relations: DataFrame, insights: DataFrame, docs: DataFrame, traces: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """section, pos, item, detail: an entity with its 20 heaviest relations, up to 10 notes and 10 books, and its footprint.

    If its source_docs give no book, those with a chunk that contains its name, if chunks are given.
    """
    entity = entities.filter(F.col("name") == name)
    head = entity.select(F.lit("entity").alias("section"), F.lit(1).alias("pos"), F.col("name").alias("item"), F.col("entity_type").alias("detail"))
    near = adjacency(relations).filter(F.col("src") == name).orderBy(F.col("weight").desc(), "side", "rel_id").limit(20)
    w = Window.orderBy(F.col("weight").desc(), "side", "rel_id")
    edges = near.select(F.lit("relation").alias("section"), F.row_number().over(w).alias("pos"), F.col("dst").alias("item"), F.col("relation_type").alias("detail"))
    told = insights.filter(F.exists("entities", lambda e: has_text(e, name))).orderBy("insight_id").limit(10)
    notes = told.select(F.lit("note").alias("section"), F.row_number().over(Window.orderBy("insight_id")).alias("pos"), F.col("title").alias("item"), F.col("slug").alias("detail"))
    books = entity.select(F.explode("source_docs").alias("d")).distinct().join(docs, F.col("d") == F.col("doc_id").cast("string")).orderBy("doc_id").limit(10)
    if chunks is not None and books.isEmpty():
        named = chunks.filter(has_text(F.col("body"), name)).join(F.broadcast(entity.select("name").limit(1)), F.lit(True)).select("doc_id")  # one row, or none
        books = docs.join(named.distinct(), "doc_id", "left_semi").orderBy("doc_id").limit(10)
    shelf = books.select(F.lit("book").alias("section"), F.row_number().over(Window.orderBy("doc_id")).alias("pos"), F.col("title").alias("item"), F.col("doc_id").cast("string").alias("detail"))
    trail = traces.filter(F.col("name") == name).select(F.lit("footprint").alias("section"), F.row_number().over(Window.orderBy("source")).alias("pos"), F.col("source").alias("item"), F.col("count").cast("string").alias("detail"))
    out = head
    for p in (edges, notes, shelf, trail):
        out = out.unionByName(p)
    return out
