"""Full-text, substring and vector search over chunks and notes, and their fusion."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import has_text, terms
from quillgraph.session import forget, written

K1, B, FLOOR = 1.2, 0.75, 1e-6


def postings(df: DataFrame, key: str, *texts: str) -> DataFrame:
    """key, term, tf, length: one row for each term of each row.

    Counted on the map side within each row, so nothing is shuffled but what the caller groups.
    """
    words = F.flatten(F.array(*[terms(F.coalesce(F.col(t), F.lit(""))) for t in texts]))
    listed = df.select(key, words.alias("words")).withColumn("length", F.size("words"))
    return listed.select(key, "length", F.explode("words").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf")).select(key, "term", "tf", "length")


class TextIndex:
    """A written full-text index of rows: their postings, laid in order of terms, and the rows' lengths beside them.

    Postings are split by ranges of (term, row), so a term that every row has is spread over files, and each file's
    statistics let a search read only where its terms are. Building takes one pass over the texts; searches read no
    text. Rows without any term have a length of 0.
    """

    def __init__(self, df: DataFrame, key: str, *texts: str) -> None:
        self.key = key
        words = F.flatten(F.array(*[terms(F.coalesce(F.col(t), F.lit(""))) for t in texts]))
        listed = written(df.select(key, words.alias("words")), "terms")
        self.lengths = written(listed.select(key, F.size("words").alias("length")), "lengths")
        counted = listed.select(key, F.size("words").alias("length"), F.explode("words").alias("term")).groupBy(key, "length", "term").agg(F.count(F.lit(1)).alias("tf"))
        self.postings = written(counted.repartitionByRange("term", key).sortWithinPartitions("term", key), "postings")
        forget(listed)

    def search(self, query: Sequence[str], within: DataFrame | None = None) -> DataFrame:
        """key, rank of the rows that have every query term as the prefix of some term; smaller is better.

        rank is minus the sum of idf times saturated counts; a prefix counts all terms that begin with it. idf falls
        back to FLOOR where it isn't positive. within (a table with the key) makes these rows the whole corpus, its
        figures included. No usable term gives no rows. What is joined as a single row are the corpus figures.
        """
        key, usable = self.key, [t for t in dict.fromkeys(query) if t]
        if not usable:
            return self.lengths.select(key, F.lit(0.0).alias("rank")).filter(F.lit(False))
        inside = (lambda df: df.join(within.select(key).distinct(), key, "left_semi")) if within is not None else (lambda df: df)
        begins = [F.startswith("term", F.lit(t)) for t in usable]
        met = inside(self.postings.filter(reduce(Column.__or__, begins)))
        hits = met.groupBy(key, "length").agg(*[F.sum(F.when(b, F.col("tf")).otherwise(0)).alias(f"f{i}") for i, b in enumerate(begins)])
        figures = inside(self.lengths).agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"))
        counts = hits.agg(*[F.coalesce(F.sum(F.when(F.col(f"f{i}") > 0, 1).otherwise(0)), F.lit(0)).alias(f"n{i}") for i in range(len(usable))])
        found = hits.filter(reduce(Column.__and__, [F.col(f"f{i}") > 0 for i in range(len(usable))]))

        def part(i: int) -> Column:
            n, f = F.col(f"n{i}"), F.col(f"f{i}")
            raw_idf = F.log((F.col("rows") - n + 0.5) / (n + 0.5))
            idf = F.when(raw_idf > 0, raw_idf).otherwise(FLOOR)
            return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))

        one = figures.crossJoin(F.broadcast(counts))  # one row each
        return found.crossJoin(F.broadcast(one)).select(key, (-reduce(Column.__add__, [part(i) for i in range(len(usable))])).alias("rank"))


def bm25(df: DataFrame, key: str, texts: Sequence[str], query: Sequence[str], index: TextIndex | None = None) -> DataFrame:
    """key, rank of df's rows by TextIndex.search; without an index of the rows' texts one is written first."""
    return index.search(query, df.select(key)) if index is not None else TextIndex(df, key, *texts).search(query)


def knn(vectors: DataFrame, key: str, vector: str, query: Sequence[float], k: int) -> DataFrame:
    """key, distance of the k nearest rows by Euclidean distance; ties by key. Rows of another width are an error.

    An exact scan, all JVM side, that ends in a top-k of each partition, so only k rows a task are sent on.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    fits = F.assert_true(F.size(vector) == len(query), F.lit("vectors of another width"))
    squares = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    rows = vectors.filter(F.col(vector).isNotNull()).withColumn("__fits", fits).filter(F.col("__fits").isNull())
    return rows.select(key, F.sqrt(squares).alias("distance")).orderBy("distance", key).limit(k)


def knn_many(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """query, key, distance, pos: the k nearest rows of each query vector (columns query and vector), ties by key.

    Queries come in blocks of at most `block`, each broadcast and compared with all rows in one exact scan; the top-k of
    every query is cut in each task before anything is shuffled. Null vectors are left out, another width is an error.
    """
    asked = queries.filter(F.col("vector").isNotNull()).withColumn("__block", F.floor(F.row_number().over(Window.orderBy("query")) / block))  # a stated query set: few rows
    asked = written(asked, "asked", "__block")
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(key).alias("__key"), F.col(vector).cast("array<double>").alias("__v"))
    out = None
    for (at,) in sorted(asked.select("__block").distinct().collect()):
        some = asked.filter(F.col("__block") == at).select("query", F.col("vector").cast("array<double>").alias("__q"))
        pairs = rows.join(F.broadcast(some), F.assert_true(F.size("__v") == F.size("__q"), F.lit("vectors of another width")).isNull())  # at most `block` rows
        squares = F.aggregate(F.zip_with("__v", "__q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
        near = pairs.select("query", F.col("__key").alias(key), F.sqrt(squares).alias("distance"))
        best = near.withColumn("pos", F.row_number().over(Window.partitionBy("query").orderBy("distance", key))).filter(F.col("pos") <= k)
        out = best if out is None else out.unionByName(best)
    return out if out is not None else rows.select(F.lit(None).cast("long").alias("query"), F.col("__key").alias(key), F.lit(0.0).alias("distance"), F.lit(0).alias("pos")).filter(F.lit(False))


def fused(tiers: Sequence[tuple[str, DataFrame]], key: str, top_n: int) -> DataFrame:
    """key, source, tier, pos: results of several searches, earlier tiers first, each key once in its first tier.

    Each tier has key and pos (its own order) and is already cut to a few rows.
    """
    union = reduce(DataFrame.unionByName, [df.select(key, "pos").withColumns({"source": F.lit(name), "tier": F.lit(i)}) for i, (name, df) in enumerate(tiers)])
    first = Window.partitionBy(key).orderBy("tier", "pos")
    return union.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn").orderBy("tier", "pos").limit(top_n)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """pos by the order; for results already cut to a few rows."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def hybrid(chunks: DataFrame, docs: DataFrame, query: str, query_terms: Sequence[str] | None, top_n: int = 5, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, body_max: int | None = 500, rerank: Callable[[str, list[str]], list[tuple[int, float]]] | None = None, index: TextIndex | None = None) -> DataFrame:
    """pos, chunk_id, doc_id, section_path, body, title, source: full text, then substrings, then vectors.

    Only chunks of known documents count; orphan vectors don't use up places, as they are joined before the cut. Without
    query_terms (no tokenizer) full text is skipped. A reranker sees the few fused rows on the driver; what it doesn't
    score follows in the old order, and if it fails the old order stays.
    """
    known = chunks.join(docs.select("doc_id", "title"), "doc_id")
    tiers = []
    if query_terms:
        tiers.append(("text", numbered(bm25(known, "chunk_id", ["body"], query_terms, index).orderBy("rank", "chunk_id").limit(top_n * 3), F.col("rank"), F.col("chunk_id"))))
    like = known.filter(has_text(F.col("body"), query)).select("chunk_id").orderBy("chunk_id").limit(top_n * 3)
    tiers.append(("text", numbered(like, F.col("chunk_id"))))
    if vectors is not None and query_vector:
        near = knn(vectors.join(known.select("chunk_id"), "chunk_id", "left_semi"), "chunk_id", "embedding", query_vector, top_n * 2)
        tiers.append(("vector", numbered(near, F.col("distance"), F.col("chunk_id"))))
    best = fused(tiers, "chunk_id", top_n * 8 if rerank else top_n)
    body = F.substring("body", 1, body_max) if body_max else F.col("body")
    rows = known.join(F.broadcast(best), "chunk_id").select("tier", "pos", "chunk_id", "doc_id", "section_path", body.alias("body"), "title", "source")  # best is at most 8 * top_n rows
    ordered = rows.withColumn("pos", F.row_number().over(Window.orderBy("tier", "pos"))).drop("tier")
    if rerank is None:
        return ordered.orderBy("pos")
    few = ordered.orderBy("pos").collect()
    try:
        scored = [i for i, _ in rerank(query, [r["body"] for r in few]) if 0 <= i < len(few)]
    except Exception:  # a reranker that fails leaves the order as it is
        scored = []
    order = [*dict.fromkeys(scored), *(i for i in range(len(few)) if i not in set(scored))][:top_n]
    return rows.sparkSession.createDataFrame([few[i].asDict() | {"pos": p} for p, i in enumerate(order, 1)], ordered.schema)


def in_book(chunks: DataFrame, docs: DataFrame, query: str, book: str, query_terms: Sequence[str] | None, top_n: int = 3, index: TextIndex | None = None) -> DataFrame:
    """pos, book, section, body: full text within one book (exact title), then substrings fill what is missing.

    The fill takes as many rows as are missing before it drops those already found, so fewer may come out.
    """
    inside = chunks.join(docs.filter(F.col("title") == book).select("doc_id", "title"), "doc_id")
    text = numbered(bm25(inside, "chunk_id", ["body"], query_terms or [], index).orderBy("rank", "chunk_id").limit(top_n), F.col("rank"), F.col("chunk_id"))
    have = text.count()
    like = numbered(inside.filter(has_text(F.col("body"), query)).select("chunk_id").orderBy("chunk_id").limit(top_n - have), F.col("chunk_id")) if have < top_n else None
    best = fused([("text", text), *([("like", like)] if like is not None else [])], "chunk_id", top_n)
    rows = inside.join(F.broadcast(best), "chunk_id")  # at most top_n rows
    return rows.select(F.row_number().over(Window.orderBy("tier", "pos")).alias("pos"), F.col("title").alias("book"), F.col("section_path").alias("section"), "body")


def notes(insights: DataFrame, query: str, query_terms: Sequence[str], top_n: int = 5, vectors: DataFrame | None = None, query_vector: Sequence[float] | None = None, index: TextIndex | None = None) -> DataFrame:
    """pos, insight_id, slug, title, content (300 characters), source: full text over title and content, then substrings, newest first.

    Vectors (insight_id, embedding), if given with the query's, come last.
    """
    text = numbered(bm25(insights, "insight_id", ["title", "content"], query_terms, index).orderBy("rank", "insight_id").limit(top_n * 2), F.col("rank"), F.col("insight_id"))
    like = insights.filter(has_text(F.col("title"), query) | has_text(F.col("content"), query)).orderBy(F.col("created_at").desc(), "insight_id").limit(top_n * 2)
    tiers = [("fts", text), ("like", numbered(like, F.col("created_at").desc(), F.col("insight_id")))]
    if vectors is not None and query_vector:
        near = knn(vectors.join(insights.select("insight_id"), "insight_id", "left_semi"), "insight_id", "embedding", query_vector, top_n * 2)
        tiers.append(("vector", numbered(near, F.col("distance"), F.col("insight_id"))))
    best = fused(tiers, "insight_id", top_n)
    rows = insights.join(F.broadcast(best), "insight_id")  # at most top_n rows
    return rows.select(F.row_number().over(Window.orderBy("tier", "pos")).alias("pos"), "insight_id", "slug", "title", F.substring("content", 1, 300).alias("content"), "source")


def entities_like(entities: DataFrame, query: str, entity_type: str = "") -> DataFrame:
    """Entities whose name or one of whose aliases contains the query; the type, if given, must be equal."""
    hit = has_text(F.col("name"), query) | F.exists("aliases", lambda a: has_text(a, query))
    found = entities.filter(hit)
    return found.filter(F.col("entity_type") == entity_type) if entity_type else found
