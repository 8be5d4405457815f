"""Queries of the document and graph operators over the model views, with the same in DuckDB's SQL."""

from __future__ import annotations

import posixpath
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import domain, text
from quillgraph.operators import build, chunking, curate, graph, notes, search
from quillgraph.session import scratch
from quillgraph.sources import files, model, note_files
from quillgraph.sources.tables import raw
from quillgraph.streaming import traces as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
TERMS = ["ledger", "quiet"]


_INDEXES: dict[tuple[str, str, str], search.TextIndex] = {}


def _index(spark: SparkSession, d: str, table: str) -> search.TextIndex:
    """The written full-text index of a model view, made once in a session."""
    at = (spark.sparkContext.applicationId, d, table)
    if at not in _INDEXES:
        _INDEXES[at] = search.TextIndex(model.chunks(spark, d), "chunk_id", "body") if table == "chunks" else search.TextIndex(model.insights(spark, d), "insight_id", "title", "content")
    return _INDEXES[at]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def _with(body: str, more: str = "") -> str:
    return f"WITH RECURSIVE {model.SQL}{', ' + more if more else ''} {body}"


_WS = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


_GAP = "e0 - length(ltrim(list_extract(string_split(substr(x, s + 1, e0 - s), chr(10) || chr(10)), -1), chr(10))) - 2"
_CUT = f"CASE WHEN e0 < length(x) AND contains(substr(x, s + 1, e0 - s), chr(10) || chr(10)) AND {_GAP} > s + 750 THEN {_GAP} ELSE e0 END"
_BODY = rf"regexp_replace(substr(x, s + 1, e - s), '^{_WS}+|{_WS}+$', '', 'g')"


@_query(
    rf"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS x FROM documents WHERE text IS NOT NULL),
    c AS (SELECT doc_id, x, CAST(0 AS BIGINT) AS s, CAST(least(1500, length(x)) AS BIGINT) AS e0 FROM t WHERE length(x) > 0
      UNION ALL SELECT doc_id, x, CAST(e - 150 AS BIGINT), CAST(least(e - 150 + 1500, length(x)) AS BIGINT) FROM (SELECT doc_id, x, s, e0, {_CUT} AS e FROM c) WHERE e < length(x)),
    d AS (SELECT doc_id, x, s, {_CUT} AS e FROM c)
    SELECT doc_id, 'chunk-' || s AS section_path, s AS line_start, md5({_BODY}) AS body_md5 FROM d WHERE {_BODY} <> ''"""
)
def q01_chunk_window(spark: SparkSession, d: str) -> DataFrame:
    """Sliding windows over all documents."""
    cut = chunking.windows(raw(spark, d, "documents"), "doc_id", "text")
    return cut.select("doc_id", "section_path", F.col("line_start").cast("bigint").alias("line_start"), F.md5("body").alias("body_md5"))


def _markdown_books(spark: SparkSession, d: str) -> DataFrame:
    parts = model.chunks(spark, d).filter("doc_id IS NOT NULL").select("doc_id", F.struct("chunk_id", F.concat(F.lit("## "), "section_path", F.lit("\n"), "body").alias("part")).alias("p"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["part"]), "\n").alias("text"))


@_query(
    _with(
        r"""SELECT doc_id, section_path, heading_level, line_start, md5(body) AS body_md5 FROM (
        SELECT doc_id, CASE WHEN regexp_matches(head, '^#{1,3}\s+.') THEN regexp_replace(regexp_extract(head, '^#{1,3}\s+(.+)', 1), '^\s+|\s+$', '', 'g') ELSE '' END AS section_path,
          CAST(CASE WHEN regexp_matches(head, '^#{1,3}\s+.') THEN length(regexp_extract(head, '^(#{1,3})\s', 1)) ELSE 0 END AS INTEGER) AS heading_level, CAST(first - 1 AS INTEGER) AS line_start,
          regexp_replace(CASE WHEN regexp_matches(head, '^#{1,3}\s+.') THEN array_to_string(lines[2:], chr(10)) ELSE array_to_string(lines, chr(10)) END, '^\s+|\s+$', '', 'g') AS body
        FROM (SELECT doc_id, sec, min(i) AS first, list(line ORDER BY i) AS lines, arg_min(line, i) AS head FROM
          (SELECT *, sum(CASE WHEN i > 1 AND regexp_matches(line, '^#{1,3}\s') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM
            (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM
              (SELECT doc_id, string_agg('## ' || section_path || chr(10) || body, chr(10) ORDER BY chunk_id) AS text FROM mc WHERE doc_id IS NOT NULL GROUP BY doc_id))) GROUP BY doc_id, sec)) WHERE body <> ''"""
    )
)
def q02_chunk_markdown(spark: SparkSession, d: str) -> DataFrame:
    """Sections of each document's chunks put together as Markdown."""
    return chunking.sections(_markdown_books(spark, d), "doc_id", "text").select("doc_id", "section_path", "heading_level", "line_start", F.md5("body").alias("body_md5"))


@_query(
    r"""SELECT doc_id, CASE WHEN len(heads) > 0 THEN regexp_replace(regexp_extract(heads[1], '^#\s+(.+)', 1), '^\s+|\s+$', '', 'g') ELSE nullif(substr(regexp_replace(lines[1], '^\s+|\s+$', '', 'g'), 1, 200), '') END AS title
    FROM (SELECT doc_id, lines, list_filter(lines[1:20], lambda x: regexp_matches(x, '^#\s+.+')) AS heads FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL))"""
)
def q03_title(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", text.title_of(F.col("text")).alias("title"))


@_query(_with(r"""SELECT insight_id, substr(regexp_replace(regexp_replace(lower(title), '^\s+|\s+$', '', 'g'), '[^a-z0-9一-鿿]+', '-', 'g'), 1, 60) || '-' || substr(md5(content), 1, 8) AS new_slug FROM mi"""))
def q04_slug(spark: SparkSession, d: str) -> DataFrame:
    return model.insights(spark, d).select("insight_id", text.slug_of(F.col("title"), F.col("content")).alias("new_slug"))


@_query(_with(r"""SELECT chunk_id, md5(regexp_replace(regexp_replace(regexp_replace(body, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM mc"""))
def q05_html_text(spark: SparkSession, d: str) -> DataFrame:
    return model.chunks(spark, d).select("chunk_id", F.md5(text.html_text(F.col("body"))).alias("text_md5"))


def _residue_sql(column: str) -> str:
    """The fixed patterns for DuckDB, whose flag for Unix line ends goes without saying."""
    for pattern in text.BOOK_RESIDUE:
        flags, rest = pattern[2:].split(")", 1)
        column = f"regexp_replace({column}, '(?{flags.replace('d', '')}){rest}', '', 'g')"
    return column


@_query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(x, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM (SELECT doc_id, {_residue_sql('text')} AS x FROM documents WHERE text IS NOT NULL)""")
def q06_clean_hooks(spark: SparkSession, d: str) -> DataFrame:
    return raw(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.even_space(text.without_residue(F.col("text")))).alias("text_md5"))


@_query(
    r"""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events"""
)
def q07_json_tiers(spark: SparkSession, d: str) -> DataFrame:
    """JSON found bare, fenced, between braces, or not at all."""
    shape = F.when(F.col("event_id") % 4 == 0, F.col("props")).when(F.col("event_id") % 4 == 1, F.concat(F.lit("As asked:\n```json\n"), "props", F.lit("\n```\nDone."))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("The answer is "), "props", F.lit(" as it seems"))).otherwise(F.lit("nothing found"))
    return raw(spark, d, "events").select("event_id", F.get_json_object(text.json_in(shape), "$.k").alias("k"))


_TERMS = rf"list_filter(string_split_regex(translate(lower({{}}), '{text.ACCENTED}', '{text.BARE}'), '[^\p{{{{L}}}}\p{{{{N}}}}]+'), lambda x: x <> '')"


def _terms_sql(column: str) -> str:
    return _TERMS.replace("{{L}}", "{L}").replace("{{N}}", "{N}").replace("{}", column)


@_query(_with(f"""SELECT term, count(*) AS n_rows, CAST(sum(tf) AS BIGINT) AS n_all FROM (SELECT insight_id, term, count(*) AS tf FROM (SELECT insight_id, unnest({_terms_sql('content')}) AS term FROM mi) GROUP BY ALL) GROUP BY term"""))
def q08_postings(spark: SparkSession, d: str) -> DataFrame:
    """How often each term stands in the notes."""
    return search.postings(model.insights(spark, d), "insight_id", "content").groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tf").alias("n_all"))


def _bm25_sql(source: str, key: str, words: str, terms: list[str]) -> str:
    n = len(terms)
    f = ", ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) AS f{i}" for i, t in enumerate(terms))
    s = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(n))
    idf = lambda i: f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    rank = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * l / mean))" for i in range(n))
    return f"""(SELECT {key}, -({rank}) AS rank FROM (SELECT {key}, len(w) AS l, {f} FROM (SELECT {key}, {words} AS w FROM {source})) h, (SELECT count(*) AS n, avg(l) AS mean, {s} FROM (SELECT len(w) AS l, {f} FROM (SELECT {words} AS w FROM {source}))) s WHERE {" AND ".join(f"f{i} > 0" for i in range(n))})"""


@_query(_with("SELECT chunk_id, round(rank, 6) AS rank FROM " + _bm25_sql("mc", "chunk_id", _terms_sql("body"), ["ledg"])))
def q09_bm25_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, "chunks").search(["ledg"]).select("chunk_id", F.round("rank", 6).alias("rank"))


@_query(_with("SELECT chunk_id, round(rank, 6) AS rank FROM " + _bm25_sql("mc", "chunk_id", _terms_sql("body"), TERMS)))
def q10_bm25_and(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d, "chunks").search(TERMS).select("chunk_id", F.round("rank", 6).alias("rank"))


def _first_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in raw(spark, d, "embeddings").orderBy("vec_id").select("embedding").first()[0]]


_DIST = "sqrt(list_sum(list_transform(list_zip(CAST(embedding AS DOUBLE[]), (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) FROM embeddings)), lambda p: (p[1] - p[2]) * (p[1] - p[2]))))"


@_query(f"SELECT vec_id, round({_DIST}, 6) AS distance FROM embeddings ORDER BY {_DIST}, vec_id LIMIT 20")
def q11_knn_l2(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest vectors to the first one (a top-k search)."""
    return search.knn(raw(spark, d, "embeddings"), "vec_id", "embedding", _first_vector(spark, d), 20).select("vec_id", F.round("distance", 6).alias("distance"))


@_query(
    """SELECT query, vec_id, round(distance, 6) AS distance, pos FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS INTEGER) AS pos FROM (
    SELECT q.vec_id AS query, e.vec_id, sqrt(list_sum(list_transform(list_zip(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS distance FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)) WHERE pos <= 20"""
)
def q56_knn_many(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest vectors to every vector whose id is divisible by 100, against all vectors."""
    e = raw(spark, d, "embeddings")
    asked = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.knn_many(e, "vec_id", "embedding", asked, 20).select("query", "vec_id", F.round("distance", 6).alias("distance"), "pos")


_KNOWN = "kn AS (SELECT mc.*, md.title FROM mc JOIN md USING (doc_id))"
_ASCII = f"translate({{}}, '{text.UPPER}', '{text.LOWER}')"


@_query(
    _with(
        f"""SELECT CAST(row_number() OVER (ORDER BY tier, pos) AS INTEGER) AS pos, chunk_id, doc_id, section_path, md5(substr(body, 1, 500)) AS body_md5, title, source FROM (
        SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, pos) AS rn FROM (
          SELECT chunk_id, 0 AS tier, 'text' AS source, row_number() OVER (ORDER BY rank, chunk_id) AS pos FROM (SELECT * FROM {_bm25_sql('kn', 'chunk_id', _terms_sql('body'), TERMS)} ORDER BY rank, chunk_id LIMIT 15)
          UNION ALL SELECT chunk_id, 1, 'text', row_number() OVER (ORDER BY chunk_id) FROM (SELECT chunk_id FROM kn WHERE contains({_ASCII.format('body')}, 'quiet ledger') ORDER BY chunk_id LIMIT 15)
          UNION ALL SELECT chunk_id, 2, 'vector', row_number() OVER (ORDER BY dist, chunk_id) FROM (SELECT vec_id + 1 AS chunk_id, {_DIST} AS dist FROM embeddings WHERE vec_id + 1 IN (SELECT chunk_id FROM kn) ORDER BY 2, 1 LIMIT 10)))
        JOIN kn USING (chunk_id) WHERE rn = 1 ORDER BY tier, pos LIMIT 5""",
        _KNOWN,
    )
)
def q12_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """The five best of full text, substrings and vectors (a top-k search)."""
    vectors = raw(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("chunk_id"), "embedding")
    found = search.hybrid(model.chunks(spark, d), model.docs(spark, d), "quiet ledger", TERMS, 5, vectors, _first_vector(spark, d), index=_index(spark, d, "chunks"))
    return found.select("pos", "chunk_id", "doc_id", "section_path", F.md5("body").alias("body_md5"), "title", "source")


@_query(
    _with(
        f"""SELECT CAST(row_number() OVER (ORDER BY tier, pos) AS INTEGER) AS pos, title AS book, section_path AS section, md5(body) AS body_md5 FROM (
        SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY tier, pos) AS rn FROM (SELECT chunk_id, 0 AS tier, row_number() OVER (ORDER BY rank, chunk_id) AS pos FROM (SELECT * FROM {_bm25_sql('bk', 'chunk_id', _terms_sql('body'), ['the'])} ORDER BY rank, chunk_id LIMIT 3)
        UNION ALL SELECT chunk_id, 1, row_number() OVER (ORDER BY chunk_id) FROM (SELECT chunk_id FROM bk WHERE contains({_ASCII.format('body')}, 'the') ORDER BY chunk_id LIMIT 3)))
        JOIN bk USING (chunk_id) WHERE rn = 1 ORDER BY tier, pos LIMIT 3""",
        _KNOWN + ", bk AS (SELECT * FROM kn WHERE title = (SELECT arg_max(title, (n, title)) FROM (SELECT title, count(*) AS n FROM kn WHERE contains(lower(body), 'the') GROUP BY title)))",
    )
)
def q13_read_in_book(spark: SparkSession, d: str) -> DataFrame:
    """The three best passages for a word in the book that has it most often (a top-k search)."""
    docs, chunks = model.docs(spark, d), model.chunks(spark, d)
    told = chunks.filter(F.contains(F.lower("body"), F.lit("the"))).join(docs, "doc_id").groupBy("title").count()
    row = told.agg(F.max_by("title", F.struct("count", "title"))).first()
    return search.in_book(chunks, docs, "the", row[0] or "", ["the"], 3, _index(spark, d, "chunks")).select("pos", "book", "section", F.md5("body").alias("body_md5"))


@_query(
    _with(
        f"""SELECT CAST(row_number() OVER (ORDER BY tier, pos) AS INTEGER) AS pos, insight_id, slug, title, substr(content, 1, 300) AS content, source FROM (SELECT *, row_number() OVER (PARTITION BY insight_id ORDER BY tier, pos) AS rn FROM (
        SELECT insight_id, 0 AS tier, 'fts' AS source, row_number() OVER (ORDER BY rank, insight_id) AS pos FROM (SELECT * FROM {_bm25_sql('mi', 'insight_id', 'list_concat(' + _terms_sql("coalesce(title, '')") + ', ' + _terms_sql("coalesce(content, '')") + ')', ['notes', 'river'])} ORDER BY rank, insight_id LIMIT 10)
        UNION ALL SELECT insight_id, 1, 'like', row_number() OVER (ORDER BY created_at DESC, insight_id) FROM (SELECT * FROM mi WHERE contains({_ASCII.format('title')}, 'river') OR contains({_ASCII.format('content')}, 'river') ORDER BY created_at DESC, insight_id LIMIT 10)))
        JOIN mi USING (insight_id) WHERE rn = 1 ORDER BY tier, pos LIMIT 5"""
    )
)
def q14_search_notes(spark: SparkSession, d: str) -> DataFrame:
    """The five best notes (a top-k search)."""
    return search.notes(model.insights(spark, d), "river", ["notes", "river"], 5, index=_index(spark, d, "insights"))


@_query(_with(f"SELECT chunk_id, doc_id, title FROM kn WHERE contains({_ASCII.format('body')}, 'the ledger')", _KNOWN))
def q15_search_like(spark: SparkSession, d: str) -> DataFrame:
    """All chunks of known documents that contain a text."""
    chunks = model.chunks(spark, d).filter(text.has_text(F.col("body"), "the LEDGER"))
    return chunks.join(model.docs(spark, d).select("doc_id", "title"), "doc_id").select("chunk_id", "doc_id", "title")


@_query(_with(f"SELECT entity_id, name, entity_type FROM me WHERE contains({_ASCII.format('name')}, 'river') OR len(list_filter(aliases, lambda a: contains({_ASCII.format('a')}, 'river'))) > 0"))
def q16_search_entities(spark: SparkSession, d: str) -> DataFrame:
    return search.entities_like(model.entities(spark, d), "River").select("entity_id", "name", "entity_type")


_ADJ = "adj AS (SELECT entity_a AS src, entity_b AS dst, relation_type, weight, 0 AS side, rel_id FROM mr UNION ALL SELECT entity_b, entity_a, relation_type, weight, 1, rel_id FROM mr WHERE entity_a <> entity_b)"
_HUB = "(SELECT arg_max(src, (n, src)) FROM (SELECT src, count(*) AS n FROM adj WHERE src IN (SELECT name FROM me) GROUP BY src))"


def _hub(spark: SparkSession, d: str) -> str:
    """The entity with the most edges."""
    known = model.entities(spark, d).select(F.col("name").alias("src"))
    row = graph.adjacency(model.relations(spark, d)).join(known, "src", "left_semi").groupBy("src").count().agg(F.max_by("src", F.struct("count", "src"))).first()
    return row[0] or ""


@_query(
    _with(
        f"""SELECT 'entity' AS section, 1 AS pos, name AS item, entity_type AS detail FROM me WHERE name = {_HUB}
        UNION ALL SELECT 'relation', CAST(row_number() OVER (ORDER BY weight DESC, side, rel_id) AS INTEGER), dst, relation_type FROM (SELECT * FROM adj WHERE src = {_HUB} ORDER BY weight DESC, side, rel_id LIMIT 20)
        UNION ALL SELECT 'note', CAST(row_number() OVER (ORDER BY insight_id) AS INTEGER), title, slug FROM (SELECT * FROM mi WHERE insight_id IN (SELECT insight_id FROM (SELECT insight_id, unnest(entities) AS e FROM mi) WHERE contains({_ASCII.format('e')}, {_ASCII.format(_HUB)})) ORDER BY insight_id LIMIT 10)
        UNION ALL SELECT 'book', CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER), title, CAST(doc_id AS VARCHAR) FROM (SELECT md.* FROM md WHERE CAST(doc_id AS VARCHAR) IN (SELECT unnest(source_docs) FROM me WHERE name = {_HUB}) ORDER BY doc_id LIMIT 10)
        UNION ALL SELECT 'footprint', CAST(row_number() OVER (ORDER BY source) AS INTEGER), source, CAST(count AS VARCHAR) FROM mt WHERE name = {_HUB}""",
        _ADJ,
    )
)
def q17_entity_card(spark: SparkSession, d: str) -> DataFrame:
    """Everything about the entity with the most edges."""
    return graph.entity_card(_hub(spark, d), model.entities(spark, d), model.relations(spark, d), model.insights(spark, d), model.docs(spark, d), model.traces(spark, d), model.chunks(spark, d))


_SEEDS = "seeds AS (SELECT name AS seed FROM me WHERE entity_id % 100 = 0)"


def _seeds(spark: SparkSession, d: str, column: str) -> DataFrame:
    """The query set: every entity whose id is divisible by 100."""
    return model.entities(spark, d).filter("entity_id % 100 = 0").select(F.col("name").alias(column))


@_query(_with("SELECT src, dst AS name, coalesce(entity_type, 'unknown') AS type, relation_type AS relation, adj.weight, coalesce(cross_doc_count, 0) AS cross_doc_count, coalesce(description, '') AS description FROM adj JOIN seeds ON src = seed LEFT JOIN me ON dst = name", f"{_ADJ}, {_SEEDS}"))
def q18_neighbours(spark: SparkSession, d: str) -> DataFrame:
    met = graph.neighbours(graph.adjacency(model.relations(spark, d)), model.entities(spark, d), _seeds(spark, d, "src"))
    return met.select("src", "name", "type", "relation", "weight", "cross_doc_count", "description")


_EXPAND = "SELECT f.seed, f.src, a.dst, a.relation_type, a.weight, CASE WHEN m.name IS NOT NULL AND a.weight >= 1 THEN 'anchored' ELSE 'exploration' END AS bucket, a.side, a.rel_id FROM {} f JOIN adj a ON a.src = f.src LEFT JOIN me m ON m.name = a.dst"
_POS = "row_number() OVER (PARTITION BY seed, bucket ORDER BY weight DESC, side, rel_id)"
_NAV = f"{_ADJ}, {_SEEDS}, s1 AS (SELECT seed, seed AS src FROM seeds), o AS (SELECT *, {_POS} AS p FROM ({_EXPAND.format('s1')}))"


@_query(_with("SELECT seed, bucket, CAST(p AS INTEGER) AS pos, dst AS neighbor, relation_type AS relation, weight FROM o WHERE p <= CASE WHEN bucket = 'anchored' THEN 15 ELSE 20 END", _NAV))
def q19_navigate_1(spark: SparkSession, d: str) -> DataFrame:
    return graph.navigate(model.relations(spark, d), model.entities(spark, d), _seeds(spark, d, "seed"), 1)


@_query(
    _with(
        """SELECT seed, bucket, CAST(pos AS INTEGER) AS pos, neighbor, relation, weight FROM (SELECT *, row_number() OVER (PARTITION BY seed, bucket ORDER BY hop, p) AS pos FROM (
        SELECT seed, bucket, 1 AS hop, p, dst AS neighbor, relation_type AS relation, weight FROM o WHERE seed NOT IN (SELECT seed FROM s2) OR p <= CASE WHEN bucket = 'anchored' THEN 15 ELSE 10 END
        UNION ALL SELECT seed, bucket, 2, p, dst, CASE WHEN bucket = 'anchored' THEN seed || '→' || src || '→' ELSE relation_type END, weight FROM o2 WHERE p <= 10)) WHERE pos <= CASE WHEN bucket = 'anchored' THEN 15 ELSE 20 END""",
        f"{_NAV}, s2 AS (SELECT seed, dst AS src FROM o WHERE bucket = 'anchored' AND p = 1), o2 AS (SELECT *, {_POS} AS p FROM ({_EXPAND.format('s2')}))",
    )
)
def q20_navigate_2(spark: SparkSession, d: str) -> DataFrame:
    return graph.navigate(model.relations(spark, d), model.entities(spark, d), _seeds(spark, d, "seed"), 2)


@_query(_with("SELECT 'docs' AS what, count(*) AS n FROM md UNION ALL SELECT 'entities', count(*) FROM me UNION ALL SELECT 'relations', count(*) FROM mr UNION ALL SELECT 'insights', count(*) FROM mi"))
def q21_stats(spark: SparkSession, d: str) -> DataFrame:
    return graph.stats(model.docs(spark, d), model.entities(spark, d), model.relations(spark, d), model.insights(spark, d))


@_query(_with("SELECT relation_type, count(*) AS n FROM mr GROUP BY relation_type"))
def q22_relation_types(spark: SparkSession, d: str) -> DataFrame:
    return graph.relation_types(model.relations(spark, d))


@_query(_with(f"SELECT s.seed AS name, count(DISTINCT doc_id) AS n_docs FROM seeds s JOIN mc ON contains({_ASCII.format('body')}, {_ASCII.format('s.seed')}) GROUP BY s.seed", _SEEDS))
def q23_mention_counts(spark: SparkSession, d: str) -> DataFrame:
    """In how many documents the names of the query set occur."""
    return curate.mention_counts(_seeds(spark, d, "name"), model.chunks(spark, d))


@_query(_with("SELECT name, count(DISTINCT doc_id) AS n_docs FROM (SELECT name, unnest(source_docs) AS s FROM me) JOIN md ON s = CAST(doc_id AS VARCHAR) GROUP BY name"))
def q24_verified_counts(spark: SparkSession, d: str) -> DataFrame:
    return curate.verified_counts(model.entities(spark, d), model.docs(spark, d))


_WORTH = "count * CASE source WHEN 'record' THEN 3 WHEN 'navigate' THEN 2 ELSE 1 END"


@_query(_with(f"SELECT name, round(least(sum({_WORTH}) / 50.0, 1.0), 6) AS footprint, bool_or(source = 'record' AND count >= 2 OR source = 'navigate' AND count >= 5) OR sum({_WORTH}) >= 10 AS hot FROM mt GROUP BY name"))
def q25_footprint(spark: SparkSession, d: str) -> DataFrame:
    return graph.footprint(model.traces(spark, d)).select("name", F.round("footprint", 6).alias("footprint"), "hot")


@_query(
    _with("SELECT name, source, CAST(sum(count) AS BIGINT) AS count, max(last_seen) AS last_seen FROM (SELECT * FROM mt UNION ALL SELECT name, 'record', count + 1, last_seen + INTERVAL 3 DAY FROM mt WHERE count > 2 UNION ALL SELECT name || ' II', source, 1, last_seen - INTERVAL 9 DAY FROM mt) GROUP BY name, source")
)
def q26_merge_traces(spark: SparkSession, d: str) -> DataFrame:
    """Trace counters after a later log: more records of what was met often, and names that are new."""
    traces = model.traces(spark, d)
    more = traces.filter("count > 2").select("name", F.lit("record").alias("source"), (F.col("count") + 1).alias("count"), (F.col("last_seen") + F.expr("INTERVAL 3 DAY")).alias("last_seen"))
    fresh = traces.select(F.concat("name", F.lit(" II")).alias("name"), "source", F.lit(1).cast("long").alias("count"), (F.col("last_seen") - F.expr("INTERVAL 9 DAY")).alias("last_seen"))
    return notes.merge_traces(traces, more.unionByName(fresh))


_ASKED = "asked AS (SELECT name AS query FROM me WHERE entity_id % 100 = 0 UNION SELECT aliases[1] FROM me WHERE entity_id % 100 = 0 AND len(aliases) > 0 UNION SELECT 'about ' || substr(name, 1, 60) FROM me WHERE entity_id % 100 = 0 UNION SELECT substr(name, 1, 5) || 'zzqq' FROM me WHERE entity_id % 100 = 0)"


@_query(
    _with(
        r"""SELECT query, arg_min(name, (tier, place, entity_id)) AS name, arg_min(entity_type, (tier, place, entity_id)) AS entity_type, CAST(min(tier) AS INTEGER) AS tier FROM (
        SELECT query, entity_id, name, entity_type, 1 + by_alias AS tier, 0 AS place FROM asked JOIN known ON term = query
        UNION ALL SELECT w.query, entity_id, name, entity_type, 3, i - 1 FROM (SELECT query, unnest(list_filter(string_split_regex(query, '\s+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(string_split_regex(query, '\s+'), lambda x: x <> ''), 1) AS i FROM asked) w JOIN known ON term = word
        UNION ALL SELECT p.query, entity_id, name, entity_type, 4, 6 - k FROM (SELECT query, unnest(range(2, 7)) AS k FROM asked) p JOIN known ON k <= length(p.query) AND contains(lower(term), lower(substr(p.query, 1, k)))) GROUP BY query""",
        _ASKED + ", known AS (SELECT entity_id, name, entity_type, name AS term, 0 AS by_alias FROM me UNION ALL SELECT entity_id, name, entity_type, unnest(aliases), 1 FROM me)",
    )
)
def q27_anchors(spark: SparkSession, d: str) -> DataFrame:
    """Anchors by name, alias, word and prefix, asked with the entities of the query set."""
    whole = model.entities(spark, d)
    e = whole.filter("entity_id % 100 = 0")
    asked = [
        e.select(F.col("name").alias("query")), e.filter("size(aliases) > 0").select(F.element_at("aliases", 1)),
        e.select(F.concat(F.lit("about "), F.substring("name", 1, 60))), e.select(F.concat(F.substring("name", 1, 5), F.lit("zzqq"))),
    ]
    return graph.anchors(whole, asked[0].union(asked[1]).union(asked[2]).union(asked[3]).distinct())


_COMPAT = "CASE WHEN c.type IN ('', 'unknown') THEN 0.2 WHEN a.entity_type = c.type THEN 1.0 WHEN split_part(c.type, '.', 1) IN ('stem_branch', 'element') THEN 0.1 WHEN a.root = split_part(c.type, '.', 1) THEN 0.7 ELSE 0.2 END"


@_query(
    _with(
        f"""SELECT anchor, name, relation, round(CASE WHEN len(docs) > 0 THEN len(list_intersect(docs, sd)) / greatest(len(docs), 1) * 0.5 + compat * 0.3 + exp(-0.5) * 0.2 ELSE compat * 0.6 + exp(-0.5) * 0.4 END, 6) AS coherence FROM (
        SELECT a.name AS anchor, c.dst AS name, c.relation, a.source_docs AS docs, c.sd, {_COMPAT} AS compat FROM me a JOIN (SELECT src, dst, relation_type AS relation, coalesce(entity_type, 'unknown') AS type, coalesce(source_docs, []) AS sd FROM adj LEFT JOIN me ON dst = name) c ON c.src = a.name WHERE a.entity_id % 100 = 0)""",
        _ADJ,
    )
)
def q28_coherence(spark: SparkSession, d: str) -> DataFrame:
    """How well each neighbour fits the topic of the entities of the query set."""
    e = model.entities(spark, d)
    topic = graph.topics(e, _seeds(spark, d, "anchor"))
    met = graph.neighbours(graph.adjacency(model.relations(spark, d)), e, topic.select(F.col("anchor").alias("src"))).join(topic, F.col("src") == F.col("anchor"))
    fit = graph.coherence(F.col("anchor_type"), F.col("anchor_docs"), F.col("type"), F.col("source_docs"), 1)
    return met.select("anchor", "name", "relation", F.round(fit, 6).alias("coherence"))


def _thinking(spark: SparkSession, d: str, mode: str) -> DataFrame:
    e = model.entities(spark, d)
    found = graph.think(model.relations(spark, d), e, model.traces(spark, d), graph.topics(e, _seeds(spark, d, "anchor")), mode)
    return found.select("anchor", "depth", "pos", "name", "type", "relation", "in_books", "coherence", F.round("score", 6).alias("score"))


def _think_sql(wide: bool) -> str:
    """The rounds of thinking, each as its own table over the one before."""
    rounds = graph.HOPS_WIDE if wide else graph.HOPS_DEEP
    with_docs, without = (0.3, 0.2) if wide else (0.6, 0.4)
    ctes = [
        _ADJ,
        "topic AS (SELECT name AS anchor, entity_type AS atype, root AS aroot, source_docs AS adocs FROM me WHERE entity_id % 100 = 0)",
        f"prints AS (SELECT name, least(sum({_WORTH}) / 50.0, 1.0) AS footprint, bool_or(source = 'record' AND count >= 2 OR source = 'navigate' AND count >= 5) OR sum({_WORTH}) >= 10 AS hot FROM mt GROUP BY name)",
        "most AS (SELECT greatest(coalesce(max(weight), 1.0), 1.0) AS most FROM mr)",
        "f1 AS (SELECT anchor, anchor AS src, 1 AS place FROM topic)",
        "s1 AS (SELECT anchor, anchor AS dst FROM topic)",
    ]
    for n in range(1, rounds + 1):
        fade = f"exp(-{n} / 2.0)"
        compat = "CASE WHEN type IN ('', 'unknown') THEN 0.2 WHEN atype = type THEN 1.0 WHEN split_part(type, '.', 1) IN ('stem_branch', 'element') THEN 0.1 WHEN aroot = split_part(type, '.', 1) THEN 0.7 ELSE 0.2 END"
        fit = f"CASE WHEN len(adocs) > 0 THEN len(list_intersect(adocs, sd)) / greatest(len(adocs), 1) * 0.5 + ({compat}) * 0.3 + {fade} * 0.2 ELSE ({compat}) * 0.6 + {fade} * 0.4 END"
        score = f"least(weight / most, 1.0) * {0.5 ** (n - 1)} * 0.5 + coalesce(footprint, 0) * 0.3 + least(coalesce(in_books, 0) / 50.0, 1.0) * 0.2" if wide else "fit"
        ctes += [
            f"m{n} AS (SELECT f.anchor, a.dst, min((f.place, a.side, a.rel_id)) AS ord, arg_min(a.relation_type, (f.place, a.side, a.rel_id)) AS relation, arg_min(a.weight, (f.place, a.side, a.rel_id)) AS weight FROM f{n} f JOIN adj a USING (src) WHERE NOT EXISTS (SELECT 1 FROM s{n} s WHERE s.anchor = f.anchor AND s.dst = a.dst) GROUP BY ALL)",
            f"c{n} AS (SELECT *, {fit} AS fit FROM (SELECT m.*, atype, aroot, adocs, coalesce(e.entity_type, 'unknown') AS type, coalesce(e.source_docs, []) AS sd, e.cross_doc_count AS in_books, p.footprint, coalesce(p.hot, false) AS hot, most FROM m{n} m JOIN topic USING (anchor) LEFT JOIN me e ON e.name = m.dst LEFT JOIN prints p ON p.name = m.dst, most))",
            f"k{n} AS (SELECT * FROM (SELECT anchor, {n} AS depth, dst, type, relation, coalesce(in_books, 0) AS in_books, fit, {score} AS score, hot, row_number() OVER (PARTITION BY anchor ORDER BY {score} DESC, ord) AS pos FROM c{n} WHERE fit >= CASE WHEN len(adocs) > 0 THEN {with_docs} ELSE {without} END) WHERE pos <= {graph.WIDTH if wide else 1})",
            f"s{n + 1} AS (SELECT * FROM s{n} UNION ALL SELECT anchor, dst FROM {'c' if wide else 'k'}{n})",
            f"f{n + 1} AS (SELECT anchor, dst AS src, pos AS place FROM k{n}" + (f" WHERE anchor NOT IN (SELECT anchor FROM k{n} WHERE hot)" if wide else "") + ")",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM k{n}" for n in range(1, rounds + 1))
    return _with(f"SELECT anchor, CAST(depth AS INTEGER) AS depth, CAST(pos AS INTEGER) AS pos, dst AS name, type, relation, CAST(in_books AS INTEGER) AS in_books, round(fit, 3) AS coherence, round(score, 6) AS score FROM ({every})", ", ".join(c.replace(" AS (", " AS MATERIALIZED (", 1) for c in ctes))


@_query(_think_sql(True))
def q29_think_divergent(spark: SparkSession, d: str) -> DataFrame:
    """Breadth-first thinking from the query set."""
    return _thinking(spark, d, "divergent")


@_query(_think_sql(False))
def q30_think_deep(spark: SparkSession, d: str) -> DataFrame:
    """Chains of the most coherent neighbours from the query set."""
    return _thinking(spark, d, "deep")


@_query(
    _with(
        """SELECT chunk_id, md5(body) AS body_md5 FROM (SELECT chunk_id, body, row_number() OVER (ORDER BY chunk_id) - 1 AS rn FROM mc), (SELECT count(*) AS n, greatest(10, CAST(floor(sqrt(sum(length(body))) * 0.3) AS BIGINT)) AS target FROM mc)
        WHERE CASE WHEN target >= n THEN rn < 30 ELSE rn IN (SELECT CAST(floor(i * (n / target)) AS BIGINT) FROM (SELECT unnest(range(0, 30)) AS i) WHERE i < target) END"""
    )
)
def q31_sample(spark: SparkSession, d: str) -> DataFrame:
    """The evenly spaced sample that extraction takes (a sampling operator)."""
    return curate.sample(model.chunks(spark, d)).select("chunk_id", F.md5("body").alias("body_md5"))


_SAMPLED = """sm AS (SELECT chunk_id, length(body) AS n, row_number() OVER (ORDER BY chunk_id) - 1 AS k FROM (SELECT chunk_id, body, row_number() OVER (ORDER BY chunk_id) - 1 AS rn FROM mc), (SELECT count(*) AS n, greatest(10, CAST(floor(sqrt(sum(length(body))) * 0.3) AS BIGINT)) AS target FROM mc)
  WHERE CASE WHEN target >= n THEN rn < 30 ELSE rn IN (SELECT CAST(floor(i * (n / target)) AS BIGINT) FROM (SELECT unnest(range(0, 30)) AS i) WHERE i < target) END),
  pr AS (SELECT k // 3 AS batch, k % 3 AS i, n, 0 AS part, n AS used FROM sm WHERE k % 3 = 0
    UNION ALL SELECT p.batch, s.k % 3, s.n, p.part + CASE WHEN p.used + s.n > 15000 AND p.used > 0 THEN 1 ELSE 0 END, CASE WHEN p.used + s.n > 15000 AND p.used > 0 THEN s.n ELSE p.used + s.n END FROM pr p JOIN sm s ON s.k = p.batch * 3 + p.i + 1 AND p.i < 2)"""


@_query(_with("SELECT batch, CAST(part AS INTEGER) AS part, count(*) AS n_chunks, CAST(sum(n) + 7 * (count(*) - 1) AS INTEGER) AS n_chars FROM pr GROUP BY batch, part", _SAMPLED))
def q32_prompts(spark: SparkSession, d: str) -> DataFrame:
    """The prompts of that sample."""
    return curate.prompts(curate.sample(model.chunks(spark, d))).select("batch", "part", "n_chunks", F.length("prompt").alias("n_chars"))


@_query(
    _with(
        """SELECT chunk_id, CAST(floor((chunk_id - 1) / 32) AS BIGINT) AS batch, CAST(part AS INTEGER) AS part, n AS n_chars FROM (SELECT chunk_id, n, k, b, part FROM w)""",
        r"""kept AS (SELECT chunk_id, floor((chunk_id - 1) / 32) AS b, length(substr(body, 1, 30000)) AS n, row_number() OVER (PARTITION BY floor((chunk_id - 1) / 32) ORDER BY chunk_id) AS k FROM mc WHERE length(regexp_replace(substr(body, 1, 30000), '^\s+|\s+$', '', 'g')) >= 10),
        w AS (SELECT chunk_id, b, n, k, 0 AS part, n AS used FROM kept WHERE k = 1 UNION ALL SELECT x.chunk_id, x.b, x.n, x.k, w.part + CASE WHEN w.used + x.n > 80000 THEN 1 ELSE 0 END, CASE WHEN w.used + x.n > 80000 THEN x.n ELSE w.used + x.n END FROM w JOIN kept x ON x.b = w.b AND x.k = w.k + 1)""",
    )
)
def q33_embed_batches(spark: SparkSession, d: str) -> DataFrame:
    """How chunks are packed for an embedder."""
    return curate.embed_batches(model.chunks(spark, d), "chunk_id", "body")


def _extracted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """What the deterministic extractor finds in all chunks, each as a prompt of its own."""
    asked = model.chunks(spark, d).select(F.col("chunk_id").alias("batch"), F.lit(0).alias("part"), F.col("body").alias("prompt"))
    return curate.extract(asked)


@_query(_with("SELECT name, count(DISTINCT chunk_id) AS n_chunks FROM (SELECT chunk_id, unnest(list_filter(string_split_regex(body, '[^A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{5,}'))) AS name FROM mc) GROUP BY name"))
def q34_extract(spark: SparkSession, d: str) -> DataFrame:
    """Names the deterministic extractor finds."""
    found, _ = _extracted(spark, d)
    return found.groupBy("name").agg(F.count(F.lit(1)).alias("n_chunks"))


@_query(_with("SELECT DISTINCT name FROM (SELECT unnest(list_filter(string_split_regex(body, '[^A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{5,}'))) AS name FROM mc)"))
def q35_merge_extracted(spark: SparkSession, d: str) -> DataFrame:
    """The same merged to one row a name."""
    return curate.merge_entities(_extracted(spark, d)[0]).select("name")


_TRIPLETS = "trip(rel, s, o) AS (VALUES " + ", ".join(f"('{k}', '{s}', '{o}')" for k, (_, pairs) in domain.RELATIONS.items() for s, o in pairs) + ")"
_KINDS = "kind(rel, w, anyp) AS (VALUES " + ", ".join(f"('{k}', {w}, {str(not t).lower()})" for k, (w, t) in domain.RELATIONS.items()) + ")"


@_query(_with("SELECT rel_id, relation_type FROM mr JOIN me a ON entity_a = a.name JOIN me b ON entity_b = b.name JOIN kind ON rel = relation_type WHERE anyp OR EXISTS (SELECT 1 FROM trip t WHERE t.rel = relation_type AND t.s = a.root AND t.o = b.root)", f"{_TRIPLETS}, {_KINDS}"))
def q36_valid_triplets(spark: SparkSession, d: str) -> DataFrame:
    """Relations the domain allows between the types of their ends."""
    kinds = model.entities(spark, d).select("name", "entity_type")
    typed = model.relations(spark, d).join(kinds.toDF("entity_a", "type_a"), "entity_a").join(kinds.toDF("entity_b", "type_b"), "entity_b")
    return domain.valid_triplets(typed).select("rel_id", "relation_type")


_NOISY = "(" + " OR ".join(f"regexp_matches(name, '{p}')" for p in domain.NOISE) + " OR length(name) <= 1)"


@_query(_with(f"SELECT entity_id, name FROM me WHERE {_NOISY}"))
def q37_noise(spark: SparkSession, d: str) -> DataFrame:
    return model.entities(spark, d).filter(domain.is_noise(F.col("name"))).select("entity_id", "name")


@_query(_with(f"SELECT rel_id FROM mr WHERE entity_a NOT IN (SELECT name FROM me WHERE {_NOISY}) AND entity_b NOT IN (SELECT name FROM me WHERE {_NOISY})"))
def q38_without_noise(spark: SparkSession, d: str) -> DataFrame:
    return curate.without_noise(model.entities(spark, d), model.relations(spark, d))[1].select("rel_id")


_FOUND = "found AS (SELECT name, CASE WHEN root = 'person' THEN 'seen again' ELSE '' END AS description FROM me WHERE cross_doc_count > 0 UNION ALL SELECT name || ' II', 'new' FROM me WHERE source = 'manual')"


@_query(
    _with(
        "SELECT coalesce(o.name, f.name) AS name, coalesce(o.entity_type, 'concept') AS entity_type, CASE WHEN o.name IS NULL OR coalesce(length(f.description), 0) > 0 THEN f.description ELSE o.description END AS description, coalesce(o.source, 'auto') AS source, CAST(len(coalesce(o.source_docs, [])) + CASE WHEN f.name IS NOT NULL AND NOT list_contains(coalesce(o.source_docs, []), '0') THEN 1 ELSE 0 END AS INTEGER) AS n_docs FROM (SELECT * REPLACE (list_distinct(source_docs) AS source_docs) FROM me) o FULL JOIN found f ON o.name = f.name",
        _FOUND,
    )
)
def q39_upsert_entities(spark: SparkSession, d: str) -> DataFrame:
    """Entities after a run over document 0 that found all that documents name, and namesakes of those entered by hand."""
    e = model.entities(spark, d).withColumn("source_docs", F.array_distinct("source_docs"))
    empty = F.array().cast("array<string>")
    again = e.filter("cross_doc_count > 0").select("name", F.lit("concept").alias("type"), empty.alias("aliases"), F.when(F.col("root") == "person", "seen again").otherwise("").alias("description"))
    new = e.filter("source = 'manual'").select(F.concat("name", F.lit(" II")).alias("name"), F.lit("concept").alias("type"), empty.alias("aliases"), F.lit("new").alias("description"))
    return curate.upsert_entities(e, again.unionByName(new), ["0"]).select("name", "entity_type", "description", "source", F.size("source_docs").alias("n_docs"))


@_query(
    _with(
        "SELECT entity_b AS entity_a, entity_a AS entity_b, relation_type, coalesce(w, 1.0) AS weight FROM (SELECT DISTINCT entity_a, entity_b, relation_type FROM mr) r LEFT JOIN kind ON rel = relation_type WHERE NOT EXISTS (SELECT 1 FROM mr x WHERE x.entity_a = r.entity_b AND x.entity_b = r.entity_a AND x.relation_type = r.relation_type)",
        _KINDS,
    )
)
def q40_new_relations(spark: SparkSession, d: str) -> DataFrame:
    """The relations that would be new if every edge were found the other way round."""
    r = model.relations(spark, d)
    turned = r.select(F.col("entity_b").alias("entity_a"), F.col("entity_a").alias("entity_b"), "relation_type").join(domain.relation_weights(spark), "relation_type", "left")
    return curate.new_relations(r, turned)


_NAMED = r"named AS (SELECT insight_id, title, name, min(i) AS pos FROM (SELECT insight_id, title, regexp_replace(unnest(entities), '^\s+|\s+$', '', 'g') AS name, generate_subscripts(entities, 1) AS i FROM mi) WHERE name <> '' GROUP BY ALL)"


@_query(
    _with(
        "SELECT DISTINCT entity_a, entity_b, 'MENTIONS' AS relation_type, 1.0::DOUBLE AS weight FROM (SELECT title AS entity_a, name AS entity_b FROM named UNION ALL SELECT a.name, b.name FROM named a JOIN named b ON a.insight_id = b.insight_id AND a.pos < b.pos) e WHERE entity_a <> entity_b AND NOT EXISTS (SELECT 1 FROM mr WHERE mr.entity_a = e.entity_a AND mr.entity_b = e.entity_b AND relation_type = 'MENTIONS')",
        _NAMED,
    )
)
def q41_link_notes(spark: SparkSession, d: str) -> DataFrame:
    """New edges from notes to entities and between entities of one note."""
    return notes.link(model.insights(spark, d), model.entities(spark, d), model.relations(spark, d))[1]


_NAMED_MORE = _NAMED.replace("named AS", "named_more AS").replace("unnest(entities)", "unnest(list_append(entities, coalesce(title, '')))").replace("generate_subscripts(entities, 1)", "generate_subscripts(list_append(entities, coalesce(title, '')), 1)")


@_query(_with("SELECT DISTINCT name, 'concept' AS entity_type, 'l3_insight' AS source FROM named_more WHERE name NOT IN (SELECT name FROM me)", _NAMED_MORE))
def q42_register_from_notes(spark: SparkSession, d: str) -> DataFrame:
    """Entities that notes name and nobody registered, where each note names its own title as well."""
    told = model.insights(spark, d).withColumn("entities", F.concat("entities", F.array(F.coalesce("title", F.lit("")))))
    return notes.link(told, model.entities(spark, d), model.relations(spark, d))[0]


@_query(
    _with(
        r"""SELECT ord, title, slug, CASE WHEN regexp_replace(content, '^\s+|\s+$', '', 'g') = '' THEN 'empty' WHEN row_number() OVER (PARTITION BY slug ORDER BY ord) > 1 THEN 'duplicate' ELSE 'new' END AS status FROM (SELECT *,
        substr(regexp_replace(regexp_replace(lower(title), '^\s+|\s+$', '', 'g'), '[^a-z0-9一-鿿]+', '-', 'g'), 1, 60) || '-' || substr(md5(content), 1, 8) AS slug FROM (SELECT doc_id AS ord, string_split(regexp_replace(substr(text, 1, 50), '^\s+|\s+$', '', 'g'), chr(10))[1] AS title, text AS content FROM documents WHERE text IS NOT NULL))"""
    )
)
def q43_write_notes(spark: SparkSession, d: str) -> DataFrame:
    """All documents recorded as notes: which are new, repeated or empty."""
    wanted = raw(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("ord"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
    none = model.insights(spark, d).filter(F.lit(False))
    return notes.write(none, wanted).select("ord", "title", "slug", "status")


_WANTED = "wanted AS (SELECT name || CASE WHEN entity_id % 2 = 0 THEN ' the Younger' ELSE '' END AS name, CASE WHEN entity_id % 4 IN (0, 1) THEN name WHEN entity_id % 8 = 2 THEN 'Nobody at all' END AS book FROM me)"


@_query(_with("SELECT w.name, m.name IS NULL AND w.book IS NOT NULL AND b.name IS NOT NULL AS ok, CASE WHEN m.name IS NOT NULL THEN 'known' WHEN w.book IS NULL THEN 'no tie' WHEN b.name IS NULL THEN 'unknown tie' ELSE '' END AS reason FROM wanted w LEFT JOIN me m ON m.name = w.name LEFT JOIN me b ON b.name = w.book", _WANTED))
def q44_register(spark: SparkSession, d: str) -> DataFrame:
    """Which of many wanted entities may be registered, and why not."""
    e = model.entities(spark, d)
    name = F.concat("name", F.when(F.col("entity_id") % 2 == 0, " the Younger").otherwise(""))
    book = F.when((F.col("entity_id") % 4).isin(0, 1), F.col("name")).when(F.col("entity_id") % 8 == 2, "Nobody at all")
    return curate.register(e, e.select(name.alias("name"), F.col("entity_type"), book.alias("book"), F.lit(None).cast("string").alias("target")))


@_query(_with("SELECT DISTINCT r.entity_a, r.entity_b, 'KNOWS' AS relation_type, 3.0::DOUBLE AS weight FROM mr r JOIN me a ON a.name = r.entity_a JOIN me b ON b.name = r.entity_b WHERE NOT EXISTS (SELECT 1 FROM mr x WHERE x.entity_a = r.entity_a AND x.entity_b = r.entity_b AND x.relation_type = 'KNOWS')"))
def q45_connect(spark: SparkSession, d: str) -> DataFrame:
    """KNOWS edges for all related pairs that lack one."""
    r = model.relations(spark, d)
    return curate.connect(model.entities(spark, d), r, r.select("entity_a", "entity_b").withColumn("relation_type", F.lit("KNOWS")))


@_query(
    _with(
        "SELECT rel_id, array_to_string(list_sort(list_distinct(list(note))), '|') AS notes FROM (SELECT r.rel_id, n.note FROM mr r JOIN (SELECT entity_a, entity_b, NULL AS relation_type, 'seen' AS note FROM mr WHERE weight > 3 UNION ALL SELECT entity_a, entity_b, 'MENTIONS', 'named' FROM mr WHERE weight <= 1) n ON r.entity_a = n.entity_a AND r.entity_b = n.entity_b AND (n.relation_type IS NULL OR n.relation_type = r.relation_type)) GROUP BY rel_id"
    )
)
def q46_annotate(spark: SparkSession, d: str) -> DataFrame:
    """Remarks on the edges between pairs with a heavy or a light edge, once each."""
    r = model.relations(spark, d)
    seen = r.filter("weight > 3").select("entity_a", "entity_b", F.lit(None).cast("string").alias("relation_type"), F.lit("seen").alias("note"))
    named = r.filter("weight <= 1").select("entity_a", "entity_b", F.lit("MENTIONS").alias("relation_type"), F.lit("named").alias("note"))
    return curate.annotate(r, seen.unionByName(named)).select("rel_id", F.array_join("notes", "|").alias("notes"))


@_query(
    _with(
        "SELECT description AS name, arg_max(entity_type, (cross_doc_count, entity_type)) AS entity_type, array_to_string(list_sort(list_filter(list_distinct(list(name)), lambda x: x <> description)), '|') AS aliases, max(cross_doc_count) AS cross_doc_count FROM me GROUP BY description"
    )
)
def q47_import_entities(spark: SparkSession, d: str) -> DataFrame:
    """Names grouped under a common key, as the importer groups aliases: here by description."""
    rows = model.entities(spark, d).select(F.col("description").alias("name"), F.col("name").alias("alias"), "entity_type", "cross_doc_count")
    return notes.import_entities(rows).select("name", "entity_type", F.array_join("aliases", "|").alias("aliases"), "cross_doc_count")


@_query(
    """SELECT entity_a, entity_b, relation_type, arg_min(weight, id) AS weight, CAST(arg_min(n, id) AS INTEGER) AS n_books FROM (SELECT id, entity_a, entity_b, upper(coalesce(relation_type, 'MENTIONS')) AS relation_type, coalesce(weight, 1.0) AS weight,
    CASE WHEN coalesce(source_docs_json, '') = '' THEN 0 WHEN json_valid(source_docs_json) AND json_type(source_docs_json) = 'ARRAY' THEN json_array_length(source_docs_json) ELSE 1 END AS n FROM relations WHERE entity_a IS NOT NULL AND entity_b IS NOT NULL) GROUP BY entity_a, entity_b, relation_type"""
)
def q48_import_relations(spark: SparkSession, d: str) -> DataFrame:
    """Relations imported raw: upper-case types, books as lists, first of equal keys."""
    rows = raw(spark, d, "relations").filter("entity_a IS NOT NULL AND entity_b IS NOT NULL").select("id", "entity_a", "entity_b", "relation_type", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("source_docs_json").alias("books"))
    return notes.import_relations(rows).select("entity_a", "entity_b", "relation_type", "weight", F.size("source_docs").alias("n_books"))


@_query(_with("SELECT name, CASE WHEN len(source_docs) = 0 THEN description WHEN description = '' THEN '来源: ' || array_to_string(source_docs, ', ') ELSE description || '; 来源: ' || array_to_string(source_docs, ', ') END AS description FROM me"))
def q49_import_concepts(spark: SparkSession, d: str) -> DataFrame:
    return notes.sourced(model.entities(spark, d).select("name", "description", F.col("source_docs").alias("books")))


@_query(_with("SELECT chunk_id, doc_id, section_path FROM mc WHERE chunk_id IN (SELECT min(chunk_id) FROM mc GROUP BY doc_id, section_path)"))
def q50_first_sections(spark: SparkSession, d: str) -> DataFrame:
    return notes.first_sections(model.chunks(spark, d)).select("chunk_id", "doc_id", "section_path")


@_query("SELECT user_id, CASE WHEN event_type = 'purchase' THEN 'record' WHEN event_type IN ('view', 'click') THEN 'navigate' ELSE 'search' END AS source, count(*) AS count, max(ts) AS last_seen FROM events GROUP BY ALL")
def q51_stream_traces(spark: SparkSession, d: str) -> DataFrame:
    """Trace counters kept by a stream over the event files."""
    out = scratch(spark, "trace-batches")
    path = f"{d}/events.parquet"
    streams.trace_counts(spark, posixpath.dirname(path), posixpath.basename(path), out).awaitTermination()
    return streams.latest_counts(spark, out)


@_query(_with("SELECT slug, true AS same_title, true AS same_entities FROM mi"))
def q52_frontmatter(spark: SparkSession, d: str) -> DataFrame:
    """Note files written with a head and read back; rows that don't come back equal are marked."""
    rows = model.insights(spark, d).select("slug", "title", "content", "entities")
    listed = F.when(F.size("entities") == 0, F.lit("entities: []")).otherwise(F.concat(F.lit("entities:\n"), F.array_join(F.transform("entities", lambda e: F.concat(F.lit("- "), e)), "\n")))
    note = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nslug: "), "slug", F.lit("\n"), listed, F.lit("\n---\n\n"), "content")
    read = notes.frontmatter(rows.select("slug", note.alias("note")), "slug", "note")
    return read.join(rows.select("slug", "title", "entities"), "slug").select("slug", (F.col("meta")["title"] == F.col("title")).alias("same_title"), (F.col("lists")["entities"] == F.col("entities")).alias("same_entities"))


@_query(
    _with(
        "SELECT path, count(*) AS n, min(doc_id) AS oldest, max(doc_id) AS newest, max(title) AS title FROM (SELECT * FROM md WHERE path NOT IN (SELECT path FROM incoming WHERE path IS NOT NULL) OR path IS NULL UNION ALL SELECT * FROM incoming) GROUP BY path",
        "incoming AS (SELECT max(doc_id) + 1000000 AS doc_id, path, 'once more' AS title, '' AS author FROM md WHERE path LIKE '%.md' GROUP BY path UNION ALL SELECT doc_id + 2000000, path || '.new', title, author FROM md WHERE path LIKE '%.txt')",
    )
)
def q53_replace_by_path(spark: SparkSession, d: str) -> DataFrame:
    """Documents after all Markdown books came again under new ids, and others under new paths."""
    docs = model.docs(spark, d)
    again = docs.filter("path LIKE '%.md'").groupBy("path").agg((F.max("doc_id") + 1000000).alias("doc_id")).select("doc_id", "path", F.lit("once more").alias("title"), F.lit("").alias("author"))
    fresh = docs.filter("path LIKE '%.txt'").select((F.col("doc_id") + 2000000).alias("doc_id"), F.concat("path", F.lit(".new")).alias("path"), "title", "author")
    return files.replace_by_path(docs, again.unionByName(fresh)).groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"), F.max("title").alias("title"))


@_query(_with("SELECT slug, CASE WHEN insight_id % 3 = 0 THEN 'added' WHEN insight_id % 3 = 1 THEN 'updated' ELSE 'skipped' END AS action FROM mi"))
def q54_sync_plan(spark: SparkSession, d: str) -> DataFrame:
    """What a sync of note files would do: files unknown, newer, or as old as their notes."""
    rows = model.insights(spark, d)
    made = F.to_timestamp("created_at")
    there = rows.filter("insight_id % 3 <> 0").select("slug", made.alias("updated_at"))
    newer = F.when(F.col("insight_id") % 3 == 1, made + F.expr("INTERVAL 1 DAY")).otherwise(made)
    return files.sync_plan(rows.select("slug", newer.alias("modified")), there)


@_query(_with("SELECT doc_id, section_path, count(*) AS n FROM mc GROUP BY ALL HAVING count(*) > 1"))
def q55_repeated_sections(spark: SparkSession, d: str) -> DataFrame:
    return chunking.repeated_sections(model.chunks(spark, d))


@_query(
    _with(
        "SELECT description AS name, arg_min(entity_type, entity_id) AS type, arg_min(name, entity_id) AS description, array_to_string(list_sort(list_filter(list_distinct(flatten(list(aliases))), lambda x: x <> description)), '|') AS aliases FROM me GROUP BY description"
    )
)
def q57_merge_found(spark: SparkSession, d: str) -> DataFrame:
    """Mentions merged by name: the first one's type and description, the aliases of all; here names are descriptions."""
    found = model.entities(spark, d).select(F.col("description").alias("name"), F.col("entity_type").alias("type"), "aliases", F.col("name").alias("description"), F.col("entity_id").alias("ord"))
    return curate.merge_entities(found).select("name", "type", "description", F.array_join("aliases", "|").alias("aliases"))


@_query(
    _with(
        "SELECT coalesce(o.name, f.name) AS name, CASE WHEN o.name IS NULL OR length(f.description) > 0 THEN array_to_string(coalesce(f.aliases, o.aliases), '|') ELSE array_to_string(o.aliases, '|') END AS aliases, array_to_string(list_sort(CASE WHEN f.name IS NULL THEN o.source_docs ELSE list_distinct(list_concat(coalesce(o.source_docs, []), ['7', '8'])) END), '|') AS docs FROM (SELECT * REPLACE (list_distinct(source_docs) AS source_docs) FROM me) o FULL JOIN fresh f ON o.name = f.name",
        "fresh AS (SELECT name, ['also ' || name, entity_type] AS aliases, CASE WHEN root = 'person' THEN 'seen again' ELSE '' END AS description FROM me WHERE cross_doc_count > 0 UNION ALL SELECT name || ' II', [name], 'new' FROM me WHERE source = 'manual')",
    )
)
def q58_upsert_aliases(spark: SparkSession, d: str) -> DataFrame:
    """Aliases and documents of entities after a run over documents 7 and 8."""
    e = model.entities(spark, d).withColumn("source_docs", F.array_distinct("source_docs"))
    again = e.filter("cross_doc_count > 0").select("name", F.lit("concept").alias("type"), F.array(F.concat(F.lit("also "), "name"), "entity_type").alias("aliases"), F.when(F.col("root") == "person", "seen again").otherwise("").alias("description"))
    new = e.filter("source = 'manual'").select(F.concat("name", F.lit(" II")).alias("name"), F.lit("concept").alias("type"), F.array("name").alias("aliases"), F.lit("new").alias("description"))
    done = curate.upsert_entities(e, again.unionByName(new), ["7", "8"])
    return done.select("name", F.array_join("aliases", "|").alias("aliases"), F.array_join(F.array_sort("source_docs"), "|").alias("docs"))


@_query(_with("SELECT slug, CASE WHEN insight_id % 3 = 2 THEN 'skipped' WHEN insight_id % 3 = 0 THEN 'added' ELSE 'updated' END AS action, CASE WHEN insight_id % 3 = 2 THEN title ELSE 'new ' || insight_id END AS title, CASE WHEN insight_id % 3 = 2 THEN array_to_string(entities, '|') ELSE 'a|b' END AS entities FROM mi"))
def q59_sync_notes(spark: SparkSession, d: str) -> DataFrame:
    """All notes written to files and read again: a third unknown to the table, a third older there, a third newer there."""
    rows = model.insights(spark, d)
    folder = scratch(spark, "notes")
    when = F.when(F.col("insight_id") % 3 == 2, "2999-01-01T00:00:00").otherwise("2000-01-01T00:00:00")
    known = rows.filter("insight_id % 3 <> 0").withColumn("updated_at", when)
    out = rows.select("slug", F.concat(F.lit("new "), "insight_id").alias("title"), "created_at", F.col("created_at").alias("updated_at"), "source_docs", F.array(F.lit("a"), F.lit("b")).alias("entities"), "content")
    note_files.write_notes(out, folder)
    found = note_files.read_notes(spark, folder)
    after, plan = note_files.merged(known, found)
    return after.join(plan, "slug").select("slug", "action", "title", F.array_join("entities", "|").alias("entities"))


_SAID = "said AS (SELECT DISTINCT name FROM (SELECT unnest(list_filter(string_split_regex(body, '[^A-Za-z]+'), lambda x: regexp_full_match(x, '[A-Z][a-z]{5,}'))) AS name FROM mc) WHERE NOT " + _NOISY + ")"


@_query(
    _with(
        f"""SELECT s.name, coalesce(e.entity_type, 'concept') AS entity_type, coalesce(e.source, 'auto') AS source, greatest(coalesce(c.n, 0), coalesce(v.n, 0)) AS cross_doc_count FROM said s LEFT JOIN me e USING (name)
        LEFT JOIN (SELECT x.name, count(DISTINCT doc_id) AS n FROM low_names x JOIN low_bodies ON contains(low_body, low) WHERE doc_id IS NOT NULL GROUP BY x.name) c USING (name)
        LEFT JOIN (SELECT name, count(DISTINCT doc_id) AS n FROM (SELECT name, unnest(source_docs) AS d FROM me) JOIN md ON d = CAST(doc_id AS VARCHAR) GROUP BY name) v USING (name)""",
        f"{_SAID}, low_names AS MATERIALIZED (SELECT name, {_ASCII.format('name')} AS low FROM said), low_bodies AS MATERIALIZED (SELECT doc_id, {_ASCII.format('body')} AS low_body FROM mc)",
    )
)
def q60_build_graph(spark: SparkSession, d: str) -> DataFrame:
    """Entities that the deterministic extractor finds in all chunks, upserted and counted over all documents."""
    chunks = model.chunks(spark, d)
    made = build.build(model.docs(spark, d), chunks, model.entities(spark, d), model.relations(spark, d), None, mode="full", most=2**31 - 1)
    said = chunks.select(F.explode(F.split("body", "[^A-Za-z]+")).alias("name")).filter("name RLIKE '^[A-Z][a-z]{5,}$'").distinct()
    return made.entities.join(said, "name", "left_semi").select("name", "entity_type", "source", "cross_doc_count")


@_query(
    _with(
        "SELECT rel_id, array_to_string(list_sort(list_distinct(list(note))), '|') AS notes FROM (SELECT r.rel_id, 'seen' AS note FROM mr r JOIN (SELECT DISTINCT entity_a, entity_b FROM mr WHERE weight > 3) h USING (entity_a, entity_b) UNION ALL SELECT rel_id, unnest(['kept', 'seen']) FROM mr WHERE weight <= 2) GROUP BY rel_id"
    )
)
def q61_annotate_stored(spark: SparkSession, d: str) -> DataFrame:
    """Remarks on the edges between pairs with a heavy edge, united with the notes that light edges have."""
    r = model.relations(spark, d)
    seen = r.filter("weight > 3").select("entity_a", "entity_b", F.lit(None).cast("string").alias("relation_type"), F.lit("seen").alias("note"))
    stored = r.filter("weight <= 2").select("rel_id", F.array(F.lit("kept"), F.lit("seen")).alias("notes"))
    return curate.annotate(r, seen, stored).select("rel_id", F.array_join("notes", "|").alias("notes"))


@_query(
    _with(
        f"""SELECT CAST(row_number() OVER (ORDER BY tier, pos) AS INTEGER) AS pos, insight_id, slug, source FROM (SELECT *, row_number() OVER (PARTITION BY insight_id ORDER BY tier, pos) AS rn FROM (
        SELECT insight_id, 0 AS tier, 'fts' AS source, row_number() OVER (ORDER BY rank, insight_id) AS pos FROM (SELECT * FROM {_bm25_sql('mi', 'insight_id', 'list_concat(' + _terms_sql("coalesce(title, '')") + ', ' + _terms_sql("coalesce(content, '')") + ')', ['zz', 'river'])} ORDER BY rank, insight_id LIMIT 20)
        UNION ALL SELECT insight_id, 1, 'like', row_number() OVER (ORDER BY created_at DESC, insight_id) FROM (SELECT * FROM mi WHERE contains({_ASCII.format('title')}, 'zz river') OR contains({_ASCII.format('content')}, 'zz river') ORDER BY created_at DESC, insight_id LIMIT 20)
        UNION ALL SELECT insight_id, 2, 'vector', row_number() OVER (ORDER BY dist, insight_id) FROM (SELECT vec_id + 1 AS insight_id, {_DIST} AS dist FROM embeddings WHERE vec_id + 1 IN (SELECT insight_id FROM mi) ORDER BY 2, 1 LIMIT 20)))
        JOIN mi USING (insight_id) WHERE rn = 1 ORDER BY tier, pos LIMIT 10"""
    )
)
def q62_notes_by_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The ten best notes where only vectors find any (a top-k search)."""
    vectors = raw(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("insight_id"), "embedding")
    return search.notes(model.insights(spark, d), "zz river", ["zz", "river"], 10, vectors, _first_vector(spark, d), index=_index(spark, d, "insights")).select("pos", "insight_id", "slug", "source")
