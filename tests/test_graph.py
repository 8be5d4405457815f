import math
import random

from quillgraph.operators import graph

ENTITY = "entity_id long, name string, entity_type string, root string, aliases array<string>, description string, source string, cross_doc_count long, source_docs array<string>"
EDGE = "rel_id long, entity_a string, entity_b string, relation_type string, weight double"
TRACE = "name string, source string, count long, last_seen string"


def tables(spark, entities, edges, traces=()):
    e = spark.createDataFrame([(i, n, t, t.split(".")[0], list(a), "", "auto", x, list(d)) for i, (n, t, a, x, d) in enumerate(entities)], ENTITY)
    r = spark.createDataFrame([(i, a, b, k, float(w)) for i, (a, b, k, w) in enumerate(edges)], EDGE)
    return e, r, spark.createDataFrame([(*t, "") for t in traces], TRACE)


def think(spark, e, r, t, anchor, mode="divergent", depth=None):
    topic = graph.topics(e, spark.createDataFrame([(anchor,)], "anchor string"))
    rows = graph.think(r, e, t, topic, mode, depth).collect()
    return {d: [x.name for x in sorted((y for y in rows if y.depth == d), key=lambda y: y.pos)] for d in {x.depth for x in rows}}


def test_hot_stops(spark):
    names = [(n, "concept", (), 0, ()) for n in "ABCD"]
    e, r, t = tables(spark, names, [("A", "B", "MENTIONS", 5), ("A", "C", "MENTIONS", 3), ("B", "D", "MENTIONS", 1)], [("B", "navigate", 6)])
    assert think(spark, e, r, t, "A") == {1: ["B", "C"]}


def test_width_is_three(spark):
    names = [(n, "concept", (), 0, ()) for n in ("A", "B1", "B2", "B3", "B4", "C1")]
    e, r, t = tables(spark, names, [("A", f"B{i}", "MENTIONS", 5 - i) for i in range(1, 5)] + [("B1", "C1", "MENTIONS", 1)])
    assert think(spark, e, r, t, "A") == {1: ["B1", "B2", "B3"], 2: ["C1"]}


def plain_think(entities, edges, anchor):
    kinds = {n: (t, x) for n, t, _, x, _ in entities}
    top = max([1.0, *(w for *_, w in edges)])
    depths, seen, frontier = {}, {anchor}, [anchor]
    for depth in range(1, 7):
        got = {}
        for node in frontier:
            out = [(b, w, 0, i) for i, (a, b, _, w) in enumerate(edges) if a == node] + [(a, w, 1, i) for i, (a, b, _, w) in enumerate(edges) if b == node and a != b]
            for name, w, _, _ in sorted(out, key=lambda x: (x[2], x[3])):
                if name in seen:
                    continue
                seen.add(name)
                kind, many = kinds.get(name, ("unknown", 0))
                mine = kinds[anchor][0]
                compat = 0.2 if kind == "unknown" else 1.0 if kind == mine else 0.7 if kind.split(".")[0] == mine.split(".")[0] else 0.2
                if compat * 0.6 + math.exp(-depth / 2) * 0.4 >= 0.2:
                    got[name] = min(w / top, 1) * 0.5 ** (depth - 1) * 0.5 + min(many / 50, 1) * 0.2
        if not got:
            break
        best = sorted(got, key=lambda n: -got[n])[:3]
        depths[depth] = best
        frontier = best
    return depths


def test_like_a_plain_search_on_random_graphs(spark):
    rng = random.Random(4)
    for _ in range(2):
        entities = [(f"n{i}", rng.choice(["concept", "concept.school", "person", "work"]), (), rng.randrange(60), ()) for i in range(14)]
        edges = [(f"n{rng.randrange(16)}", f"n{rng.randrange(16)}", "MENTIONS", rng.randrange(1, 9) + rng.random()) for _ in range(40)]
        e, r, t = tables(spark, entities, edges)
        assert think(spark, e, r, t, "n0") == plain_think(entities, edges, "n0")


def test_deep_follows_the_most_coherent(spark):
    e, r, t = tables(spark, [("A", "person", (), 0, ()), ("B", "work", (), 0, ()), ("C", "person", (), 0, ()), ("D", "person", (), 0, ())], [("A", "B", "AUTHORED", 10), ("A", "C", "KNOWS", 1), ("C", "D", "KNOWS", 1)])
    assert think(spark, e, r, t, "A", "deep") == {1: ["C"], 2: ["D"]}


def test_anchor_tiers(spark):
    e, _, _ = tables(spark, [("王守仁", "person", ("王阳明", "阳明先生"), 0, ()), ("Kant", "person", (), 0, ())], [("a", "b", "KNOWS", 1)])
    asked = spark.createDataFrame([("王守仁",), ("王阳明",), ("about Kant",), ("阳明知行合一",), ("nothing",)], "query string")
    got = {x.query: (x.name, x.tier) for x in graph.anchors(e, asked).collect()}
    assert got == {"王守仁": ("王守仁", 1), "王阳明": ("王守仁", 2), "about Kant": ("Kant", 3), "阳明知行合一": ("王守仁", 4)}


def test_empty_graph(spark):
    e, r, _ = tables(spark, [("A", "person", (), 0, ())], [("A", "A", "KNOWS", 1)])
    assert graph.navigate(r.limit(0), e, spark.createDataFrame([("A",)], "seed string")).count() == 0
    assert graph.adjacency(r).count() == 1


def test_card_finds_books_by_name(spark):
    e, r, t = tables(spark, [("Plato", "person", (), 0, ()), ("Kant", "person", (), 0, ("2",)), ("Hume", "person", (), 0, ("9",))], [])
    notes = spark.createDataFrame([], "insight_id long, title string, slug string, entities array<string>")
    docs = spark.createDataFrame([(1, "One"), (2, "Two"), (3, "Three")], "doc_id long, title string")
    chunks = spark.createDataFrame([(1, "on plato"), (1, "Plato and Kant"), (3, "Plato, Hume")], "doc_id long, body string")
    shelf = lambda name: [(x.pos, x.item) for x in graph.entity_card(name, e, r, notes, docs, t, chunks).filter("section = 'book'").orderBy("pos").collect()]
    assert shelf("Plato") == [(1, "One"), (2, "Three")] and shelf("Kant") == [(1, "Two")] and shelf("Hume") == [(1, "Three")] and shelf("on") == []


def test_notes_by_vectors(spark):
    from quillgraph.operators import search

    rows = [(1, "a", "River", "the river", "x", 1), (2, "b", "Stream", "water", "x", 2), (3, "c", "Stone", "hard", "x", 3)]
    notes = spark.createDataFrame(rows, "insight_id long, slug string, title string, content string, source string, created_at long").drop("source")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (7, [1.0, 0.0])], "insight_id long, embedding array<double>")
    found = search.notes(notes, "river", ["river"], 2, vectors, [1.0, 0.0]).orderBy("pos").collect()
    assert [(x.insight_id, x.source) for x in found] == [(1, "fts"), (2, "vector")]
    assert [x.insight_id for x in search.notes(notes, "river", ["river"], 2).collect()] == [1]
