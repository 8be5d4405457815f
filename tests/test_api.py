import pytest

from quillgraph.api import Engine, clamp
from quillgraph.operators import importer

D = "doc_id long, path string, title string, author string"
C = "chunk_id long, doc_id long, section_path string, heading_level int, body string, line_start int"
E = "entity_id long, name string, entity_type string, root string, aliases array<string>, description string, source string, cross_doc_count long, source_docs array<string>"
R = "entity_a string, entity_b string, relation_type string, rel_id long, weight double"
N = "insight_id long, slug string, title string, content string, created_at string, source_docs array<string>, entities array<string>"
T = "name string, source string, count long, last_seen timestamp"


@pytest.fixture
def engine(spark, tmp_path):
    tables = [
        spark.createDataFrame([(1, "/b/a.md", "测试书", ""), (2, "/b/b.md", "书B", "")], D),
        spark.createDataFrame([(1, 1, "第一章", 1, "孔子曰：学而时习之，不亦说乎？", 0), (2, 2, "", 0, "hello world", 0), (3, 1, "x", 1, "hello again", 3)], C),
        spark.createDataFrame([(1, "孔子", "person.philosopher", "person", [], "", "auto", 0, []), (2, "论语", "work.classic", "work", [], "", "auto", 0, []), (3, "孟子", "person", "person", ["亚圣"], "", "auto", 0, [])], E),
        spark.createDataFrame([("孔子", "论语", "AUTHORED", 1, 10.0), ("孔子", "孟子", "INFLUENCED_BY", 2, 5.0)], R),
        spark.createDataFrame([], N),
        spark.createDataFrame([], T),
    ]
    return Engine(spark, *tables, books_dir=str(tmp_path))


def test_read(engine):
    assert engine.read("孔子")["results"][0]["book"] == "测试书"
    assert {r["book"] for r in engine.read("hello")["results"]} == {"测试书", "书B"}
    assert [r["book"] for r in engine.read("hello", source="书B")["results"]] == ["书B"]
    assert engine.read("absent", source="书B") == {"results": [], "message": "nothing found in 书B"}
    engine.tokenizer = None
    assert len(engine.read("hello")["results"]) == 2


def test_think_and_navigate(engine):
    assert [x["name"] for x in engine.think("孔子")["depths"][1]] == ["论语", "孟子"]
    assert engine.think("亚圣")["anchor"] == "孟子"
    assert engine.think("无")["found"] is False
    assert engine.think("孔子", book="unknown book")["found"]
    shown = engine.navigate("孔子")
    assert [x["neighbor"] for x in shown["anchored"]] == ["论语", "孟子"] and engine.navigate("不存在") is None
    assert {(r.name, r["count"]) for r in engine.traces.collect()} == {("孔子", 1), ("论语", 1), ("孟子", 1)}


def test_record_and_study(engine):
    first = engine.record("这是一条测试内容。", "测试笔记")
    assert first == {"ok": True, "slug": "测试笔记-aa108c13", "duplicate": False}
    assert engine.record("这是一条测试内容。", "测试笔记")["duplicate"]
    with pytest.raises(ValueError):
        engine.record("  ")
    assert engine.study() == {"docs": 2, "entities": 3, "relations": 2, "insights": 1, "relation_types": {"AUTHORED": 1, "INFLUENCED_BY": 1}}


def test_ingest_replaces_by_path(engine, tmp_path):
    (tmp_path / "new.md").write_text("# Title\n\n## One\nSocrates teaches Platonic things. Socrates!\n## Two\nmore")
    for _ in range(2):
        out = engine.ingest("new.md")
        assert (out["ok"], out["title"], out["chunks"]) == (True, "Title", 2) and out["entities_found"] == 2
    assert engine.docs.filter("title = 'Title'").count() == 1 and engine.chunks.count() == 5
    (tmp_path / "twice.md").write_text("# A\nx\n# A\ny")
    with pytest.raises(ValueError, match="two sections"):
        engine.ingest("twice.md")
    with pytest.raises(ValueError):
        engine.ingest("../etc/passwd")


def test_arguments(engine):
    assert [clamp(x) for x in (None, 100, -5, "7")] == [3, 20, 1, 7]
    for bad in ("abc", 1.5, True):
        with pytest.raises(ValueError):
            clamp(bad)
    for name, args in [("think", {}), ("nope", {}), ("read", {"query": "x", "top_n": "abc"}), ("read", {"query": " "})]:
        with pytest.raises(ValueError):
            engine.call(name, args)


def test_stages_go_on(spark, tmp_path):
    ran, marks = [], f"file://{tmp_path}/marks"
    stages = [("a", lambda: ran.append("a")), ("b", lambda: ran.append("b"))]
    assert importer.run_stages(spark, marks, stages[:1]) == ["a"]
    assert importer.run_stages(spark, marks, stages) == ["b"] and importer.run_stages(spark, marks, stages) == [] and ran == ["a", "b"]


def test_import_stages(spark):
    old = spark.createDataFrame([("/x/books/01_Plato.md",), ("/x/books/b.txt",), ("/x/notes/c.md",), ("/x/books/k.md",)], "path string")
    known = spark.createDataFrame([("/x/books/k.md", 1)], "path string, doc_id long")
    assert [(r.path, r.title) for r in importer.new_docs(old, known).collect()] == [("/x/books/01_Plato.md", "Plato")]
    parts = spark.createDataFrame([(2, "/x/books/k.md", "s", "late"), (1, "/x/books/k.md", "s", "first"), (3, "/x/books/k.md", "t", "b"), (4, "gone", "s", "c")], "id long, path string, section_path string, body string")
    meta = spark.createDataFrame([("/x/books/k.md", "t", 2, 7)], "path string, section_path string, heading_level int, line_start int")
    none = spark.createDataFrame([], "doc_id long, section_path string")
    rows = importer.new_chunks(parts, meta, known, none)
    assert {(r.section_path, r.body, r.heading_level, r.line_start) for r in rows.collect()} == {("s", "first", 0, 0), ("t", "b", 2, 7)}
    assert importer.new_chunks(parts, meta, known, rows).count() == 0
    asked = spark.createDataFrame([("t1", "q", None, None), ("t1", "q", None, None)], "timestamp string, query string, tool string, results string")
    first = importer.history(asked, spark.createDataFrame([], "query_text string, tool_name string, created_at string"))
    assert first.count() == 1 and importer.history(asked, first).count() == 0
    points = spark.createDataFrame([(2, "b", "active"), (1, "a", "active"), (3, "c", "off")], "id int, name string, status string")
    assert importer.interest_points(points).first().value == '[{"id":1,"name":"a"},{"id":2,"name":"b"}]'
    note = spark.createDataFrame([('{"title": "My Note", "content": "c"}',), ("broken",)], "text string")
    assert [(r.slug, r.content) for r in importer.old_insights(note).collect()] == [("my note", "c")]
    vectors = spark.createDataFrame([(1, [0.5]), (2, [0.5])], "chunk_id long, embedding array<float>")
    assert importer.new_vectors(vectors, vectors.filter("chunk_id = 1")).count() == 1


def test_migrations(spark):
    chunks = spark.createDataFrame([(1, 1, "s"), (2, 1, "s"), (3, 1, "t")], "chunk_id long, doc_id long, section_path string")
    out, ran = importer.migrate({"chunks": chunks, "relations": spark.createDataFrame([(1,)], "rel_id long")})
    assert out["chunks"].count() == 2 and out["relations"].first().metadata == "{}" and importer.pending(ran) == []
    assert importer.migrate(out, ran)[1] == []
