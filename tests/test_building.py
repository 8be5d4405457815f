import pytest

from quillgraph import providers
from quillgraph.api import Engine
from quillgraph.functions import pack
from quillgraph.operators import importer, notes
from quillgraph.operators.chunking import window_cuts
from quillgraph.sources import note_files
from test_api import C, D, E, N, R, T


def test_window_cuts():
    assert window_cuts("") == [] and window_cuts("short") == [(0, 5)]
    text = "a" * 900 + "\n\n" + "b" * 900
    assert window_cuts(text) == [(0, 900), (750, 1802)]
    assert window_cuts("x" * 3000) == [(0, 1500), (1350, 2850), (2700, 3000)]
    assert window_cuts("a" * 100 + "\n\n" + "b" * 1600)[0] == (0, 1500)
    with pytest.raises(ValueError):
        window_cuts("x", 100, 60)


def test_providers():
    assert providers.make("embedding", "none") is None and providers.names("tokenizer") == ["none", "spaces", "words"]
    with pytest.raises(ValueError):
        providers.make("embedding", "nobody")
    with pytest.raises(ValueError):
        providers.add("oracle", "x", lambda: None)
    e = providers.make("embedding", "hashed", width=8)
    assert e(["a b"]) == e(["b a"]) and len(e([""])[0]) == 8
    assert providers.words("道可道 Way2go") == ["道可", "可道", "way2go"]
    assert providers.make("reranker", "overlap")("red ship", ["blue", "a red ship", "ship"])[0][0] == 1

    def fails(*_):
        raise RuntimeError("down")

    assert providers.Chain([fails, providers.echo])("x").startswith("{")
    with pytest.raises(RuntimeError):
        providers.Chain([fails])("x")
    tries = []
    assert providers.Patient(lambda x: tries.append(x) or (fails() if len(tries) < 3 else x), (0, 0, 0))("y") == "y" and len(tries) == 3
    assert providers.embed_query(fails, "x") is None and providers.embed_query(None, "x") is None


def test_pack(tmp_path, spark):
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "ask.md").write_text("Find {types} in {text}")
    (tmp_path / "domain.json").write_text('{"name": "d", "entity_types": {"person": ["ruler", "author"], "work": null}, "relation_types": {"WROTE": {"weight": 4, "triplets": [["person", "work"]]}, "NEAR": null}}')
    (tmp_path / "hooks.py").write_text("class Mine:\n    validators = (len,)\n")
    p = pack.load(str(tmp_path))
    assert p.flat_types() == ["person", "person.author", "person.ruler", "work"] and p.relations["NEAR"] == (1.0, ())
    assert p.prompt("ask", text="T") == "Find - person\n- person.author\n- person.ruler\n- work in T" and p.hooks.validators == (len,)
    assert p.triplet_text() == "- person -WROTE-> work\n- any -NEAR-> any" and p.relation_text().startswith("- WROTE (weight 4)")
    assert p.allowed_triplets(spark).count() == 1 and pack.load(str(tmp_path)) is p
    with pytest.raises(ValueError):
        p.prompt("none")
    with pytest.raises(ValueError):
        pack.load(str(tmp_path / "prompts"))
    assert "person.philosopher" in pack.reading().flat_types()


def test_note_files_round_trip_and_sync(spark, tmp_path):
    folder = f"{tmp_path}/notes"
    rows = [("my-insight-hash1234", "T", "2024-01-01T00:00:00", "2024-01-01T00:00:00", ["三体"], ["黑暗森林"], "body\n\ntext"), ("b", "B", "x", "2999-01-01T00:00:00", [], None, "")]
    df = spark.createDataFrame(rows, note_files.NOTE)
    for _ in range(2):
        assert note_files.write_notes(df, folder).count() == 2
    back = {r.slug: r for r in note_files.read_notes(spark, folder).collect()}
    assert back["my-insight-hash1234"].entities == ["黑暗森林"] and back["my-insight-hash1234"].content == "body\n\ntext" and back["b"].entities == []
    (tmp_path / "notes" / "plain.md").write_text("no head")
    (tmp_path / "notes" / "skip.txt").write_text("x")
    after, counts = note_files.sync(spark, folder, df)
    got = {r.slug: r for r in after.collect()}
    assert counts == {"checked": 3, "added": 1, "updated": 1, "skipped": 1}
    assert got["plain"].title == "plain" and got["plain"].content == "no head" and len(got) == 3
    with pytest.raises(Exception, match="not a file name"):
        note_files.write_notes(spark.createDataFrame([("../x", "", "", "", [], [], "")], note_files.NOTE), folder)
    note_files.sync_stream(spark, folder, f"file://{tmp_path}/table", f"file://{tmp_path}/marks").awaitTermination()
    assert {r.slug for r in spark.read.parquet(f"file://{tmp_path}/table/v=0").collect()} == {"my-insight-hash1234", "b", "plain"}


def test_engine_with_vectors_and_notes(spark, tmp_path):
    tables = [spark.createDataFrame([], x) for x in (D, C, E, R, N, T)]
    engine = Engine(spark, *tables, books_dir=str(tmp_path), embedding=providers.HashedEmbedding(16))
    (tmp_path / "a.md").write_text("# Title\n\n## One\nSocrates teaches Platonic things to many people.\n## Two\nquiet harbour lights at night")
    out = engine.ingest("a.md")
    assert out["vectors"] == 2 and out["graph_error"] is None and out["entities_found"] == 2
    assert {r.name: r.cross_doc_count for r in engine.entities.collect()} == {"Socrates": 1, "Platonic": 1}
    assert engine.ingest("a.md")["vectors"] == 2 and engine.vectors.count() == 2
    engine.tokenizer = None
    assert engine.read("lights harbour quiet")["results"][0]["section"] == "Two"
    engine.tokenizer = str.split
    engine.record("Socrates walked with Plutarch.", "Walk")
    engine.insights = engine.insights.drop("insight_id").selectExpr("CAST(1 AS long) AS insight_id", "*")
    assert engine.link_notes()["registered"] == 1
    counts = {r.name: r.cross_doc_count for r in engine.entities.collect()}
    assert counts["Plutarch"] == 0 and counts["Socrates"] == 1
    assert engine.search_notes("Plutarch")[0]["title"] == "Walk"

    def broken(prompt):
        raise RuntimeError("x")

    engine.extractor = broken
    assert engine.ingest("a.md")["entities_found"] == 0


def test_notes_get_their_names(spark):
    df = spark.createDataFrame([(1, "Zenobia met Socrates.", []), (2, "Socrates", ["kept"]), (3, None, None)], "insight_id long, content string, entities array<string>")
    from quillgraph.operators.curate import capitalised

    assert {r.insight_id: r.entities for r in notes.extracted(df, capitalised).collect()} == {1: ["Zenobia", "Socrates"], 2: ["kept"], 3: []}


def test_import_in_stages(spark, tmp_path):
    make = spark.createDataFrame
    old = {
        "docs": make([("/x/books/12_Odes.md", ""), ("/x/books/7_.md", "pre\n# Found Title\n"), ("/x/other/a.md", "")], "path string, text string"),
        "chunks": make([(1, "/x/books/12_Odes.md", "s", "body"), (2, "/x/books/12_Odes.md", "s", "again")], "id long, path string, section_path string, body string"),
        "meta": make([("/x/books/12_Odes.md", "s", 2, 9)], "path string, section_path string, heading_level int, line_start int"),
        "insights": make([('{"title": "A Note", "content": "c"}',), ("broken",)], "text string"),
        "points": make([(1, "p", "active"), (2, "q", "gone")], "id long, name string, status string"),
        "traces": make([("n", "s", 2, "2024"), ("n", "s", 5, "2023")], "name string, source string, count long, last_seen string"),
    }
    store = importer.Store(spark, f"file://{tmp_path}/new")
    out = importer.import_all(store, old)
    assert out["rows"] == {"docs": 2, "chunks": 1, "vectors": 0, "entities": 0, "relations": 0, "traces": 1, "concepts": 0, "insights": 1, "history": 0, "settings": 1} and len(out["ran"]) == 11
    assert {r.title for r in store.get("docs", importer.SCHEMAS["docs"]).collect()} == {"Odes", "Found Title"}
    assert store.get("chunks", importer.SCHEMAS["chunks"]).first().line_start == 9 and store.get("insights", importer.SCHEMAS["insights"]).first().slug == "a note"
    with pytest.raises(ValueError, match="completed"):
        importer.import_all(store, old)


def test_migrations_in_order(spark):
    tables = {"entity_summaries": spark.range(1), "traces": spark.createDataFrame([("n", "s", 1, "1"), ("n", "s", 2, "2")], importer.SCHEMAS["traces"])}
    out, ran = importer.migrate(tables)
    assert len(ran) == 7 and "entity_summaries" not in out and out["traces"].count() == 1
    assert importer.status(ran) == {"version": "0.2", "applied": ran, "pending": []} and importer.status([])["version"] is None


def test_bucketed_stream_touches_only_its_buckets(spark, tmp_path):
    from quillgraph.streaming.traces import ingest_stream, ingested

    src, table = f"file://{tmp_path}/src", f"file://{tmp_path}/table"
    assert ingested(spark, table) is None
    for part in ([(f"p{i}", 1) for i in range(30)], [("p3", 2), ("new", 3)]):
        spark.createDataFrame(part, "path string, v int").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("path string, v int").parquet(src)
        ingest_stream(stream, table, f"file://{tmp_path}/check", 16).awaitTermination()
    rows = {r.path: r.v for r in ingested(spark, table).collect()}
    assert len(rows) == 31 and rows["p3"] == 2 and rows["new"] == 3 and rows["p4"] == 1
    assert len(list((tmp_path / "table" / "v=1").glob("bucket=*"))) <= 2
