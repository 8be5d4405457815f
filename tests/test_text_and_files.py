import random
import sqlite3
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import domain, text
from quillgraph.operators import chunking, curate, notes, search
from quillgraph.plans import grams
from quillgraph.sources import files


def test_window_rules():
    assert chunking.window_cuts("", 10, 2) == []
    assert chunking.window_cuts("a" * 25, 10, 2) == [(0, 10), (8, 18), (16, 25)]
    assert chunking.window_cuts("a" * 7 + "\n\n" + "b" * 9, 10, 2)[0] == (0, 7)
    with pytest.raises(ValueError):
        chunking.window_cuts("abc", 10, 6)


def test_sections_skip_empty_headings(spark):
    df = spark.createDataFrame([(1, "# 论语\n\n## 学而篇\n学而\n## 为政篇\n为政\n#### deep\nx"), (2, None), (3, "")], "k long, t string")
    rows = [(r.k, r.section_path, r.heading_level, r.line_start) for r in chunking.sections(df, "k", "t").orderBy("k", "line_start").collect()]
    assert rows == [(1, "学而篇", 2, 2), (1, "为政篇", 2, 4)]


def test_chunked_falls_back_for_long_markdown(spark):
    df = spark.createDataFrame([(1, "# a\nb"), (2, "x" * 100_001)], "k long, t string")
    got = {r.k: r["count"] for r in chunking.chunked(df, "k", "t", True).groupBy("k").count().collect()}
    assert got[1] == 1 and got[2] > 70


def test_json_tiers(spark):
    rows = [('{"a": 1}', '{"a": 1}'), ('x\n```json\n{"a": 2}\n```', '{"a": 2}'), ('say {"a": 3} ok', '{"a": 3}'), ("none", None), (None, None)]
    df = spark.createDataFrame([(a,) for a, _ in rows], "t string")
    assert [r[0] for r in df.select(text.json_in(F.col("t"))).collect()] == [b for _, b in rows]


def test_slug_and_title(spark):
    df = spark.createDataFrame([("测试笔记", "这是一条测试内容。")], "t string, c string")
    assert df.select(text.slug_of(F.col("t"), F.col("c"))).first()[0] == "测试笔记-aa108c13"
    titles = spark.createDataFrame([("a\n# Head \nb",), ("\nx",), ("  first  \nx",)], "t string").select(text.title_of(F.col("t"))).collect()
    assert [r[0] for r in titles] == ["Head", None, "first"]


def test_bm25_like_sqlite(spark):
    bodies = ["the quiet ledger of the ledgers", "ledger", "quiet winter", "a river and a ledger, quietly", "none of it", "another ledger: quiet, quiet!"]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE f USING fts5(body)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text search in this sqlite3")
    con.executemany("INSERT INTO f(rowid, body) VALUES (?, ?)", list(enumerate(bodies)))
    for terms in (["ledg"], ["quiet", "ledger"], ["win"]):
        wanted = dict(con.execute("SELECT rowid, rank FROM f WHERE f MATCH ?", (" ".join(f"{t}*" for t in terms),)).fetchall())
        got = {r.k: r["rank"] for r in search.bm25(spark.createDataFrame(list(enumerate(bodies)), "k long, body string"), "k", ["body"], terms).collect()}
        assert got.keys() == wanted.keys() and all(abs(got[k] - wanted[k]) < 1e-6 for k in got)
    assert search.bm25(spark.createDataFrame([(1, "x")], "k long, body string"), "k", ["body"], []).count() == 0


def test_rerank_and_its_failure(spark):
    docs = spark.createDataFrame([(1, "p", "T", "")], "doc_id long, path string, title string, author string")
    chunks = spark.createDataFrame([(i, 1, "", f"a ledger {i}") for i in range(4)], "chunk_id long, doc_id long, section_path string, body string")
    order = lambda **k: [r.chunk_id for r in search.hybrid(chunks, docs, "ledger", ["ledger"], 3, **k).orderBy("pos").collect()]
    plain = order()
    assert order(rerank=lambda q, d: [(2, 0.9)])[0] == sorted(range(4))[2] and len(order(rerank=lambda q, d: [(2, 0.9)])) == 3

    def fails(q, d):
        raise RuntimeError

    assert order(rerank=fails) == plain


def test_wrong_width_is_an_error(spark):
    with pytest.raises(Exception, match="another width"):
        search.knn(spark.createDataFrame([(1, [1.0])], "k long, v array<double>"), "k", "v", [1.0, 2.0], 1).collect()


def test_triplets(spark):
    rows = [("AUTHORED", "person.author", "work.novel"), ("AUTHORED", "work", "person"), ("BELONGS_TO", "person", "concept.school"), ("MENTIONS", "a", "b"), ("NOPE", "person", "work")]
    df = spark.createDataFrame(rows, "relation_type string, type_a string, type_b string")
    assert {r.relation_type for r in domain.valid_triplets(df).collect()} == {"AUTHORED", "MENTIONS"}
    assert {r.relation_type for r in domain.valid_triplets(df, strict=True).collect()} == {"AUTHORED", "MENTIONS", "BELONGS_TO"}


def test_extraction_asks_again_and_skips(spark):
    asked = spark.createDataFrame([(0, 0, "Plato meets Aristotle"), (1, 0, "bad")], "batch long, part int, prompt string")

    def asker(prompt):
        if prompt == "bad":
            raise RuntimeError
        return curate.capitalised(prompt)

    entities, relations = curate.extract(asked, asker)
    assert {r.name for r in entities.collect()} == {"Aristotle"} and relations.count() == 0


def test_merge_keeps_first_and_unites_aliases(spark):
    df = spark.createDataFrame([("A", "person", ["x"], "d1", 1), ("A", "work", ["y", "A"], "d2", 2)], "name string, type string, aliases array<string>, description string, ord long")
    row = curate.merge_entities(df).first()
    assert (row.type, row.description, row.aliases) == ("person", "d1", ["x", "y"])


def test_mention_counts_like_plain_containment(spark):
    bodies = [(1, "Kant and Plato"), (2, "plato, PLATO"), (3, "A kantian"), (4, ""), (5, "ab 孔子")]
    names = ["Plato", "Kant", "孔子", "ab", "none at all"]
    got = {r.name: r.n_docs for r in curate.mention_counts(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(bodies, "doc_id long, body string")).collect()}
    wanted = {n: k for n in names if (k := sum(n.lower() in b.lower() for _, b in bodies))}
    assert got == wanted


def test_mention_counts_meets_few_pairs_if_names_begin_alike(spark, monkeypatch):
    """What all names and texts share ("The ") doesn't pair them: 200 names and 300 texts made 60,000 pairs by first characters."""
    made = {}
    keep = curate.written

    def counting(df, label, *more):
        out = keep(df, label, *more)
        made[label] = out.count()
        return out

    monkeypatch.setattr(curate, "written", counting)
    names = [f"The {i:03d}th Garden" for i in range(200)]
    bodies = [(i, f"the tower and the {i:03d}TH garden") for i in range(300)]
    got = curate.mention_counts(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(bodies, "doc_id long, body string"))
    assert {r.name: r.n_docs for r in got.collect()} == {n: 1 for n in names}
    assert made["mention-pairs"] <= 2 * len(names)


def test_mention_counts_takes_chunks_without_id(spark):
    chunks = spark.createDataFrame([(None, 1, "of Plato"), (None, 2, "to Plato"), (3, 2, "plato"), (4, None, "Plato")], "chunk_id long, doc_id long, body string")
    got = curate.mention_counts(spark.createDataFrame([("Plato",)], "name string"), chunks).collect()
    assert [tuple(r) for r in got] == [("Plato", 2)]


def test_mention_counts_of_all_lengths(spark):
    """Names of 1 byte to some dozens, across the ends of texts, at their starts and ends, with odd characters."""
    rng = random.Random(5)
    bodies = [(i % 40, "".join(rng.choice("abA é孔子\n😀\0") for _ in range(rng.randrange(40)))) for i in range(400)]
    names = {b[k : k + rng.randrange(1, 20)] for _, b in bodies for k in [rng.randrange(30)]} | {"zz", "abababababababab", bodies[0][1] + bodies[1][1]}
    got = {r.name: r.n_docs for r in curate.mention_counts(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(bodies, "doc_id long, body string")).collect()}
    low = str.maketrans("AB", "ab")
    wanted = {n: k for n in names if n and (k := len({d for d, b in bodies if n.translate(low) in b.translate(low)}))}
    assert got == wanted


def test_grams_of_several_bitmaps_and_steps(spark, monkeypatch):
    words = [f"word{i * 7919:08d}" for i in range(3000)]
    names = spark.createDataFrame([(w,) for w in words[::2]], "low string")
    texts = spark.createDataFrame([(i, " ".join(words[i : i + 3])) for i in range(2998)], "id long, body string")
    asked = grams.grams_of(names, "low").filter("gram % 3 = 0")
    one = {tuple(r) for r in grams.texts_with(asked, texts, "id", "body").join(asked.select("gram").distinct(), "gram").collect()}
    counts = {tuple(r) for r in grams.texts_with(asked, texts, "id", "body", count=True).join(asked.select("gram").distinct(), "gram").collect()}
    monkeypatch.setattr(grams, "MOST_BITS", 1 << 16)
    assert {tuple(r) for r in grams.texts_with(asked, texts, "id", "body").join(asked.select("gram").distinct(), "gram").collect()} == one
    assert {tuple(r) for r in grams.texts_with(asked, texts, "id", "body", count=True).join(asked.select("gram").distinct(), "gram").collect()} == counts
    wanted = {r.gram for r in asked.collect()}
    plain = {(g, i) for i in range(2998) for t in [" ".join(words[i : i + 3]).encode()] for k in range(len(t) - 7) if (g := int.from_bytes(t[k : k + 8], "little", signed=True)) in wanted}
    assert one == plain and counts == set(Counter(g for g, _ in plain).items())
    every = np.full(1 << 10, (1 << 64) - 1, np.uint64)
    some = pa.array(["", "abcdefghij", "x", "", "abcdefgh" * 9, "ab"]).slice(1)
    whole, parts = grams.found(some.cast(pa.binary()), every, (8, 4, 2, 1)), grams.found(some.cast(pa.binary()), every, (8, 4, 2, 1), step=5)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([b"abc", b"", b"d" * 50, None, b"e" * 9, b"f"])], ["id", "body"])
    assert [p.column(0).to_pylist() for p in grams.parts_of(batch, 10)] == [[0, 1], [2, 3], [4, 5]] and pa.Table.from_batches(grams.parts_of(batch, 1)) == pa.Table.from_batches([batch])


def test_heads_round_trip():
    meta, lists, body = {"title": "A: b", "slug": "s"}, {"entities": ["黑暗森林"], "source_docs": []}, "Body\n---\nmore"
    assert notes.parse_head(notes.head_text(meta, lists, body)) == (meta, lists, body)
    assert notes.parse_head("no head") == (None, {}, "no head")


def test_books(spark, tmp_path):
    (tmp_path / "a.md").write_text("# 论语\n\ntext")
    (tmp_path / "notes.txt").write_text("one line")
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("nav.xhtml", "<p>nav</p>")
        z.writestr("page.xhtml", "<h1>Title</h1><p>words</p>")
    got = {r.path.rsplit("/", 1)[1]: (r.title, r.author, r.text) for r in files.read_books(spark, [str(tmp_path / n) for n in ("a.md", "notes.txt", "b.epub")]).collect()}
    assert got["a.md"][0] == "论语" and got["notes.txt"] == ("notes", "", "one line") and got["b.epub"][2] == "Title words"
    with pytest.raises(ValueError, match="Unsupported"):
        files.check_paths(["data.pdf"])


def _epub(path, pages, package):
    with zipfile.ZipFile(path, "w") as z:
        for name, text in pages.items():
            z.writestr(name, text)
        if package:
            z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
            z.writestr("OEBPS/book.opf", package)


def test_whole_epub(tmp_path):
    pages = {
        "OEBPS/nav.xhtml": "<nav>contents</nav>", "OEBPS/a stock.xhtml": "<html><head><title/><style>p{}</style></head><body><h2>Second</h2><ul><li>one</li><li><p>two</p></li></ul><p># not\n a  heading</p></body></html>",
        "OEBPS/z.xhtml": "<html><head><title>no</title></head><body><h1>First<br/>Part</h1><p>a &amp; <i>b</i></p><pre>x\n  y</pre></body></html>",
    }
    package = """<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="n" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="a" href="a%20stock.xhtml" media-type="application/xhtml+xml"/>
    <item id="z" href="z.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="n"/><itemref idref="z"/><itemref idref="a"/></spine></package>"""
    _epub(tmp_path / "b.epub", pages, package)
    assert files.epub_text((tmp_path / "b.epub").read_bytes()) == "# First Part\n\na & b\n\nx\n  y\n\n## Second\n\n- one\n\n- two\n\n\\# not a heading"
    _epub(tmp_path / "c.epub", {"toc.html": "<p>no</p>", "ch10.html": "<p>ten</p>", "ch2.html": "<p>two</p>"}, None)
    assert files.epub_text((tmp_path / "c.epub").read_bytes()) == "two\n\nten"
    assert files.epub_text(b"broken") == ""


def test_paths_stay_within(tmp_path):
    (tmp_path / "x.md").write_text("x")
    assert files.within("x.md", str(tmp_path)).endswith("x.md")
    (tmp_path / "link.md").symlink_to(tmp_path / "x.md")
    for bad in ("../../etc/passwd", "link.md", "none.md"):
        with pytest.raises(ValueError):
            files.within(bad, str(tmp_path))


def test_replaced_stream(spark, tmp_path):
    from quillgraph.streaming.traces import ingest_stream

    src, table = f"{tmp_path}/src", f"file://{tmp_path}/table"
    for part in ([("p", 1)], [("p", 2), ("q", 3)]):
        spark.createDataFrame(part, "path string, v int").coalesce(1).write.mode("append").parquet(f"file://{src}")
        stream = spark.readStream.schema("path string, v int").parquet(f"file://{src}")
        ingest_stream(stream, table, f"file://{tmp_path}/check").awaitTermination()
    assert {(r.path, r.v) for r in spark.read.parquet(f"{table}/v=1").collect()} == {("p", 2), ("q", 3)}
