import pytest

from quillgraph.llm.markup import cleaned, render


@pytest.mark.parametrize(
    ("text", "clean", "found"),
    [
        ("<p>One<p>Two &amp; three", "One\n\nTwo & three", ["html"]),
        ("a<!-- x -->b<br>c", "ab\nc", ["html"]),
        ("<ul><li>one<li>two</ul>", "• one\n• two", ["html"]),
        ("<table><tr><td>a<td>b<tr><td>ccc<td>d</table>", "a    b\nccc  d", ["html"]),
        ("<script>x</script>y<span hidden>z</span>", "y", ["html"]),
        ("# Title\ntext **bold** and _soft_", "Title\n\ntext bold and soft", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 22 |", "a  b\n1  22", ["markdown"]),
        ("[t](u.md) ![alt](i.png) x[^1]", "t alt x", ["markdown"]),
        ("head\n=====\nbody", "head\n\nbody", ["markdown"]),
        ("```python\nrow = '<div>' + body\n```", "row = '<div>' + body", ["markdown"]),
        ("[[a|b]] [[Category:x]] ''c''", "b  c", ["wiki"]),
        ("== H ==\n{| class=wikitable\n|-\n| a || 1\n|}", "H\n\na  1", ["wiki"]),
        ("{{lang|x}} __NOTOC__", "x ", ["wiki"]),
        ("\\section{S}\n\\emph{a} $x_1^2$ \\label{q}", "S\n\na x_1^2 ", ["latex"]),
        ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", "• a\n• b", ["latex"]),
        ("{\\bf x} y", "x y", ["latex"]),
    ],
)
def test_constructs(text, clean, found):
    got = render(text)
    assert got[1] == found
    assert [x.rstrip() for x in got[0].split("\n") if x.strip()] == [x.rstrip() for x in clean.split("\n") if x.strip()]


@pytest.mark.parametrize("text", ["1 < 2 > 0; if x<19 then", "R&D at Smith & Co.", "6 * 3 * 2 = 36", "(see *) a [25] (see *)", "file_name_17 and C# or #6", "[sic] [7]", "The desk paid $19 or $22.", "D:\\scans\\new6", "x == y; 'tis", "{a, b}", "a / b ~ 20", "《x》<27%", "", "   "])
def test_ordinary_signs_stay(text):
    assert render(text) == (text, [], [])


def test_blocks_lie_where_they_say():
    clean, _, blocks = render("## Head\n\n- one\n- **two**\n\n```\ncode\n```\n$$x^2$$")
    kinds = {k: clean[s:e] for k, s, e in blocks}
    assert kinds["heading 2"] == "Head" and kinds["code"] == "code" and kinds["formula"] == "x^2" and kinds["item"].startswith("• ")


def test_deep_and_long():
    assert render("<div>" * 5000 + "x")[0].strip() == "x"
    assert len(render("**a** " * 20_000)[0]) == 40_000
    assert render("*" * 5000)[0]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ('<p style="display:none">x</p> visible text', "visible text"),
        ("<noscript>Vis</noscript>A", "A"),
        ("a<template>x</template>b<iframe src=u>c</iframe>d", "abd"),
        ("<div hidden>x<div>y</div></div>z", "z"),
        ("<span style='visibility: hidden'>x</span>z", "z"),
        ("<head><title>T</title><style>b</style><body>shown", "shown"),
        ("<div hidden>never closed, so nothing says where it ends", "never closed, so nothing says where it ends"),
        ("<script>let never closed", "let never closed"),
        ('<p class="never-hidden">a</p><b title="a hidden gem">b</b><i aria-hidden="false">c</i>', "a\n\nbc"),
        ("<p hidden>x<p>y", "y"),
        ("<ol><li>a<li>b<li value=7>c<li>d</ol><ol start=4><li>e</ol><ul><li>f</ul>", "1. a\n2. b\n7. c\n8. d\n\n4. e\n\n• f"),
        ("<table><tr><td>a<table><tr><td>in<td>x</table></td><td>b</tr></table>", "a in x  b"),
        ("\\label{x}seen \\cite{y}too", "seen too"),
    ],
)
def test_what_is_hidden_and_what_stays(text, clean):
    assert render(text)[0].strip() == clean


def test_any_depth_keeps_its_text():
    for n in (30, 400, 3000):
        assert render("<div>" * n + "x" + "</div>" * n + "y")[0].split() == ["x", "y"]
    nested = "x"
    for i in range(60):
        nested = f"[[a|{nested}]]" if i % 2 else f"**{nested}**"
    assert "x" in render(nested)[0]
    assert "x" in render("<table><tr><td>" * 200 + "x")[0] and "x" in render("> " * 500 + "x")[0] and "x" in render("{\\bf " * 3000 + "x")[0]


def test_rows(spark):
    df = spark.createDataFrame([(1, "<b>x</b>", "q"), (2, None, "q"), (3, "", "q")], "id long, body string, clean string")
    rows = {r.id: (r.clean, list(r.markup)) for r in cleaned(df, "id", "body").collect()}
    assert rows == {1: ("x", ["html"]), 2: (None, []), 3: ("", [])}
    assert cleaned(df.limit(0), "id", "body").count() == 0


@pytest.mark.parametrize("text", ["* one\n* two", "x\n  - one\n  - two", "\t+ one", "  * one", "x__NOTOC__", "x___#a__"])
def test_lone_constructs_are_parsed(text):
    from quillgraph.llm.markup import _ANY, parse

    assert parse(text).found and _ANY.search(text) and render(text)[1] == sorted(parse(text).found)
