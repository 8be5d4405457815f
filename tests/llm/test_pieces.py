from quillgraph.llm import pieces
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.pieces import cut, level, split


def book(rng, n):
    out = []
    for _ in range(n):
        out.append(" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(5, 14))).capitalize() + ".")
    return "\n\n".join(" ".join(out[i : i + 5]) for i in range(0, len(out), 5))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n\r。", max_size=900), st.integers(0, 30))
def test_pieces_cover_and_keep_the_limit(s, overlap):
    pieces = cut(s, 100, overlap)
    assert not s or pieces[0][0] == 0 and pieces[-1][1] == len(s)
    for (a, b, _), (c, d, _) in zip(pieces, pieces[1:], strict=False):
        assert b - a <= 100 and a < c <= b < d and b - c <= overlap * 1.5
    assert all(b - a <= 100 for a, b, _ in pieces)


def test_edits_alter_only_their_neighbourhood():
    text = book(random.Random(1), 400)
    at = len(text) // 2
    before = {text[a:b] for a, b, _ in cut(text)}
    after = {t[a:b] for t in (text[:at] + "inserted words " + text[at:],) for a, b, _ in cut(t)}
    assert len(before - after) <= 4 and len(before) > 15


def test_levels():
    assert level("a" * 1000 + "\n\n" + "b" * 1000) == "paragraph"
    assert level("a" * 1000 + "\n" + "b" * 1000) == "line"
    assert level("a" * 1000 + "\r\n\u200b \r\n" + "b" * 1000) == "paragraph"
    assert level("a" * 750 + "\r\n" + "b" * 749) == "paragraph" and level("a" * 750 + "\r\n" + "b" * 750) == "line"
    assert level("a" * 1501) == "inner"


def test_rows(spark):
    df = spark.createDataFrame([(1, "x" * 1500, "p", 1), (2, "y" * 4000, None, None), (3, None, "p", 1), (4, "", "p", 1)], "id long, body string, section_path string, piece int")
    rows = split(df, "id", "body", keep=("section_path",)).collect()
    assert {r.id for r in rows} == {2} and all(len(r.piece_text) <= 1500 and r.level == "inner" and r.section_path is None for r in rows)
    assert split(df.limit(0), "id", "body").count() == 0
    with pytest.raises(ValueError):
        cut("x" * 200, 100, 50)


def test_no_shown_character_is_parted():
    import regex

    for unit in ("e\u0301", "👩\u200d👩\u200d👧", "🇩🇪", "ก\u0e33", "\u1112\u1161\u11ab", "👍🏽", "x\u0301\u0302\u0303", "\r\n"):
        text = unit * 3000
        ends = {0} | {m.end() for m in regex.finditer(r"\X", text)}
        for start, end, _ in pieces.cut(text):
            assert start in ends and end in ends, unit


def test_overlaps_are_as_specified(spark):
    text = " ".join(f"word{i} follows" for i in range(4000))
    rows = pieces.split(spark.createDataFrame([(1, text)], "id long, body string"), "id", "body").orderBy("piece").collect()
    assert all(125 <= r.overlap <= 175 for r in rows[1:]) and rows[0].overlap == 0
    assert all(e - s <= 1500 for s, e, _ in pieces.cut("a" * 50_000)) and {a[1] - b[0] for a, b in zip(pieces.cut("a" * 50_000), pieces.cut("a" * 50_000)[1:])} == {150}


def test_wrong_pieces_are_an_error():
    import pytest

    for bad in ([], [(0, 5, 0)], [(0, 3, 0), (4, 10, 0)], [(0, 10, 0), (5, 9, 0)]):
        with pytest.raises(ValueError):
            pieces.checked("0123456789", bad, 10)
