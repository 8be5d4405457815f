import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm.lookalike import LETTERS, PROTOTYPE, RADICALS, canonical, decide, look_classes, look_pairs, script_of


def test_equal_looks_meet():
    pairs = [
        ("Cоmpass", "Compass"), ("Ａｂｃ", "Abc"), ("Ange\u0301lique", "Angélique"), ("ﬁn", "fin"), ("a\u00a0b", "a b"), ("a  b \n", "a b\n"), ("x\r\ny", "x\ny"), ("so\u00adft", "soft"), ("⾔", "言"), ("不", "\uf967"), ("a‑b", "a-b"),
        ("\u1112\u1161\u11ab", "한"), ("ре\u0301", "p\u00e9"), ("ё", "ë"), ("Ⅳ", "IV"), ("，", ","),
    ]
    for a, b in pairs:
        assert canonical(a) == canonical(b), (a, b)


def test_visible_differences_stay():
    for a, b in [("x²", "x2"), ("é", "e"), ("a–b", "a-b"), ("A", "a"), ("a\nb", "a b"), ("①", "1"), ("ab", "a b"), ("…", "...")]:
        assert canonical(a) != canonical(b), (a, b)


def test_words_get_one_script():
    assert decide("ѕсhооl") == "school" and decide("рассказ") == "рассказ"
    assert canonical("bοοk") == "book" and canonical("coca") == "coca" and canonical("ТОРТ") == "ТОРТ" and canonical("Нора") == "Нора"
    assert canonical("Что? TOPT, Hopa, a o") == "Что? ТОРТ, Нора, а о" and canonical("Here lie ТОРТ and Нора, а о") == "Here lie TOPT and Hopa, a o"
    assert canonical("Ѕtudу оf раgеs") == "Study of pages"


def test_nothing_and_empty():
    assert canonical(None) is None and canonical("") == "" and canonical("\u200b \u2060") == ""


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8"), max_size=40))
def test_twice_is_once(s):
    once = canonical(s)
    assert canonical(once) == once


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aceopxysijABCEHKMNOPTXYZ thrld", max_size=20), st.integers(0, 2**20))
def test_swapping_lookalikes_changes_nothing(s, bits):
    back = {}
    for alike, latin in PROTOTYPE.items():
        back.setdefault(latin, alike)
    other = "".join(back.get(c, c) if bits >> (i % 20) & 1 else c for i, c in enumerate(s))
    assert canonical(s) == canonical(other) and unicodedata.is_normalized("NFC", canonical(s))


def test_pairs(spark):
    rows = [(1, "Compass", "x"), (2, "Cоmpass", "x"), (3, "Compass", "x"), (2, "Cоmpass", "y"), (4, None, "x"), (5, "", "x"), (6, " ", "x"), (7, "other" * 40_000, "x")]
    df = spark.createDataFrame(rows, "id long, name string, stored string")
    assert {(r.id_a, r.id_b) for r in look_pairs(df, "id", "name", "t").collect()} == {(1, 2), (2, 3), (5, 6)}
    assert look_pairs(df.limit(0), "id", "name", "t").count() == 0


def test_hot_equal_group_makes_no_pairs(spark):
    df = spark.range(20_000).selectExpr("id", "'same' AS name")
    assert look_pairs(df, "id", "name", "t").count() == 0


def test_table_is_in_line():
    assert [PROTOTYPE[c] for c in "οрһαρк"] == ["o", "p", "h", "a", "p", "ĸ"]
    kinds = {"L": "LATIN", "C": "CYRILLIC", "G": "GREEK", "M": "ARMENIAN", "R": "CHEROKEE", "S": "LISU"}
    for entry in LETTERS.split():
        prototype, others = entry.split(":")
        for c in others:
            assert c.isupper() == prototype.isupper() or script_of(c) in "S", entry
            assert unicodedata.name(c).startswith(kinds[script_of(c)]) and len(unicodedata.normalize("NFKC", c)) == 1
    # letters of one name in two scripts stand in one entry
    named = {"A": "ALPHA", "B": "BETA", "E": "EPSILON", "H": "ETA", "I": "IOTA", "K": "KAPPA", "M": "MU", "N": "NU", "O": "OMICRON", "P": "RHO", "T": "TAU", "X": "CHI", "Y": "UPSILON", "Z": "ZETA"}
    for latin, greek in named.items():
        assert PROTOTYPE[unicodedata.lookup(f"GREEK CAPITAL LETTER {greek}")] == latin
    for latin, greek in {"a": "ALPHA", "o": "OMICRON", "p": "RHO", "i": "IOTA", "v": "NU", "u": "UPSILON"}.items():
        assert PROTOTYPE[unicodedata.lookup(f"GREEK SMALL LETTER {greek}")] == latin
    for latin, name in {"a": "A", "e": "IE", "o": "O", "p": "ER", "c": "ES", "x": "HA", "y": "U", "s": "DZE", "i": "BYELORUSSIAN-UKRAINIAN I", "j": "JE", "h": "SHHA"}.items():
        assert PROTOTYPE[unicodedata.lookup(f"CYRILLIC SMALL LETTER {name}")] == latin
    assert all(len(pair) == 2 and "⺀" <= pair[0] <= "⻳" for pair in RADICALS.split())


def test_radicals_kana_and_other_alphabets():
    for a, b in [("⻄门", "西门"), ("⻘山", "青山"), ("ニ月", "二月"), ("人ロ", "人口"), ("口コミ", "ロコミ"), ("ɡɑme", "game"), ("Ꭺlpha", "Alpha"), ("ꓮlpha", "Alpha"), ("Օld", "Old"), ("кот", "κот")]:
        assert canonical(a) == canonical(b), (a, b)
    assert canonical("データ") == "データ" and canonical("二月の人口") == "二月の人口"


def test_classes(spark):
    rows = [(1, "Compass"), (2, "Cоmpass"), (3, "Compass"), (4, "Lantern"), (5, None), (1, "Compass")]
    out = look_classes(spark.createDataFrame(rows, "id long, name string"), "id", "name", "t").collect()
    assert {(r.row_id, r.n_links) for r in out} == {(1, 1), (2, 2), (3, 1), (4, 0)} and len(out) == 4
    assert len({r.class_id for r in out if r.row_id < 4}) == 1


def test_hot_look_with_few_variants(spark):
    df = spark.range(12_000).selectExpr("id", "CASE WHEN id % 4000 = 7 THEN 'sаme' ELSE 'same' END AS name")
    assert look_pairs(df, "id", "name", "t").count() == 3 * 11_997
