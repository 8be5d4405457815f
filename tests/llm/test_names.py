import itertools
import random

from quillgraph.llm import names
from quillgraph.llm.names import Trie, bound, classes, components, distance, link, neighbours, pairs, years_of

ENTITY = "id long, canonical_name string, entity_type string, aliases_json string, description string, source string"
FORMS = [("Greta", "Margaret"), ("Peggy", "Margaret"), ("Hans", "Johannes")]


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_like_plain_distance():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 8))) for _ in range(200)})
    trie = Trie()
    for w in words:
        trie.add(w)
    for q in words[:40]:
        for k in (0, 1, 2, 3):
            assert dict(trie.near(q, k)) == {w: lev(q, w) for w in words if lev(q, w) <= k}


def test_join_like_all_pairs(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(5, 13))) for _ in range(40)]
    words = set(base)
    for w in base:
        for _ in range(4):
            s = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(s))
                s[i : i + 1] = rng.choice([[], [rng.choice("abcdefgh")], [s[i], rng.choice("abcdefgh")]]) or []
                s = s or ["a"]
            words.add("".join(s))
    words = sorted(w for w in words if len(w) >= 5)
    got = {(r.word, r.other) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    wanted = {(a, b) for a, b in itertools.permutations(words, 2) if lev(a, b) <= min(bound(len(a)), bound(len(b)))}
    assert got == wanted


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], ENTITY)
    out = pairs(link(df, spark.createDataFrame(FORMS, "form string, formal string")))
    return {(r.id_a, r.id_b) for r in out.collect()}


def test_persons(spark):
    life = "thinker, 1700–1760"
    rows = [
        (1, "Margaret Danamobebol", "person", None, life), (2, "Greta Daenamobebol", "person.author", "null", life), (3, "Danamobebol Margaret", "PERSON", "[]", None), (4, "M. Danamobebol", "person", "", life),
        (5, "Margaret Danamobebol", "person", "[]", "thinker, 1800–1870"), (6, "Cornelius Yufezolonort, PhD", "person", None, None), (7, "Yufezolonort, Cornelius", "person", None, None), (8, None, "person", None, None), (9, "", "person", None, None),
    ]
    got = groups(spark, rows)
    assert {(1, 2), (1, 4), (2, 4), (6, 7)} <= got and not any(5 in p or 8 in p or 9 in p for p in got)


def test_works_and_chinese(spark):
    rows = [
        (1, "The Mirror of Rotimapihol", "work", None, "1849; book"), (2, "Mirror of Rotimapihol, The", "work", None, None), (3, "the myrror of rotimapihol", "work", None, "book dated 1849"), (4, "A Lantern for Rotimapihol", "work", None, "1849; book"),
        (5, "静煌录", "work", None, "1876"), (6, "《静煌錄》", "work", None, None), (7, "尹素利", "person", None, "（1500—1560）"), (8, "尹·素利先生", "person", None, None), (9, "素利子", "person", '["尹素利"]', "1500～1560"), (10, "尹素丽", "person", None, "1400—1450"),
        (11, "Academy of Ralaralosin", "concept", None, "1706"), (12, "Ralaralosin Academy", "concept", None, "1706"),
    ]
    got = groups(spark, rows)
    assert got == {(1, 2), (1, 3), (2, 3), (5, 6), (7, 8), (7, 9), (8, 9), (11, 12)}


def test_copies_and_empty(spark):
    many = [(i, "Same Longfamilyname", "person", None, "1500–1560") for i in range(30)]
    assert len(groups(spark, many)) == 435
    assert groups(spark, many + many) == groups(spark, many)
    assert groups(spark, []) == set()


def test_small_helpers():
    assert distance("abcd", "abdc") == 1 and distance("", "ab") == 2
    assert years_of("lived 1722 to 1809; thinker") == "1722-1809" and years_of(None) == ""
    assert names.aliases('"a"') == ["a"] and names.aliases("a;b") == ["a", "b"] and names.aliases("null") == [] and names.aliases(None) == []


def test_namesakes_are_told_apart(spark):
    rows = [(1, "Quentin Bimilasenal", "person", None, "1752-1789"), (2, "Quentin Bimilasenal the Younger", "person", None, None), (3, "Bimilasenal, Quentin", "person", None, None)]
    assert groups(spark, rows) == {(1, 3)}


def test_aliases_without_years(spark):
    rows = [
        (1, "坤涛先生", "person", '["卢坤涛"]', None), (2, "卢坤涛", "person", None, "1500—1560"), (3, "卢坤涛", "person", None, "1500—1560"),
        (4, "Silver Ox", "person", '["Quentin Bimilasenal"]', ""), (5, "Quentin Bimilasenal", "person", None, "1752-1789"),
        (6, "石樵先生", "person", '["尹素利"]', "1600—1650"), (7, "尹素利", "person", None, None),
        # an alias of two namesakes tells nothing, nor does one of another's years
        (8, "月泉先生", "person", '["常跃荷"]', None), (9, "常跃荷", "person", None, "1400—1450"), (10, "常跃荷", "person", None, "1700—1750"),
        (11, "松坡先生", "person", '["卢坤涛"]', "1800—1850"), (12, "Silver Ox", "work", '["Quentin Bimilasenal"]', None),
        # one name without years for two aliases of different years
        (13, "Golden Hind", "person", '["Aurelia Vosterlanik"]', None), (14, "Golden Hind", "person", '["Cornelius Yufezolonort"]', None),
        (15, "Aurelia Vosterlanik", "person", None, "1500-1550"), (16, "Cornelius Yufezolonort", "person", None, "1800-1850"),
    ]
    assert groups(spark, rows) == {(1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (13, 14)}


def test_chains_of_any_length_are_one_group(spark):
    rng = random.Random(3)
    for n in (100, 1000):
        ids = rng.sample(range(10**9), n)
        edges = list(itertools.pairwise(ids)) + [(-1, -2), (-5, -5)]
        rng.shuffle(edges)
        out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
        assert out == dict.fromkeys(ids, min(ids)) | {-1: -2, -2: -2}
    star = spark.range(1, 30_000).selectExpr("id AS a", "CAST(0 AS long) AS b")
    assert components(star).filter("root = 0").count() == 30_000
    assert components(star.limit(0)).count() == 0


def test_classes_count_links(spark):
    groups = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4)], "id long, group long")
    assert {(r.id, r.group, r.n_links) for r in classes(groups).collect()} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 4, 0)}


def test_a_link_does_not_depend_on_the_table(spark):
    two = [(1, "Chronicle of Rotimapihol", "work", None, None), (2, "Chronicle of Rotimapihql", "work", None, None)]
    more = [(100 + i, f"Chronicle of {''.join(random.Random(i).choices('abcdefghij', k=11))}", "work", None, None) for i in range(400)]
    assert (1, 2) in groups(spark, two) and (1, 2) in groups(spark, two + more)


def test_persons_of_many_names(spark):
    life = "thinker, 1700–1760"
    rows = [
        (1, "Anna Margaret Cecily Dorothea Danamobebol", "person", None, life), (2, "Danamobebol, Dorothea Cecily Margaret Anna", "person", None, None),
        (3, "Peggy Ysolde Franziska Henrike Wilhelmina Daenamobebol", "person", None, life), (4, "C. Danamobebol", "person", None, life),
        (5, "Bruno Gustav Jasper Kilian Oskar Danamobebol", "person", None, "thinker, 1800–1870"),
        (6, "Q. R. S. T. U. Yufezolonort", "person", None, None), (7, "Tobias Yufezolonort", "person", None, None),
    ]
    assert groups(spark, rows) == {*itertools.combinations((1, 2, 3, 4), 2), (6, 7)}


def test_other_tokens_like_every_order():
    rng = random.Random(4)
    formal = {"greta": frozenset({"margaret"}), "peggy": frozenset({"margaret"})}
    some = ["greta", "peggy", "margaret", "margarit", "m.", "g.", "dan.", "daniel", "danlel", "hugo", "otto", "younger"]
    for _ in range(3000):
        a, b = ([rng.choice(some) for _ in range(rng.randrange(1, 6))] for _ in range(2))
        sure = rng.random() < 0.5
        long_a, long_b = ([t for t in x if len(t.rstrip(".")) > 1] for x in (a, b))
        first = itertools.product(long_a, long_b) if long_a and long_b else ((p[0], q[0]) for p in itertools.permutations(a) for q in itertools.permutations(b))
        wanted = ("younger" in a) == ("younger" in b) and any(names.given_match([x], [y], formal, sure) for x, y in first)
        assert names.same_name(" ".join([*a, "vosterlanik"]), " ".join(["vosterlanik", *b]), "vosterlanik", "vosterlanik", "person", sure, formal) == wanted
    # thousands of other tokens end as well
    a, b = ([f"{c}{i}" for i in range(3000)] for c in "ab")
    assert names.same_name(" ".join([*a, "x", "same"]), " ".join([*b, "x", "same"]), "x", "x", "person", False, {})


def test_long_chinese_given_names(spark):
    life = "1500—1560"
    rows = [(1, "欧阳素利明远方", "person", None, life), (2, "素利明远方", "person", None, life), (3, "素利明远", "person", None, "1600—1650"), (4, "尹素利明远香", "person", None, "1600—1650")]
    assert groups(spark, rows) == {(1, 2)}
