from quillgraph.llm import personal
from quillgraph.llm.personal import candidates, find, mask

GIVEN = frozenset({"margaret", "gideon", "andre"})


def test_forms():
    text = "Write to a.b@x.example or c [at] y [dot] test, 31 Weir Court, Apt 2, Fensworth, 00306. @shelf_cat17 liked it. Read on 2024-05-15."
    got = [(s, text[a:b]) for s, a, b, *_ in candidates(text, GIVEN)]
    assert got == [("email", "a.b@x.example"), ("email", "c [at] y [dot] test"), ("address", "31 Weir Court, Apt 2, Fensworth, 00306")]


def test_addresses_of_many_countries():
    for text in ["Quellgasse 114, 00313 Hohenquell", "51, rue des Glycinelles, 00510 Valcombe", "C/ Almendralejo Alto 96, 2.º B, 00546 Villaserna", "东岚省鹤汀市莲渡路228号4单元101室", "霧見市桜ヶ原8丁目15番11号", "Flat 13, 152 Larkmoor Lane, Coldlatch", "52 bis avenue du Vieux-Lavoir, 00291 Morvaine"]:
        spans = [text[a:b] for s, a, b, *_ in candidates(text, GIVEN) if s == "address"]
        assert spans == [text], text
    assert not candidates("He lived on Tannery Row once. 竹里巷的旧事今已无人知晓。", GIVEN)


def found(spark, texts, people=()):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    entities = spark.createDataFrame([(i, n, "person") for i, n in enumerate(people)] or [(0, None, None)], "id long, canonical_name string, entity_type string")
    forms = spark.createDataFrame([("Greta", "Margaret"), ("Gid", "Gideon")], "form string, formal string")
    return docs, find(docs, entities, forms)


def test_contexts_find_what_forms_do_not(spark):
    texts = [f"Mrs Margaret Hexbury wrote card {i}." for i in range(2)]
    texts += [f"Margaret Hexbury phoned from +44 7700 90016{i} about it." for i in range(4)]
    texts += ["Q. Hexbury phoned from 555-0194 about it.", "The archive keeps 004162715 leaves.", "Gideon Publicname phoned from 020 7946 0577 about it.", None, ""]
    docs, df = found(spark, texts, ["Paul Publicname", "Publicname, Ann"])
    got = {(r.doc_id, r.kind, texts[r.doc_id][r.start_pos : r.end_pos]) for r in df.collect()}
    assert {(6, "name", "Q. Hexbury"), (6, "phone", "555-0194"), (0, "name", "Margaret Hexbury"), (2, "name", "Margaret Hexbury"), (8, "phone", "020 7946 0577")} <= got
    assert not any(d == 7 or d == 8 and k == "name" for d, k, _ in got)
    masked = {r.doc_id: r.masked for r in mask(docs, df).collect()}
    assert masked[6] == "[NAME] phoned from [PHONE] about it." and masked[7] == texts[7] and masked[9] is None and masked[10] == ""


def test_chinese_names_by_contexts(spark):
    texts = [f"Mrs Margaret Hexbury wrote card {i}." for i in range(2)] + [f"读者Margaret Hexbury的身份证号为99010319790522012{i}。" for i in range(4)]
    texts += ["读者郭珠湖的身份证号为990103197905220127。", "卢深今与罗词锦未曾谋面。"]
    # a context of names is one far from any number, address or honour as well
    texts += [f"昨日把书借给Margaret Hexbury，很久以后才还，{'旧事' * 60}。" for _ in range(4)] + [f"昨日把书借给王珠湖，很久以后才还，{'旧事' * 60}。"]
    _, df = found(spark, texts)
    got = {(r.doc_id, texts[r.doc_id][r.start_pos : r.end_pos]) for r in df.filter("kind = 'name'").collect()}
    assert got == {(i, "Margaret Hexbury") for i in (0, 1, 2, 3, 4, 5, 8, 9, 10, 11)} | {(6, "郭珠湖"), (12, "王珠湖")}


def test_patterns_accept_in_rounds_and_seeds_are_few(spark):
    texts = [f"Mail: q{i}@x.example now." for i in range(3)] + [f"Ask r{i}@y.example or z." for i in range(20)] + [f"Ask s{i} (at) w (dot) example or z." for i in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    none = spark.createDataFrame([], "id long, canonical_name string, entity_type string")
    df = personal.judged(docs, none, spark.createDataFrame([], "form string, formal string"))
    rows = {(r.doc_id, r.round, r.seed) for r in df.collect()}
    assert {(i, 1, "email") for i in range(3)} <= rows and {d for d, _, _ in rows} == set(range(26))
    assert all(seed == "" and at in (1, 2) for d, at, seed in rows if d >= 3)


def test_nothing(spark):
    _, df = found(spark, [None])
    assert df.count() == 0


def test_plain_key():
    assert personal.plain("Renée") == "renee"
