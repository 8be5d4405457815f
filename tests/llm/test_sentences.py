import pytest

from quillgraph.llm.sentences import lattice, sentences, split


@pytest.mark.parametrize(
    "parts",
    [
        ["Prof. K. Smith et al. dated it to c. 1469.", "See vol. 2, pp. 7–25, for it.", "Is it rare?!"],
        ["She noted “It is. It was.” and closed the book.", "“Leave it alone.”", "“Is it late?” asked Tom at the gate."],
        ["(The lineage is bright, e.g. in sec. 22.24.)", "By 8 p.m. the text had reached St. Mary Hall.", "Nothing explains it... and yet it stays."],
        ["„Wo ist das Buch?“, fragte Ute leise.", "Am 25. Mai 1641 lag es dort.", "Es spiegelt z. B. das Tagebuch von Dr. Maier.", "Prof. L. Ott liest usw. ohne Eile."],
        ["« Où est-il ? » demanda Luc à la porte.", "Le motif, c.-à-d. la copie, plaît.", "Quel débat !"],
        ["—¿Dónde está? —preguntó Ana en voz baja.", "La Dra. Ruiz lee, etc., sin prisa.", "En 1858 tenía 24 páginas, véase pág. 20."],
        ["«Где список?» — спросил Иван тихо.", "В 1800 г. список насчитывал 28 стр. и был забыт.", "Доля упала до 42,36 %, т. е. почти до нуля."],
        ["डॉ. Rao ने पाठ पढ़ा।", "क्या यह नया है?", "1771 में भाग 94.2 था।"],
        ["بلغت النسبة 53.22 في عام 1851.", "ما أجمل هذا!", "هل يشرح أحد هذا؟"],
        ["누가 이 원고를 읽었는가?", "“이 목록이 맞는가?”라고 민수가 물었다.", "“덮어라.”"],
        ["เขาอธิบายบทความเก่ามาแล้ว8ครั้ง", "บันทึกนี้ใหม่หรือไม่", "คุณSmithทบทวนหนังสือ"],
    ],
)
def test_spaced(parts):
    text = " ".join(parts)
    assert [text[s:e] for s, e in split(text)] == parts


@pytest.mark.parametrize(
    "parts",
    [
        ["他写道“譬喻不可废。其义平实。”便合上了书。", "“先读游记，再论山水。”", "“何以如此？”唐涛在门前问道。", "真的如此吗？！", "版本反驳家谱……读者自当分辨。", "（见卷19。）", "据Dr. Hess所考，此篇成于1453年前后。"],
        ["「この写本は静かなものか。」と毕は尋ねた。", "「序文を閉じよ。」", "1499年の注釈は約90.1倍に増えた。", "誰が受け継ぐのか？"],
    ],
)
def test_spaceless(parts):
    text = "".join(parts)
    assert [text[s:e] for s, e in split(text)] == parts


def test_edges():
    assert split(None) == [] and split("") == [] and split(" \n ") == []
    assert [(s, e) for s, e in split("  no end")] == [(2, 8)]
    assert len(split("A sentence. " * 20_000)) == 20_000
    assert len(split("(" * 3000 + "a. B")) >= 1


def test_lattice_prefers_known_words():
    assert [w for w, _ in lattice("บันทึกนี้ใหม่หรือไม่")] == ["บันทึก", "นี้", "ใหม่", "หรือไม่"]
    assert "".join(w for w, _ in lattice("xyzบันทึก12")) == "xyzบันทึก12"


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 0), (2, None, 0)], "id long, body string, sentence int")
    assert [(r.id, r.start_pos, r.end_pos) for r in sentences(df, "id", "body").collect()] == [(1, 0, 4), (1, 5, 9)]
    assert sentences(df.limit(0), "id", "body").count() == 0


def test_terminators_of_many_scripts():
    from quillgraph.llm.sentences import split

    for text in ("ខ្ញុំទៅផ្សារ។ គាត់នៅផ្ទះ។", "သူသွားသည်။ ကျွန်တော်နေသည်။", "ሰላም ነው። ደህና ነው።", "Ես գնացի։ Նա մնաց։", "བོད་ཡིག། སྐད་ཡིག།"):
        assert len(split(text)) == 2, text


def test_long_runs_decide_like_short_ones():
    from quillgraph.llm.sentences import split

    long = "“好。”" + "他" * 200 + "说。"
    assert len(split(long)) == len(split("“好。”他说。")) == 1
    word = "x" * 100
    assert len(split(f"He saw {word}etc. Then he left.")) == len(split("He saw betc. Then he left.")) == 2
