"""One consistent form for texts that look the same but are stored with different characters."""

from __future__ import annotations

import base64
import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bpe import rank_file
from quillgraph.plans.skew import join_many, join_unique
from quillgraph.session import written

# Letters that print alike. Each entry is a prototype and the letters of other scripts that look like it.
LETTERS = """
A:АΑᎪꓮ B:ВΒᏴꓐ C:СϹᏟꓚ D:Ꭰꓓ E:ЕΕᎬꓰ F:Ϝꓝ G:ԌᏀꓖ H:НΗᎻꓧ I:ІΙӀꓲ J:ЈͿᎫꓙ K:КΚᏦꓗ L:Ꮮꓡ M:МΜᎷꓟ N:Νꓠ O:ОΟՕꓳ P:РΡᏢꓑ Q:Ԛ R:Ꮢꓣ
S:ЅՏᏚꓢ T:ТΤᎢꓔ U:Սꓴ V:ѴᏙꓦ W:ԜᎳꓪ X:ХΧꓫ Y:УΥҮꓬ Z:ΖᏃꓜ
a:аαɑ c:сϲ d:ԁ e:е g:ɡց h:һհ i:іιı j:јϳ l:ӏ n:ո o:оοօ p:рρ q:ԛգ s:ѕ u:υս v:νѵ w:ԝ x:х y:у
ĸ:кκ ᴛ:тτ Г:Γ П:Π Ф:Φ ф:φ
"""
# Characters of the Han script and the kana that look like them.
HAN_KANA = "二ニ 口ロ 八ハ 工エ 力カ 夕タ 卜ト"
# Radicals that compatibility normalization leaves, with the characters that they look like.
RADICALS = """
⺁厂 ⺂乛 ⺃乚 ⺄乙 ⺅亻 ⺆冂 ⺉刂 ⺊卜 ⺋㔾 ⺎兀 ⺏尣 ⺐尢 ⺒巳 ⺓幺 ⺔彑 ⺕彐 ⺖忄 ⺗㣺 ⺘扌 ⺙攵 ⺛旡 ⺝月 ⺞歺 ⺠民 ⺡氵 ⺢氺 ⺣灬 ⺤爫 ⺥爫 ⺦丬 ⺨犭 ⺩王 ⺫罒 ⺬示 ⺭礻
⺯糹 ⺰纟 ⺱罓 ⺲罒 ⺶羊 ⺹耂 ⺺肀 ⺾艹 ⺿艹 ⻁虎 ⻂衤 ⻃覀 ⻄西 ⻅见 ⻆角 ⻈讠 ⻉贝 ⻋车 ⻌辶 ⻍辶 ⻎辶 ⻏阝 ⻐钅 ⻑長 ⻒镸 ⻓长 ⻔门 ⻖阝 ⻘青 ⻙韦 ⻚页 ⻛风 ⻜飞 ⻝食 ⻟飠 ⻠饣 ⻢马 ⻣骨 ⻤鬼
⻥鱼 ⻦鸟 ⻧卤 ⻨麦 ⻩黄 ⻪黾 ⻫斉 ⻬齐 ⻭歯 ⻮齿 ⻯竜 ⻰龙 ⻱龜 ⻲亀
"""
# Characters that show nothing.
IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
# Hyphens of other blocks; dashes of other lengths are visible differences.
HYPHENS = "‐‑﹣－"
#: Compatibility decompositions of these kinds change what is seen, so their characters stay.
VISIBLE = ("<super>", "<sub>", "<circle>", "<fraction>", "<square>", "<vertical>", "<font>")


def script_of(letter: str) -> str:
    """L, C, G, M, R or S for Latin, Cyrillic, Greek, Armenian, Cherokee and Lisu letters, else O."""
    if letter < "Ͱ" or "ᴀ" <= letter <= "ᶿ" or "Ḁ" <= letter <= "ỿ":
        return "L"
    for script, ranges in (("G", "ͰϿἀ῿"), ("C", "Ѐԯ"), ("M", "԰֏"), ("R", "Ꭰᏽꭰꮿ"), ("S", "ꓐꓽ")):
        if any(ranges[i] <= letter <= ranges[i + 1] for i in range(0, len(ranges), 2)):
            return script
    return "O"


def _pairs() -> tuple[dict[str, str], dict[str, list[tuple[str, str]]]]:
    """Look-alike to its prototype, and prototype to all letters that look like it with their scripts."""
    to: dict[str, str] = {}
    forms: dict[str, list[tuple[str, str]]] = {}
    for entry in LETTERS.split():
        prototype, others = entry.split(":")
        forms[prototype] = [(script_of(c), c) for c in prototype + others]
        to |= dict.fromkeys(others, prototype)
    return to, forms


PROTOTYPE, FORMS = _pairs()
_RADICAL = {ord(pair[0]): pair[1] for pair in RADICALS.split()}
_HAS_RADICAL = re.compile("[⺀-⻳]")
_TO_HAN = {pair[1]: pair[0] for pair in HAN_KANA.split()}
_TO_KANA = {a: b for b, a in _TO_HAN.items()}
#: A run of characters that are Han or kana alike, where one of them is kana or stands next to kana.
_HAN_OR_KANA = re.compile("([{0}{1}]+)".format("".join(_TO_HAN), "".join(_TO_KANA)))
_PLAIN_KANA = re.compile("[ァ-ヺーｦ-ﾝ]")
_IGNORE = re.compile(f"[{IGNORABLE}]+")
_LINE_END = re.compile("[\x85\u2028\u2029]")
_SPACE = re.compile("[^\\S\\n]{2,}|[^\\S\\n ]")
_ODD_SPACE = re.compile("[^\\S\\n ]")
_EDGE = re.compile("(?: (?=\\n|$))|(?:(?<=\\n) )|(?:^ )")
_FOREIGN = re.compile(f"[{''.join(PROTOTYPE)}]")
_MARKS = "\u0300-\u036f"


def _class(letters: list[str]) -> str:
    """A character class of ranges."""
    out: list[list[int]] = []
    for c in sorted(map(ord, letters)):
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(re.escape(chr(a)) if a == b else f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


def _alphabets() -> tuple[str, str]:
    """Classes of all letters of the alphabets concerned, and of those that print like a letter of another script.

    Letters with accents are alike if their base is; spaceless scripts are in neither class.
    """
    every = [c for c in map(chr, [*range(0x41, 0x58F), *range(0x13A0, 0x13FE), *range(0x1D00, 0x2000), *range(0xA4D0, 0xA4FE), *range(0xAB70, 0xABC0)]) if c.isalpha() and script_of(c) != "O"]
    alike = [c for c in every if (d := unicodedata.normalize("NFD", c)[0]) in FORMS or d in PROTOTYPE]
    return _class(every), _class(alike)


_EVERY, _ALIKE = _alphabets()
#: Words made of look-alikes only: another script may spell them the same.
_ALIKE_WORD = re.compile(rf"(?<![^\W\d_])(?:[{_ALIKE}][{_MARKS}]*)+(?![^\W\d_])")
#: Words of the alphabets concerned (spaceless scripts are no part of them).
_WORD = re.compile(rf"(?:[{_EVERY}][{_MARKS}]*)+")
_IS_ALIKE = re.compile(rf"(?:[{_ALIKE}][{_MARKS}]*)+")
#: A letter that no other script has, by script: it tells the script of a text, whatever its look-alikes are stored as.
_OWN = {s: re.compile(f"[{_class([c for c in map(chr, [*range(0x41, 0x530), *range(0x1E00, 0x2000)]) if c.isalpha() and script_of(c) == s and not re.match(f'[{_ALIKE}]', c)])}]") for s in "LCG"}
_OTHERS = re.compile("[Ͱ-ԯἀ-῿]")
_HYPHEN = re.compile(f"[{HYPHENS}]")


def _kept() -> frozenset[str]:
    """The characters that compatibility normalization would change to something that looks different."""
    kind = unicodedata.decomposition
    return frozenset(c for c in map(chr, range(0x80, 0x30000)) if kind(c).startswith((*VISIBLE, "<compat> 0020")) or c == "…")


_KEPT = _kept()


def _compatible(text: str) -> str:
    """Compatibility normalization of all but the kept characters."""
    if unicodedata.is_normalized("NFKC", text):
        return text
    if _KEPT.isdisjoint(text):
        return unicodedata.normalize("NFKC", text)
    parts = re.split(f"([{re.escape(''.join(sorted(_KEPT.intersection(text))))}]+)", text)
    parts[::2] = [unicodedata.normalize("NFKC", x) for x in parts[::2]]
    return unicodedata.normalize("NFC", "".join(parts))


#: A share of each prediction that trigrams, bigrams and single letters of a script give.
TRIGRAM, BIGRAM, SINGLE = 0.6, 0.3, 0.09
#: Log-probability of a letter that no model of its script has seen.
UNSEEN = math.log(1e-4)


@lru_cache(4)
def model(path: str | None = None) -> dict[str, dict[str, float]]:
    """Character n-grams of each script, from the words of a public vocabulary (a rank file for many languages).

    Every token whose letters are of one script counts, with a weight that falls with its rank as frequencies do. The
    result has, by script, the weights of n-grams of up to three letters and of their contexts; "^" is a word's start.
    """
    counts: dict[str, dict[str, float]] = {s: {} for s in "LCG"}
    with open(path or rank_file("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        for at, line in enumerate(lines):
            try:
                token = base64.b64decode(line.split()[0]).decode()
            except UnicodeDecodeError:
                continue
            word = token.strip().lower()
            if not word.isalpha() or len(scripts := {script_of(c) for c in word}) > 1 or (script := scripts.pop()) not in counts:
                continue
            letters = ("^" if token[0] == " " else "") + unicodedata.normalize("NFC", word)
            weight, seen = 1.0 / (at + 300), counts[script]
            for n in (1, 2, 3):
                for i in range(len(letters) - n + 1):
                    gram = letters[i : i + n]
                    seen[gram] = seen.get(gram, 0.0) + weight
    for seen in counts.values():
        seen[""] = sum(v for k, v in seen.items() if len(k) == 1)
    return counts


@lru_cache(400_000)
def likelihood(script: str, before: str, letter: str) -> float:
    """Log-probability of a letter after one or two others of its script ("^" is a word's start)."""
    seen = model().get(script)
    if seen is None:
        return math.log(1 / 60)
    get = seen.get
    p = 1e-4 + SINGLE * get(letter, 0.0) / (seen[""] or 1.0)
    if (all_two := get(before[-1:], 0.0)) and before:
        p += BIGRAM * get(before[-1] + letter, 0.0) / all_two
        if len(before) > 1 and (all_three := get(before[-2:], 0.0)):
            p += TRIGRAM * get(before[-2:] + letter, 0.0) / all_three
    return max(UNSEEN, math.log(p))


#: What a change of script within a word costs, and a word in another script than its text, in nats.
SWITCH, ASIDE = 12.0, 6.0
#: The first letter's script where the text has no letter that tells its script.
PRIOR = {"L": 0.0, "C": -0.3, "G": -2.0}
RARE = -9.0
_ORDER = "LCGMRSO"


@lru_cache(200_000)
def decide(word: str, main: str = "") -> str:
    """The likeliest spelling of a word among all that look like it, in a text mainly of script main ("" if unknown).

    The lattice has, at each letter, every letter that prints alike; it depends on the look only, so all words that look
    the same in texts that look the same have the same lattice and the same result. Viterbi takes the path of the best
    sum of n-gram scores of the path's script, a price for each change of script, and a prior for the first one; ties
    go to the earlier script of Latin, Cyrillic, Greek and the others. Scripts that have no own letter in the word, but
    for these three, are left out. A single letter is of the main script, or Latin.
    """
    letters = _LETTER.findall(unicodedata.normalize("NFD", word))
    if len(letters) == 1:
        base = letters[0][0]
        forms = FORMS.get(PROTOTYPE.get(base, base))
        if forms:
            chosen = next((c for s, c in forms if s == main), forms[0][1])
            return unicodedata.normalize("NFC", chosen + letters[0][1:])
    rare = {script_of(x[0]) for x in letters if PROTOTYPE.get(x[0], x[0]) not in FORMS}
    # a state is the script and the last two letters; its value the score and the path
    best: dict[tuple[str, str], tuple[float, str]] = {("", "^"): (0.0, "")}
    for letter in letters:
        base, marks = letter[0], letter[1:]
        forms = FORMS.get(PROTOTYPE.get(base, base))
        options = [x for x in forms if x[0] in PRIOR or x[0] in rare] if forms else [(script_of(base), base)]
        following: dict[tuple[str, str], tuple[float, str]] = {}
        for script, form in options:
            shown = unicodedata.normalize("NFC", form.lower() + marks)
            for (was, before), (score, path) in best.items():
                s = score + likelihood(script, before if was in ("", script) else "", shown)
                if not was:
                    s += (0.0 if script == main else -ASIDE) + (0.0 if script in PRIOR else RARE) if main else PRIOR.get(script, RARE)
                elif was != script:
                    s -= SWITCH
                key = (script, (before + shown)[-2:] if was in ("", script) else shown)
                old = following.get(key)
                if old is None or (s, path) > old:
                    following[key] = (s, path + form + marks)
        best = following
    return unicodedata.normalize("NFC", max(best.items(), key=lambda kv: (kv[1][0], -_ORDER.index(kv[0][0] or "O"), kv[1][1]))[1][1])


_LETTER = re.compile(rf".[{_MARKS}]*", re.DOTALL)


def main_script(text: str) -> str:
    """The script of most letters that no other script has: a property of the look, not of the stored characters."""
    if not _OTHERS.search(text):
        return "L" if _OWN["L"].search(text) else ""
    n, _, script = max((len(own.findall(text)), -_ORDER.index(s), s) for s, own in _OWN.items())
    return script if n else ""


def _words(text: str) -> str:
    foreign = _FOREIGN.search(text)
    if not foreign and not _ALIKE_WORD.search(text):
        return text
    main = main_script(text)
    if not foreign:
        return text if main == "L" else _ALIKE_WORD.sub(lambda m: decide(m.group(), main), text)

    def mixed(m: re.Match) -> str:
        word = m.group()
        return decide(word, main) if _FOREIGN.search(word) or _IS_ALIKE.fullmatch(word) else word

    return _WORD.sub(mixed, text)


def _kana(text: str) -> str:
    """Runs that are Han or kana alike become kana beside other kana, and Han elsewhere."""

    def one(m: re.Match) -> str:
        run, around = m.group(), text[max(0, m.start() - 1) : m.start()] + text[m.end() : m.end() + 1]
        if any("ァ" <= c <= "ー" for c in around):
            return "".join(_TO_KANA.get(c, c) for c in run)
        return "".join(_TO_HAN.get(c, c) for c in run)

    return _HAN_OR_KANA.sub(one, text)


def canonical(text: str | None) -> str | None:
    """The one form of all texts that look like this one; null stays null, a text that shows nothing becomes empty.

    Line ends become LF; characters that show nothing are deleted; compatibility normalization unites widths,
    composition, ligatures, radicals and presentation forms, but not raised, lowered, circled and like signs, which
    look different; runs of spaces within a line become one, spaces at a line's ends none; each word with look-alike
    letters gets its likeliest spelling. Case, accents, dash length and line breaks stay. Applying it twice is
    applying it once.
    """
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if not text.isascii():
        text = _LINE_END.sub("\n", text)
        text = _IGNORE.sub("", _compatible(_HYPHEN.sub("-", _IGNORE.sub("", text))))
        if _HAS_RADICAL.search(text):
            text = text.translate(_RADICAL)
        if _PLAIN_KANA.search(text):
            text = _kana(text)
    if "  " in text or _ODD_SPACE.search(text):
        text = _SPACE.sub(" ", text)
    if " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " ":
        text = _EDGE.sub("", text)
    return _words(text)


def consistent(df: DataFrame, key: str, text: str, table: str | None = None) -> DataFrame:
    """key, text and same_look (its canonical form) of every row; no shuffle, whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [canonical(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(forms, pa.string())], ["key", "stored", "same_look"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, stored string, same_look string").withColumnsRenamed({"key": key, "stored": text})


def _looks(df: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, form) and forms (form, look, n, n_look): form stands for a stored text within its look.

    Only digests travel: 128 bits of the stored text and of its canonical form. Repeated deliveries count once. n is how
    many rows have the form, n_look how many have the look; both counts are partial on the map side.
    """
    digest = lambda c: F.unhex(F.md5(F.col(c)))
    known = consistent(df.filter(F.col(text).isNotNull()), key, text)
    rows = known.select(F.col(key).cast("bigint").alias("id"), F.concat(digest("same_look"), digest(text)).alias("form")).distinct()
    rows = written(rows, "looks")
    forms = rows.groupBy("form").agg(F.count(F.lit(1)).alias("n")).withColumn("look", F.substring("form", 1, 16))
    sums = forms.groupBy("look").agg(F.sum("n").alias("n_look"))
    return rows, written(join_unique(written(forms, "forms"), sums, "look", "inner"), "forms")


def look_classes(df: DataFrame, key: str, text: str, table: str) -> DataFrame:
    """table_name, row_id, class_id, n_links: every id with the class of its look and how many rows look so but are stored otherwise.

    This is the result that stays in proportion to the data. An id delivered with two texts has a row for each; null texts have none.
    """
    rows, forms = _looks(df, key, text)
    met = join_unique(rows, forms.select("form", F.lower(F.hex("look")).alias("class_id"), (F.col("n_look") - F.col("n")).alias("n_links")), "form", "inner")
    return met.select(F.lit(table).alias("table_name"), F.col("id").alias("row_id"), "class_id", "n_links")


def look_pairs(df: DataFrame, key: str, text: str, table: str) -> DataFrame:
    """table_name, id_a, id_b: ids (smaller first) whose texts differ as stored but look the same.

    Forms of one look are paired first, then the ids of the two forms; rows of one form, however many, are never paired
    with each other. Looks and forms that very many rows share are spread over tasks (see join_many).
    """
    rows, forms = _looks(df, key, text)
    mixed = written(forms.filter("n_look > n").select("look", "form"), "mixed")
    some = written(join_unique(rows, mixed.select("form", F.lit(True).alias("mixed")), "form", "inner").select("id", "form"), "mixed-rows")
    two = join_many(mixed.withColumnRenamed("form", "form_a"), mixed.withColumnRenamed("form", "form_b"), "look").filter("form_a < form_b").select("form_a", "form_b")
    first = join_many(some.select(F.col("id").alias("a"), F.col("form").alias("form_a")), written(two, "two-forms"), "form_a").select("a", "form_b")
    met = join_many(written(first, "first-ids"), some.select(F.col("id").alias("b"), F.col("form").alias("form_b")), "form_b").filter("a <> b")
    return met.select(F.lit(table).alias("table_name"), F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
