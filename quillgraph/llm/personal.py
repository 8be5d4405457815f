"""Personal information in free text: seeds, contexts learned from them, and mentions that the contexts find."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.plans.skew import join_unique
from quillgraph.session import written

# Frequent family names of one and two Chinese characters.
SURNAMES = frozenset("王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文")
SURNAMES2 = frozenset("司徒 上官 慕容 欧阳 司马 诸葛 夏侯 皇甫 尉迟 公孙 令狐 宇文 长孙 东方 端木 南宫".split())
# Words that label a number, and forms of address that name a person.
ID_LABELS = ("social security", "insurance number", "insurance no", "national insurance", "steuer-id", "steuernummer", "sécurité sociale", "dni", "nie", "passport", "身份证", "证件", "個人番号", "マイナンバー", "ausweis", "tax id", "identity")
PHONE_LABELS = ("phone", "call", "tel", "mobile", "fax", "号码", "电话", "手机", "連絡先", "llame", "joindre", "téléphone", "teléfono", "anruf", "rufen")
EMAIL_LABELS = ("mail", "email", "e-mail", "correo", "courriel", "邮箱", "邮件", "メール")
ADDRESS_LABELS = ("address", "adresse", "dirección", "住址", "地址", "住所", "lives at", "moved to", "wohnt in", "habite")
TITLES = ("mr", "mrs", "ms", "miss", "herr", "frau", "mme", "mlle", "m", "sr", "sra", "srta", "don", "doña", "signed", "dr")

_EMAIL = re.compile(r"[A-Za-z0-9À-ÿ][\w.+-]*(?:@|＠| ?[(\[](?:at|AT)[)\]] ?| (?:at|AT) (?=[\w-]+ (?:dot|DOT) ))(?:[A-Za-z0-9-]+(?:\.| ?[(\[](?:dot|DOT)[)\]] ?| (?:dot|DOT) ))+[A-Za-z]{2,}", re.A)
_LETTERED = re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}[ -]?\d{2}[ -]?\d{2}[ -]?\d{2}[ -]?[A-D FMPZ]|\d{8}[ -]?[A-Z]|[XYZ][ -]?\d{7}[ -]?[A-Z]|\d{6}[ -]?\d{8}[ -]?\d{3}[XxＸｘ])(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?<![A-Za-z0-9_@.,/+-])(?:\+|[(（](?=\+?\d))?\d(?:[\d]|[   .\-/](?=[\d(（])|[   ]?[)）][   \-/]?(?=\d)|[   ]?[(（](?=\d{1,4}[)）]))*\d(?![\d]|[.,]\d|[A-Za-z_@])")
#: What a text must have for the rules of e-mail addresses and numbers to find anything.
_AT = re.compile(r"[@＠]|[(\[](?:at|AT)[)\]]| (?:at|AT) (?=[\w-]+ (?:dot|DOT) )")
_LOCAL = re.compile(r"[A-Za-z0-9À-ÿ][\w.+-]* ?$", re.A)
_LETTER_END = re.compile(r"\d[ -]?[A-ZxＸｘ](?![A-Za-z0-9])")
_DIGITS = re.compile(r"\d(?:[  \u2009.\-/()（）]{0,3}\d){6}")
_DATE = re.compile(r"(?:19|20)\d{2}[-./]\d{1,2}[-./]\d{1,2}|\d{1,2}[-./]\d{1,2}[-./](?:19|20)\d{2}")
_WIDE = re.compile("[０-９＋－（）]")
_TO_ASCII = {ord(a): b for a, b in zip("０１２３４５６７８９＋－（）", "0123456789+-()", strict=True)}
_L, _C = "A-Za-zÀ-ÖØ-öø-ɏ", "A-ZÀ-ÖØ-Þ"
#: What may not stand right before a name; rules that begin with a capital are much faster without looking behind.
_JOINED = re.compile(rf"[{_L}0-9.'’-]")
_GIVEN = re.compile(rf"[{_C}][{_L}]+(?= [{_C}])")
_GIVEN_LAST = re.compile(rf", ([{_C}][{_L}]+)")
_FAMILY = rf"[{_C}][{_L}]+(?:['’][{_C}][{_L}]+)?(?:-[{_C}][{_L}]+)?"
_EDGE = rf"(?![{_L}0-9’'])"
_AFTER_GIVEN = re.compile(rf"((?: (?:[{_C}]\.)+)?) ({_FAMILY}){_EDGE}")
_AFTER_SMALL = re.compile(rf"((?: [a-zà-ÿ]\.)?) ([a-zà-ɏ]{{3,}}(?:-[a-zà-ɏ]{{3,}})?){_EDGE}")
_BEFORE_GIVEN = re.compile(rf"(?<![{_L}0-9.’'-])({_FAMILY}), $")
_BEFORE_SMALL = re.compile(rf"(?<![{_L}0-9])([a-zà-ɏ]{{4,}}(?:-[a-zà-ɏ]{{3,}})?), $")
_GIVEN_WORD = re.compile(".+")
_MORE_INITIALS = re.compile(rf"(?: (?:[{_C}]\.)+)?(?![{_L}0-9])")
_INITIALS = re.compile(rf"((?:[{_C}]\. ?){{1,2}})(?<=\. )({_FAMILY}){_EDGE}")
_HAS_COMMA_INITIAL = re.compile(rf", [{_C}]\.")
_COMMA_INITIAL = re.compile(rf"({_FAMILY}), ([{_C}]\.(?: ?[{_C}]\.)?)(?![{_L}0-9])")
_TITLED = re.compile(rf"(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|Sr|Sra|Srta|Don|Doña)\.? ([{_C}][{_L}]+) ({_FAMILY}){_EDGE}")
_SMALL_WORD = re.compile("[a-zà-ɏ]{2,}")
_HAN = "一-鿿々豈-﫿"
_JAPANESE = re.compile(rf"(?<![{_HAN}ぁ-んァ-ヶー])(?<![{_HAN}ヶ][ 　])([{_HAN}ヶ]{{1,4}})([ 　]?)([ぁ-んァ-ヶー]{{1,5}}?|[{_HAN}]{{1,3}}?)(?=(?:さん|様|さま|殿))")
_JA_AFTER_WA = re.compile(rf"(?<=[はがをに、「])([{_HAN}ヶ]{{1,4}})([ 　]?)([ぁ-んァ-ヶー]{{1,5}}?|[{_HAN}]{{1,3}}?)(?=(?:さん|様|さま|殿))")
_CHINESE = re.compile(rf"[{''.join(sorted(SURNAMES | {x[0] for x in SURNAMES2}))}][{_HAN}]{{1,3}}")
_HAS_HAN = re.compile(f"[{_HAN}]")
_POLITE = re.compile("女士|先生|小姐|太太")

# Words for streets, flats and districts.
_EN_STREET = r"(?:Street|St|Road|Rd|Lane|Ln|Avenue|Ave|Drive|Dr|Court|Ct|Close|Row|Way|Place|Pl|Square|Sq|Terrace|Crescent|Boulevard|Blvd|Hill|Mews|Gardens|Grove|Walk|Parade|Quay|Alley)"
_NAME = r"[A-ZÀ-Þ][^\W\d_]*(?:['’][a-z])?"
_EN_FLAT = r"(?:(?:Flat|Apt|Apartment|Unit|Suite|Room)\.? ?\d{1,4}[a-zA-Z]?)"
# Words that begin an English sentence rather than go on with a town's name.
_STARTERS = "The|A|An|She|He|It|Is|Are|Was|What|Who|When|Where|Why|How|In|At|By|On|See|Some|Nothing|Nobody|Neither|Because|Between|Prof|Dr|Mr|Mrs|Ms|Read|Send|Return|Call|Leave|This|That|There|They|We|You|I|If|And|But|Or|From|Contact|Signed|Please|Our|Order|Version|My|Insurance|ISBN|After|Before|While|Then"
_PLACE = r"[A-ZÀ-Þ][a-zà-ÿ]+(?:['’-][A-Za-zà-ÿ]+)*"
_EN_TOWN = rf"{_PLACE}(?: (?!(?:{_STARTERS})\b)(?:(?:on|upon|le|under|am|an der|sur|de|la|del) )?{_PLACE})?"
_POSTCODE = r"(?:\d{5}(?:-\d{4})?(?!\d)|[A-Z]{1,2}\d[A-Z\d]? ?\d[A-Z]{2}(?!\w))"
_ADDRESSES = [
    re.compile(rf"(?<![\w-])(?:{_EN_FLAT}, )?\d{{1,4}}[a-z]?(?: ?[-–] ?\d{{1,4}})? (?:{_NAME} ){{1,3}}{_EN_STREET}(?!\w)(?:, {_EN_FLAT})?(?:,[ \n]{_EN_TOWN}(?:(?:, | )(?:[A-Z]{{2}} )?{_POSTCODE})?|, {_POSTCODE})?"),
    re.compile(rf"(?<![\w-])(?:[A-ZÄÖÜ][\wäöüß]*(?:straße|strasse|str\.|gasse|weg|platz|allee|ring|damm|ufer|steig|stieg|markt)|(?:[A-ZÄÖÜ][\wäöüß-]+ ){{1,3}}(?:Straße|Strasse|Str\.|Gasse|Weg|Platz|Allee|Ring|Damm|Ufer)) \d{{1,4}} ?[a-z]?(?!\w)(?:, ?(?:D-)?\d{{5}}(?: {_EN_TOWN})?|, {_EN_TOWN})?"),
    re.compile(rf"(?<![\w-])\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?:rue|avenue|boulevard|place|allée|chemin|impasse|quai|route|cours|passage|square)(?: (?:de|du|des|la|le|les|l['’]|d['’])){{0,2}} ?(?:[A-ZÀ-Þ][\wÀ-ÿ'’-]*)(?: (?:[A-ZÀ-Þ][\wÀ-ÿ'’-]*|de|du|des|la))*(?:, ?\d{{5}}(?: {_EN_TOWN})?|, {_EN_TOWN})?", re.U),
    re.compile(rf"(?<![\w-])(?:C/|Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Ronda)(?: (?:de|del|la|las|los|el))* ?(?:[A-ZÀ-Þ][\wÀ-ÿ'’-]*)(?: (?:[A-ZÀ-Þ][\wÀ-ÿ'’-]*|de|del|la|las|los))*,? (?:n\.º ?)?\d{{1,4}}(?!\d)(?:, \d{{1,2}}\.?[ºª°o](?: ?(?:[A-Z]|izda\.?|dcha\.?|izq\.?))?(?!\w))?(?:, \d{{5}}(?: {_EN_TOWN})?|, {_EN_TOWN})?"),
    re.compile(rf"(?:[{_HAN}]{{2,3}}(?:省|自治区))?(?:[{_HAN}]{{2,3}}市)?(?:[{_HAN}]{{2,3}}(?:区|县))?[{_HAN}]{{1,4}}(?:大道|大街|路|街|巷|胡同)[0-9０-９]{{1,5}}(?:号|弄)(?:[0-9０-９]{{1,4}}(?:号楼|号|栋|幢|座|单元|室|楼|层))*(?:[ 　]?邮编[:：]?[ ]?[0-9０-９]{{6}})?"),
    re.compile(rf"(?:〒?[0-9]{{3}}-[0-9]{{4}} ?)?(?:[{_HAN}]{{2,3}}[都道府県])?[{_HAN}]{{1,4}}[市区郡](?:[{_HAN}ヶケノぁ-んァ-ンー]{{1,6}}?[町村区])?[{_HAN}ヶケノ]{{0,5}}(?:[0-9０-９]{{1,3}}丁目[0-9０-９]{{1,3}}番(?:地|[0-9０-９]{{1,3}}号)?|[0-9０-９]{{1,4}}[-－−ー][0-9０-９]{{1,3}}(?:[-－−ー][0-9０-９]{{1,4}})?)"),
]
#: A text without any of these words has no address of the form at the same place.
_HINTS = [
    ("Street", " St", "Road", " Rd", "Lane", " Ln", "Ave", "Drive", " Dr", "Court", " Ct", "Close", " Row", " Way", "Place", " Pl", "Square", " Sq", "Terrace", "Crescent", "Boulevard", "Blvd", " Hill", "Mews", "Gardens", "Grove", " Walk", "Parade", "Quay", "Alley"),
    ("straße ", "strasse ", "str. ", "gasse ", "weg ", "platz ", "allee ", "ring ", "damm ", "ufer ", "steig ", "stieg ", "markt ", "Straße ", "Strasse ", "Str. ", "Gasse ", "Weg ", "Platz ", "Allee ", "Ring ", "Damm ", "Ufer "),
    (" rue ", " avenue ", " boulevard ", " place ", " allée ", " chemin ", " impasse ", " quai ", " route ", " cours ", " passage ", " square "),
    ("C/ ", "Calle ", "Avenida ", "Avda", "Plaza ", "Paseo ", "Camino ", "Ronda "),
    ("号", "弄"),
    ("丁目", "町", "市", "区", "郡", "村"),
]
_HOUSE = [re.compile(r"\d[a-z]? (?:[A-ZÀ-Þ][^\W\d_]*(?:['’][a-z])? ){1,3}[A-Z]"), re.compile(r"[a-zß.] \d{1,4}"), re.compile(r"\d(?: ?(?:bis|ter|quater))?,? [a-zé]{3}"), re.compile(r"[a-zà-ÿ],? (?:n\.º ?)?\d"), re.compile(r"[道街路巷同][0-9０-９]{1,5}[号弄]"), re.compile(r"[0-9０-９](?:丁目|[-－−ー][0-9０-９])")]


def plain(name: str) -> str:
    """A name's comparison key: no case, no accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))


def form_of(number: str) -> tuple[str, int]:
    """The shape of a number (digits become 9, letters A) and its count of digits."""
    s = number.translate(_TO_ASCII) if _WIDE.search(number) else number
    return re.sub(r"[  　]", " ", re.sub(r"[A-Za-zＸｘ]", "A", re.sub(r"\d", "9", s))), sum(c.isdigit() for c in s)


def seed_kind(form: str, digits: int, number: str) -> str:
    """'phone' or 'id_number' for shapes that hardly anything else has, else ''."""
    if "A" in form:
        return "id_number"
    if form.startswith("+") and 8 <= digits <= 15:
        return "phone"
    if re.fullmatch(r"\(0?\d{2,4}\) ?\d{3,4}-\d{4}|\(?0\d{1,4}\)?[ /-]\d{3,8}(?:[ -]\d{2,4})?|0\d(?:[ .-]\d{2}){4}|1-\d{3}-\d{3}-\d{4}|00\d{2} .*", number.translate(_TO_ASCII)) and form != "9999-9999":
        return "phone"
    if form in ("999-99-9999", "9 99 99 99 999 999 99", "99 999 999 999", "9999 9999 9999"):
        return "id_number"
    bare = re.sub(r"\D", "", number.translate(_TO_ASCII))
    if digits == 18 and "1900" <= bare[6:10] <= "2099" and "01" <= bare[10:12] <= "12" and "01" <= bare[12:14] <= "31":
        return "id_number"
    return ""


_LAST = re.compile(r"([^\W\d_]+(?:[-.'’][^\W\d_]+)*\.?|\d+|[^\w\s])\s*$")
_FIRST = re.compile(rf"\s*([{_HAN}ぁ-んァ-ヶー]{{1,2}}|[^\W\d_]+|\d+|[^\w\s])")
_CLOSE = re.compile(rf"[{_HAN}ぁ-んァ-ヶー：:；;，,]")


def left_of(text: str, at: int, name: bool = True) -> str:
    """What stands before a mention: two tokens of its sentence, or three characters of a spaceless script.

    Names (but for the word right before a number or an address, which may label it), numbers and domains are made
    alike; "^" is the sentence's start, or a space before a mention in a spaceless script.
    """
    out, stop = [], at
    if text[at : at + 1] > "⺀" and text[at - 1 : at].isspace():
        return "^"
    for _ in range(2):
        last = stop
        while last and text[last - 1].isspace() and text[last - 1] != "\n":
            last -= 1
        if last and text[last - 1] > "⺀" and _CLOSE.match(text[last - 1]):
            begin = last - 1
            while begin and last - begin < 3 and _CLOSE.match(text[begin - 1]):
                begin -= 1
            out.append(text[begin:last])
            break
        m = _LAST.search(text, max(0, stop - 30), stop)
        if not m or "\n" in text[m.end(1) : stop]:
            out.append("^")
            break
        token = m[1]
        if token in _STOPS or token[-1] in ".!?" and (out or token[:-1].lower() not in _POINTED):
            out.append("^")
            break
        out.append("9" if token.isdigit() else "@" if "." in token[:-1] else "N" if token[:1].isupper() and (name or out) and (out or token.lower() not in TITLES) and token[-1] != "." else token.lower())
        if token[-1] > "ʯ" or token.lower().rstrip(".") in TITLES:
            break
        stop = m.start()
    return " ".join(reversed(out))


_POINTED = frozenset((*TITLES, "prof", "tel", "no", "nr", "hr", "fr"))
_STOPS = frozenset(".!?…。！？”“»」』）)\x07\x1b")


def right_of(text: str, at: int) -> str:
    m = _FIRST.match(text, at, at + 30)
    return "$" if not m or "\n" in text[at : m.start(1)] else "9" if m[1].isdigit() else "N" if m[1][:1].isupper() else m[1].lower()


def _apart(rule: re.Pattern, text: str) -> Iterator[re.Match]:
    """The rule's matches that nothing is joined to on the left; what begins within a refused one is tried as well."""
    at = 0
    while m := rule.search(text, at):
        if m.start() and _JOINED.match(text, m.start() - 1):
            at = m.start() + 1
        else:
            yield m
            at = m.end()


def candidates(text: str, given: frozenset[str]) -> list[tuple[str, int, int, str, str, str, str, str]]:
    """What may be a mention: (sort, start, end, form, seed, key, left, right), sort being email, address, number or name.

    Every one comes with its form and its context. A seed is set only where a label or title stands before it and its
    own form doesn't speak against that, or for an international phone number; key is a name's family name. Chinese names are looked for in the whole text.
    """
    out: list[tuple[str, int, int, str, str, str, str, str]] = []
    taken: list[tuple[int, int]] = []
    for at in _AT.finditer(text) if "@" in text or "＠" in text or any(x in text for x in ("(at)", "(AT)", "[at]", "[AT]", " at ", " AT ")) else ():
        local = _LOCAL.search(text, max(0, at.start() - 80), at.start())
        m = _EMAIL.match(text, local.start()) if local else None
        if m and m.end() > at.end() and not any(a < m.end() and m.start() < b for a, b in taken):
            near = text[max(0, m.start() - 12) : m.start()].lower()
            shape = re.sub(r"[^@＠()\[\]. ]+", "a", m[0])
            out.append(("email", m.start(), m.end(), shape, "email" if "@" in shape and any(x in near for x in EMAIL_LABELS) else "", "", left_of(text, m.start(), False), right_of(text, m.end())))
            taken.append((m.start(), m.end()))
    for words, house, rule in zip(_HINTS, _HOUSE, _ADDRESSES, strict=True):
        if house.search(text) and any(w in text for w in words):
            for m in rule.finditer(text):
                start, end = m.start(), m.end()
                if rule is _ADDRESSES[4]:
                    start += _lead(text[start:end])
                elif rule is _ADDRESSES[5]:
                    start += _lead_ja(text, start, end)
                if not any(a < end and start < b for a, b in taken):
                    near = text[max(0, start - 12) : start].lower()
                    labelled = any(x in near for x in ADDRESS_LABELS)
                    out.append(("address", start, end, f"address {_ADDRESSES.index(rule)}", "address" if labelled else "", "", left_of(text, start, False), right_of(text, end)))
                    taken.append((start, end))
    for gate, rule in ((_LETTER_END, _LETTERED), (_DIGITS, _NUMBER)):
        for m in rule.finditer(text) if gate.search(text) else ():
            s, start, end = m[0], m.start(), m.end()
            if end - start < 7:
                continue
            form, digits = form_of(s)
            if not (6 + ("A" not in form) <= digits <= 18) or _DATE.fullmatch(s) or form.startswith("999-9-9999-9999-9"):
                continue
            if any(a < end and start < b for a, b in taken):
                continue
            if form[0] == "(" and ")" not in form:
                start += 1
            left = left_of(text, start, False)
            low = left.lower()
            telling = seed_kind(form, digits, s)
            near = re.split("[。！？\\n]", text[max(0, start - 26) : start].lower())[-1]
            label = "id_number" if any(x in near for x in ID_LABELS) else "phone" if any(x in low or x in near[-8:] for x in PHONE_LABELS) else ""
            # an international number, or one that an authority's label precedes in a form that tells nothing else
            seed = label if label == (telling or "id_number") else telling if not label and form[0] == "+" else ""
            out.append(("number", start, end, form, seed, "", left, right_of(text, end)))
            taken.append((start, end))
    found: set[tuple[int, int]] = set()

    def name(start: int, end: int, form: str, family: str, sure: bool = False) -> None:
        if (start, end) in found or any(a < end and start < b for a, b in found) or any(a < end and start < b for a, b in taken):
            return
        found.add((start, end))
        left = left_of(text, start)
        seed = "name" if sure or "|" in form and left.split(" ")[-1].rstrip(".") in TITLES else ""
        out.append(("name", start, end, form, seed, plain(family), left, right_of(text, end)))

    spans = {m.span() for m in _apart(_GIVEN, text)} | {m.span(1) for m in _GIVEN_LAST.finditer(text)}
    for begin, stop in sorted(spans):
        m = _GIVEN_WORD.match(text, begin, stop)
        if plain_cached(m[0]) in given:
            before = _BEFORE_GIVEN.search(text, max(0, m.start() - 50), m.start()) if text[m.start() - 1 : m.start()] == " " else None
            if before and before[1].lower() not in _NO_FAMILY:
                name(before.start(1), _MORE_INITIALS.match(text, m.end()).end() if _MORE_INITIALS.match(text, m.end()) else m.end(), f"family, given|{plain_cached(m[0])}", before[1])
            elif (after := _AFTER_GIVEN.match(text, m.end())) and (after[2].isupper() or not m[0].isupper()):
                name(m.start(), after.end(), f"given family|{plain_cached(m[0])}", after[2])
    for m in _apart(_TITLED, text):
        name(m.start(1), m.end(2), "titled", m[2])
    words = set(_SMALL_WORD.findall(text)) if _HAS_HAN.search(text) else set(text.split())
    known = words & given
    if not text.isascii():
        known |= {w for w in words - given if not w.isascii() and w.islower() and plain_cached(w) in given}
    for word in sorted(known):
        for m in re.finditer(rf"(?<![{_L}0-9]){re.escape(word)}(?![{_L}0-9])", text):
            if after := _AFTER_SMALL.match(text, m.end()):
                name(m.start(), after.end(), f"small|{plain_cached(word)}", after[2])
            if before := _BEFORE_SMALL.search(text, max(0, m.start() - 40), m.start()):
                name(before.start(1), m.end(), f"small, given|{plain_cached(word)}", before[1])
    if ". " in text:
        for m in _apart(_INITIALS, text):
            if m[2].lower() not in _NO_FAMILY:
                name(m.start(), m.end(), "initial family", m[2])
        for m in _apart(_COMMA_INITIAL, text) if _HAS_COMMA_INITIAL.search(text) else ():
            if m[1].lower() not in _NO_FAMILY:
                name(m.start(), m.end(), "family, initial", m[1])
    if _HAS_HAN.search(text):
        if re.search("さん|様|さま|殿", text):
            for rule in (_JA_AFTER_WA, _JAPANESE):
                for m in rule.finditer(text):
                    name(m.start(), m.end(), "japanese", m[1], True)
        inside = {i for a, b in taken for i in range(a, b)}
        at = 0
        while m := _CHINESE.search(text, at):
            at = m.start() + 1
            if m.start() in inside:
                continue
            family = m[0][:2] if m[0][:2] in SURNAMES2 else m[0][:1]
            if len(family) == 1 and family not in SURNAMES or len(family) == len(m[0]):
                continue
            left = left_of(text, m.start())
            for length in range(min(len(m[0]), len(family) + 2), len(family), -1):
                end = m.start() + length
                polite = _POLITE.match(text, end) is not None
                out.append(("name", m.start(), end, "chinese", "name" if polite and left == "^" else "", family, left, right_of(text, end)))
    return list(dict.fromkeys(out))


_NO_FAMILY = frozenset("signed contact dear yours sincerely regards from to cc hello hi and the a an prof dr st in at by see some when because nobody nothing between neither who what archive jr sr inc hall vol pp and or".split())
_plain: dict[str, str] = {}


def plain_cached(word: str) -> str:
    key = _plain.get(word)
    if key is None:
        if len(_plain) > 200_000:
            _plain.clear()
        key = _plain[word] = plain(word)
    return key


def _lead(s: str) -> int:
    """How many characters before a Chinese address are ordinary words."""
    m = re.search(r"(?:来信请寄|请寄|寄往|寄到|寄至|寄|住址是|住址|地址是|地址为|地址|住在|位于|家住|迁至|搬到|送到|送至|在|于|是|为|到)", s[:8])
    return m.end() if m else 0


def _lead_ja(text: str, start: int, end: int) -> int:
    m = re.search(r"^[^市区郡都道府県]*?(?:住所は|は|が|に|の|を)", text[start:end])
    return m.end() if m else 0


SCHEMA = "doc_id bigint, sort string, start_pos bigint, end_pos bigint, form string, seed string, key string, left string, right string"


def mentions(documents: DataFrame, given: list[str]) -> DataFrame:
    """The candidates of every document's whole text, by `candidates`; no shuffle. Null and empty texts have none."""
    names = frozenset(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    rows += [(key, *c) for c in candidates(text, names)]
            if rows:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "sort", "start_pos", "end_pos", "form", "seed", "key", "left", "right"])

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SCHEMA)


def known_people(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Family names borne by persons (key), and given names with how many persons have them (key, n), from stored names.

    Western names are read as "Given Family" or "Family, Given"; Chinese ones begin with the family name, which counts
    only if at least one in 500 Chinese persons has it, since transposed characters also stand first now and then.
    """
    people = entities.filter(F.lower("entity_type").startswith("person") & F.col("canonical_name").isNotNull()).select("id", "canonical_name").distinct()

    @F.pandas_udf("family array<string>, given string, han string")
    def parts(names):  # noqa: ANN001, ANN202
        import pandas as pd

        from quillgraph.llm.lookalike import canonical

        rows = []
        for raw_name in names:
            name = canonical(raw_name) or ""
            if re.match(f"[{_HAN}]", name):
                two = name[:2] in SURNAMES2
                rows.append(([], None, name[:2] if two else name[:1]))
                continue
            name = re.sub(r",? (?:Jr|Sr|PhD|II|III|IV|Esq|M\.?D)\.?$", "", name)
            if ", " in name:
                family, given = name.split(", ", 1)
            else:
                words = name.split()
                family, given = (words[-1], " ".join(words[:-1])) if len(words) > 1 else (name, "")
            given = given.split(" ")[0].strip(".")
            rows.append(([plain(family), *map(plain, family.split("-"))], plain(given) if len(given) > 1 else None, None))
        return pd.DataFrame(rows, columns=["family", "given", "han"])

    read = written(people.select(parts("canonical_name").alias("p")).select("p.*"), "people")
    western = read.select(F.explode("family").alias("key"))
    han = read.filter("han IS NOT NULL").groupBy(F.col("han").alias("key")).count()
    total = han.agg(F.sum("count").alias("total"))
    chinese = han.crossJoin(F.broadcast(total)).filter(F.col("count") * 500 >= F.col("total")).select("key")
    given = read.filter("given IS NOT NULL").groupBy(F.col("given").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return western.unionByName(chinese).filter("key <> ''").distinct(), given


#: A given name counts if at least one in so many persons has it, so there are at most as many such names.
GIVEN_SHARE = 2000


def given_names(given: DataFrame, forms: DataFrame) -> list[str]:
    """Frequent given names and all short and formal forms of the fixed list of forms; bounded by GIVEN_SHARE."""
    total = given.agg(F.sum("n")).first()[0] or 0
    frequent = [r["key"] for r in given.filter(F.col("n") * GIVEN_SHARE >= total).filter(F.col("n") > 1).select("key").collect()]
    fixed = [plain(x) for r in forms.select("form", "formal").collect() for x in r if x]
    return sorted({*frequent, *fixed} - {"", "the", "a"})


#: Rounds of scoring; of a pattern's telling mentions at least KIND must be of its kind, there must be FEWEST of them and
#: they must be SHARE of its mentions (ONE_SIDED for a left side alone); FORM is a form's share of mentions of one kind.
ROUNDS, KIND, FEWEST, SHARE, ONE_SIDED, FORM = 4, 0.6, 2, 0.02, 0.3, 0.9
KINDS = ("phone", "id_number", "name", "email", "address")
_ANY = "\u0000"


def learned(found: DataFrame) -> DataFrame:
    """sort, left, right, form, kind, round: what mentions of a form between a left and a right side are, and since when.

    Patterns are the two sides of a mention, or its left side alone; instances are forms (a number's or address's shape,
    a name's given name). The graph has an edge for each pattern and form with its number of mentions, by an aggregate
    that is partial on the map side. Telling mentions are the seeds, positive for their kind, and names of public
    persons (column public), negative. In each round a pattern sums its telling mentions, where a mention without a
    seed whose form is trusted counts a half, and passes by KIND, FEWEST and SHARE; a form is trusted if FORM of what is
    told about its mentions by trusted patterns and seeds is one kind (for numbers, FORM of all its mentions). What is
    trusted stays so. Patterns and forms that nothing tells anything about never pass.
    """
    side = ["sort", "left", "right"]
    telling = [F.sum(F.when((F.col("seed") == k) & ~F.col("public"), 1).otherwise(0)).alias(k) for k in KINDS]
    two = written(found.groupBy(*side, "form").agg(F.count(F.lit(1)).alias("n"), *telling, F.sum(F.when(F.col("public"), 1).otherwise(0)).alias("other")), "edges")
    one = two.groupBy("sort", "left", "form").agg(*[F.sum(c).alias(c) for c in ("n", *KINDS, "other")]).withColumn("right", F.lit(_ANY))
    edges = written(two.unionByName(one), "patterns")
    spark = found.sparkSession
    patterns = spark.createDataFrame([], "sort string, left string, right string, kind string, round int")
    forms = spark.createDataFrame([], "sort string, form string, form_kind string, form_round int")
    best = F.greatest(*KINDS)
    which = F.coalesce(*[F.when(F.col(k) == best, F.lit(k)) for k in KINDS])
    told = sum((F.col(k) for k in KINDS), F.col("other"))
    for at in range(1, ROUNDS + 1):
        weighed = edges.join(forms, ["sort", "form"], "left")
        half = lambda k: F.col(k) + F.when(F.col("form_kind") == k, (F.col("n") - told) * 0.5).otherwise(0)
        scores = weighed.groupBy(*side).agg(F.sum("n").alias("n"), F.sum("other").alias("other"), *[F.sum(half(k)).alias(k) for k in KINDS])
        share = F.when(F.col("right") == _ANY, ONE_SIDED).otherwise(SHARE)
        new = scores.filter((best >= told * KIND) & (best >= FEWEST) & (best >= F.col("n") * share)).select(*side, which.alias("kind"), F.lit(at).alias("round"))
        patterns = written(patterns.unionByName(new.join(patterns.select(*side), side, "left_anti")), "patterns")
        placed = _placed(two, patterns)
        said = [F.sum(F.when(F.col("kind") == k, F.col("n") - F.col("other")).otherwise(F.when(F.col("kind").isNull(), F.col(k)).otherwise(0))).alias(k) for k in KINDS]
        sums = placed.groupBy("sort", "form").agg(F.sum(F.col("n") - F.col("other")).alias("n"), *said).withColumn("other", F.lit(0))
        sure = (best >= told * FORM) & (best >= FEWEST) & ((F.col("sort") != "number") | (best >= F.col("n") * FORM)) & ((F.col("sort") != "name") | F.contains("form", F.lit("|")))
        more = sums.filter(sure).select("sort", "form", which.alias("form_kind"), F.lit(at).alias("form_round"))
        forms = written(forms.unionByName(more.join(forms.select("sort", "form"), ["sort", "form"], "left_anti")), "forms")
    judged = _placed(two, patterns).join(forms, ["sort", "form"], "left")
    kind = F.coalesce("kind", "form_kind")
    fits = F.when(F.col("sort") == "number", kind.isin("phone", "id_number")).otherwise(kind == F.col("sort"))
    return written(judged.filter(fits).select(*side, "form", kind.alias("kind"), F.coalesce("round", "form_round").alias("round")), "judged")


def _placed(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """edges with the kind and round of their two-sided pattern, or else of their left side."""
    full = patterns.filter(F.col("right") != _ANY).select("sort", "left", "right", F.col("kind").alias("k2"), F.col("round").alias("r2"))
    left = patterns.filter(F.col("right") == _ANY).select("sort", "left", F.col("kind").alias("k1"), F.col("round").alias("r1"))
    met = edges.join(full, ["sort", "left", "right"], "left").join(left, ["sort", "left"], "left")
    return met.withColumns({"kind": F.coalesce("k2", "k1"), "round": F.when(F.col("k2").isNotNull(), F.col("r2")).otherwise(F.col("r1"))}).drop("k1", "k2", "r1", "r2")


def judged(documents: DataFrame, entities: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos, end_pos, seed, round: the mentions that trusted patterns or forms tell, and in which round.

    Every mention is accepted by scores, seeds too. Family names of persons in entities are no case.
    """
    families, given = known_people(entities)
    found = written(mentions(documents, given_names(given, forms)), "mentions")
    names = join_unique(found.filter("sort = 'name'"), families.withColumn("public", F.lit(True)), "key", "left").withColumn("public", F.col("public").isNotNull())
    open_ = written(names.unionByName(found.filter("sort <> 'name'").withColumn("public", F.lit(False))), "open")
    edge = F.unhex(F.md5(F.concat_ws("\u001f", "sort", "left", "right", "form"))).alias("edge")
    known = learned(open_).select(edge, "kind", "round")
    return join_unique(open_.filter("NOT public").select("doc_id", "start_pos", "end_pos", "seed", edge), known, "edge", "inner").drop("edge")


def find(documents: DataFrame, entities: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, kind, start_pos, end_pos of each mention of a private person or how to reach one.

    A few seeds (a label or title before, and a telling form) induce patterns; patterns and forms are scored in rounds
    on their graph; what trusted patterns or forms tell is found. Equal documents give equal mentions; null texts none.
    Of overlapping mentions of a kind the first and longest stays.
    """
    return _longest(judged(documents, entities, forms).select("doc_id", "kind", "start_pos", "end_pos").distinct())


def _longest(every: DataFrame) -> DataFrame:
    """Without mentions that overlap an earlier, or from the same start a longer, one of the same document and kind."""
    w = Window.partitionBy("doc_id", "kind").orderBy("start_pos", F.col("end_pos").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("reach", F.max("end_pos").over(w)).filter(F.col("reach").isNull() | (F.col("start_pos") >= F.col("reach"))).drop("reach")


PLACEHOLDER = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}


def mask(documents: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and masked: every document's text with its mentions replaced by typed placeholders, the rest untouched.

    The mentions of one document are gathered (they are few against its text); documents without any keep their text,
    null texts stay null. Documents are not gathered by any key but their own id.
    """
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "kind"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if text is not None and cuts:
                    out, at = [], 0
                    for cut in cuts:
                        if cut["start_pos"] >= at:
                            out += [text[at : cut["start_pos"]], PLACEHOLDER[cut["kind"]]]
                            at = cut["end_pos"]
                    text = "".join(out) + text[at:]
                texts.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "masked"])

    return documents.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, masked string")


