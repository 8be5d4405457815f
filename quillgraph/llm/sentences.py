"""Sentence boundaries in spaced and spaceless scripts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Abbreviations (without the last point) that don't end a sentence when something follows.
NEVER = frozenset(
    "dr prof st mr mrs ms mme mlle sr sra srta dra hr fr frl vol vols no nos nr pp p pág págs pag cf vgl e.g i.e s bd bde fig figs ca c v vv sec secs ch chap art ed eds rev gen col lt sgt capt hon ave mt ft bzw d.h z.b u.a s.o s.u abs kap anm hrsg jh geb gest evtl ggf sog c.-à-d p.ej ej núm vs viz approx dept univ prop н стр. д проф акад им ул см т.е т.к डॉ श्री د أ".split()
)
# Abbreviations that end a sentence if a capital follows.
PERHAPS = frozenset("etc usw inc ltd co corp jr sr al ff f p.m a.m г гг стр в вв др пр руб т.д т.п bc ad ph.d m.a b.a u.s u.k uff ecc".split())
# Months after a German ordinal, and nouns that take one.
AFTER_ORDINAL = frozenset("januar februar märz april mai juni juli august september oktober november dezember jänner jan feb mär apr jun jul aug sep sept okt nov dez jahrhundert jahrhunderts jh kapitel band auflage buch tag jahr woche klasse".split())
# Brackets and quotation marks with what closes them.
CLOSES = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "《": "》", "【": "】", "〈": "〉", "〔": "〕"}
CLOSERS = "”“’»›」』）)\\]》】〉〕\"'"
# Verbs that report speech, as they stand at the end of a Chinese clause.
_REPORT = re.compile(r"[^。！？!?“”「」『』\n]*?(?:问道|問道|说道|說道|答道|笑道|叹道|嘆道|喊道|写道|寫道|说|說|问|問|曰|云|道)[。！？!?]")
_GOES_ON = re.compile(r"[便就又而并並即乃遂则則且后後的]|随即|然后|于是|とは|と|って|という|など|の|を|が|は|に|も|라고|하고|라는|고\b|이라고|라며")
# Thai words by what they say about a gap: closing particles, opening words, words that go on, verbs, others.
THAI_FINAL = frozenset("หรือไม่ ครับ ค่ะ คะ นะ แล้ว ครั้ง ไหม มั้ย เถอะ สิ จ้ะ จ๊ะ เลย หรือยัง ด้วย".split())
THAI_OPEN = frozenset("เขา เธอ คุณ ผม ฉัน ดิฉัน เรา พวกเขา มัน ท่าน ผู้อ่าน ผู้เขียน นาย นาง นางสาว ต่อมา จากนั้น อย่างไรก็ตาม ดังนั้น นอกจากนี้ เมื่อ หาก ถ้า วันนี้ ปัจจุบัน".split())
THAI_ON = frozenset("และ แต่ หรือ ซึ่ง ที่ เพราะ โดย กับ ของ ใน จาก เพื่อ ว่า แก่ ต่อ ตาม อัน จน ก็ ทั้ง คือ ได้แก่ เช่น".split())
THAI_VERB = frozenset("ทบทวน เล่าถึง เล่า อธิบาย กล่าวถึง กล่าว เป็น มี อยู่ ไป มา ทำ พูด อ่าน เขียน คิด เห็น ได้ ให้ รู้ บอก ถาม ตอบ เรียก ใช้ พบ เริ่ม กลาย".split())
THAI_OTHER = frozenset("บทความ บันทึก หนังสือ ดัชนี ต้นฉบับ เรื่องเล่า เรื่อง เล่ม เล่มนี้ นี้ นั้น ปี ในปี มาแล้ว เงียบ ใหม่ เก่า ยาว สั้น คน วัน เดือน ไม่ จะ ถูก กำลัง ยัง มาก น้อย ดี บ้าน เมือง ประเทศ ภาษา ความ การ".split())
THAI = {w: k for k, words in (("final", THAI_FINAL), ("open", THAI_OPEN), ("on", THAI_ON), ("verb", THAI_VERB), ("other", THAI_OTHER)) for w in words}
_LONGEST = max(map(len, THAI))

# Terminators of other scripts than the Latin, Chinese and Japanese, which end a sentence wherever they stand.
SCRIPT_ENDS = "।॥؟۔։።፧፨។៕៖။༎།᠃᠉꓿᙮᱾᱿꘎꘏꛳꛷꡶꡷꩝꩞꩟꫰꫱꯫"
_STOP = re.compile("[.!?…" + SCRIPT_ENDS + "。！？｡\\n“„«‹「『（(\\[《【〈〔”»›」』）)\\]》】〉〕]|(?<=[\\u0e00-\\u0e7f0-9A-Za-z])[ \\u00a0]+(?=[\\u0e00-\\u0e7f])|(?<=[\\u0e00-\\u0e7f])[ \\u00a0]+")
_RUN = re.compile(f"[.!?…{SCRIPT_ENDS}。！？｡]+")
_AFTER = re.compile(rf"(?:[   ]?[»›]|[{CLOSERS}])")
_SPACE = re.compile(r"\s*")
_LATIN_END = re.compile(r"((?:[A-Za-zÀ-ʯЀ-ӿऀ-ॿء-ي]+(?:\.\s?-?)?-?)*?[A-Za-zÀ-ʯЀ-ӿऀ-ॿء-ي]+|\d+)$")
_WORD = re.compile(r"[^\W\d_]+")
_DASH = "—–―-"
_WIDE = re.compile(r"[⺀-鿿豈-﫿＀-･]")


def lattice(run: str) -> list[tuple[str, str]]:
    """Words of a spaceless run with their kinds, by the cheapest path through the dictionary's word lattice.

    A dictionary word costs 1, a stretch the dictionary lacks 2 and 1 for each character, so paths with few and long
    known words win; ties go to the longer last word. Digits and letters of other scripts stay together.
    """
    n = len(run)
    best = [(0.0, 0, "")] + [(float("inf"), 0, "")] * n
    for i in range(n):
        cost = best[i][0]
        if cost == float("inf"):
            continue
        for j in range(min(n, i + _LONGEST), i, -1):
            kind = THAI.get(run[i:j])
            if kind and cost + 1 < best[j][0]:
                best[j] = (cost + 1, i, kind)
        step = cost + (1 if best[i][2] == "?" else 3)
        if step < best[i + 1][0]:
            best[i + 1] = (step, i, "?")
    words, at = [], n
    while at:
        _, start, kind = best[at]
        words.append((run[start:at], kind))
        at = start
    return words[::-1]


def thai_gap(before: str, after: str) -> bool:
    """Whether a space between two Thai runs ends a sentence, by closing particles, opening words and verbs."""
    left, right = lattice(before), lattice(after)
    if not left or not right or right[0][1] == "on":
        return False
    if left[-1][1] == "on":
        return False
    if left[-1][1] == "final" or right[0][1] == "open":
        return True
    verbs = lambda words: any(k == "verb" for _, k in words) or any(w in ("นี้",) for w, _ in words)
    return verbs(left) and verbs(right)


def _ends(text: str, start: int, run_at: int, run_end: int, end: int, opened: int) -> bool:
    """Whether the terminators at run_at (closers up to `end` included) end the sentence that began at `start`.

    opened is where the outermost quotation or bracket closed after them was opened, or -1.
    """
    at = _SPACE.match(text, end).end()
    if at >= len(text):
        return True
    gap, following, run = text[end:at], text[at], text[run_at:run_end]
    if "\n" in gap:
        return not (following.islower() and run == "." and "\n" not in gap.replace("\n", "", 1))
    wide = run[-1] in "。！？｡"
    if all(c == "…" for c in run) or set(run) == {"."} and len(run) > 1:
        if opened < 0 and not gap and (_WIDE.match(following) or _WIDE.match(text[run_at - 1 : run_at])):
            return False
        return bool(gap) and not following.islower() and following not in ",;:，；：" if opened < 0 else not following.islower() and following not in ",;:，；：—"
    if wide:
        if opened < 0:
            return True
        if following in "，、；：,;:":
            return False
        if not gap and text[end - 1] in "”」』\"" and (following in "とのなをがはにも" and text[end - 1] in "」』" or text.startswith("って", at)):
            return False
        if text[end - 1] in "”」』\"" and not gap and _REPORT.match(text, at):
            return False
        return not (opened > start and not gap and _GOES_ON.match(text, at))
    if following in ",;:，；：、)]":
        return False
    if following in _DASH:
        rest = _SPACE.match(text, at + 1).end()
        return not (rest < len(text) and text[rest].islower())
    if following.islower():
        return False
    if run[-1] in SCRIPT_ENDS:
        return True
    if not gap:
        if opened >= 0 and "가" <= following <= "힣":
            return False
        return bool(_WIDE.match(following) or following in "“«「『（《") and (run[-1] in "!?" or text[run_at - 1].isalpha() or opened >= 0)
    if run[-1] in "!?" or opened >= 0:
        return True
    m = _LATIN_END.search(text, _word_start(text, start, run_at), run_at)
    if not m:
        return True
    word = m[1].lower().replace(" ", "")
    last = word.rsplit(".", 1)[-1]
    if len(last) == 1 and last.isalpha() and (m[1][-1].isupper() and following.isalpha() or text[at + 1 : at + 2] == "."):
        return False
    if word.isdecimal():
        nxt = _WORD.match(text, at)
        return not (len(word) <= 2 and 0 < int(word) <= 31 and nxt is not None and nxt[0].lower() in AFTER_ORDINAL)
    if last in PERHAPS or word in PERHAPS:
        return not following.isdecimal()
    return not (word in NEVER or last in NEVER and (following.isalnum() or following in "«“„"))


_INK = re.compile(r"\S*")


def _run_start(text: str, start: int, at: int) -> int:
    """Where the run without white space that ends at a place begins, not before start."""
    while at > start and not text[at - 1].isspace():
        at -= 1
    return at


def _word_start(text: str, start: int, at: int) -> int:
    """Where the word before a point begins, the parts of a spaced abbreviation ("z. B") included."""
    at = _run_start(text, start, at)
    while at - 2 > start and text[at - 1] in "  \t" and text[at - 2] == "." and at - _run_start(text, start, at - 1) < 6:
        at = _run_start(text, start, at - 1)
    return at


def split(text: str | None) -> list[tuple[int, int]]:
    """Start and end of each sentence, in code points; white space around it isn't part of it.

    Closing quotation marks and brackets belong to the sentence; nothing ends inside them. A blank line always ends
    one, a line end does so unless a small letter follows a bare point. Null, empty and blank texts have none.
    """
    if not text:
        return []
    out: list[tuple[int, int]] = []
    start = at = _SPACE.match(text).end()
    stack: list[tuple[str, int]] = []
    n = len(text)
    limit = _limit(text, 0)

    def finish(end: int) -> int:
        nonlocal stack
        stop = len(text[:end].rstrip()) if end and text[end - 1].isspace() else end
        if stop > start:
            out.append((start, stop))
        stack = []
        return _SPACE.match(text, end).end()

    while at < n:
        m = _STOP.search(text, at)
        if not m:
            break
        c, p = m[0][0], m.start()
        if c == "\n":
            space = _SPACE.match(text, p).end()
            if "\n" in text[p + 1 : space] or not stack and space < n and not text[space].islower():
                at = start = finish(p)
                limit = _limit(text, at)
            else:
                at = p + 1
        elif c in "  ":
            if not stack:
                before = text[_run_start(text, start, p) : p]
                after = _INK.match(text, m.end())[0]
                if after and thai_gap(before, after):
                    at = start = finish(p)
                    continue
            at = m.end()
        elif stack and c in CLOSES[stack[-1][0]]:
            stack.pop()
            at = p + 1
        elif c in CLOSES:
            if any(0 < text.find(x, p + 1, limit) for x in CLOSES[c]):
                stack.append((c, p))
            at = p + 1
        elif _RUN.match(c):
            run = _RUN.match(text, p).end()
            if c == "." and run == p + 1 and p and run < n and text[p - 1].isdecimal() and text[run].isdecimal():
                at = run
                continue
            end, opened = run, -1
            while (k := _AFTER.match(text, end)) and end < n:
                mark = k[0][-1]
                if stack and mark in CLOSES[stack[-1][0]]:
                    opened = stack.pop()[1]
                elif mark in CLOSES or k[0][0] in "   ":
                    break
                elif not stack and mark not in "\"'’":
                    break
                end = k.end()
            at = end
            if not stack and _ends(text, start, p, run, end, opened):
                at = start = finish(end)
                limit = _limit(text, at)
        else:
            at = p + 1
    if start < n:
        finish(n)
    return out


def _limit(text: str, at: int) -> int:
    """Where the paragraph around a position ends; a bracket that closes later is no bracket here."""
    m = _BLANK.search(text, at)
    return m.start() if m else len(text)


_BLANK = re.compile(r"\n\s*\n")


def sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sentence (0-based), start_pos, end_pos and sentence_text of every row's sentences; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(at, k, s, e, body[s:e]) for at, body in enumerate(batch.column(1).to_pylist()) for k, (s, e) in enumerate(split(body))]
            if rows:
                at, k, s, e, part = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(part)], ["key", "sentence", "start_pos", "end_pos", "sentence_text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"key {kind}, sentence int, start_pos bigint, end_pos bigint, sentence_text string").withColumnRenamed("key", key)
