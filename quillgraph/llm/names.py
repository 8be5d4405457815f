"""Variant spellings of names, linked by a trie join with Levenshtein automata and checks of token order."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.bpe import rank_file
from quillgraph.llm.lookalike import canonical
from quillgraph.llm.personal import SURNAMES2, plain
from quillgraph.plans.skew import join_many, join_unique
from quillgraph.session import forget, written

# What stands before or after a name without being part of it.
SUFFIXES = frozenset("jr sr phd md ma esq ii iii iv".split())
TITLES = frozenset("dr prof mr mrs ms sir lady master st saint".split())
ARTICLES = frozenset("the a an".split())
# Words that tell namesakes apart.
RANKS = frozenset("younger elder older junior senior".split())
_HAN = "一-鿿々豈-﫿"
_HONORS = re.compile(r"^(?:山长|山長|夫子|大师|先师)|(?:先生|居士|山人|夫子|大师|女士|氏|公|子)$")
_INNER = re.compile(rf"^([{_HAN}])(?:公|氏|夫子)(?=[{_HAN}]{{2}}$)")
_MARKS = re.compile(r"[\s·・•《》〈〉「」『』“”\"'（）()\-‧∙.,，、]+")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*\.?|\d+")
_YEARS = re.compile(r"(?<!\d)(\d{3,4})(?!\d)")


def bound(length: int) -> int:
    """Edits allowed in a token of this length."""
    return 0 if length < 5 else 1 if length < 8 else 2 if length < 9 else 3


class Trie:
    """Strings as a tree of letters."""

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = word

    def near(self, word: str, most: int) -> Iterator[tuple[str, int]]:
        """Words within `most` edits, with their distance.

        The Levenshtein automaton of the word runs along the tree: a state is the row of distances to the word's
        prefixes, cut to the band of `most` around the diagonal; a branch ends where no cell is within `most`.
        """
        n, far = len(word), most + 1
        stack = [(self.root, [min(i, far) for i in range(n + 1)], 0)]
        while stack:
            node, row, depth = stack.pop()
            for c, child in node.items():
                if c == "":
                    if row[n] <= most:
                        yield child, row[n]
                    continue
                low, high = max(1, depth + 1 - most), min(n, depth + 1 + most)
                following = [far] * (n + 1)
                if depth + 1 <= most:
                    following[0] = depth + 1
                least = following[0]
                for i in range(low, high + 1):
                    a = row[i - 1] + (word[i - 1] != c)
                    b = row[i] + 1
                    if b < a:
                        a = b
                    b = following[i - 1] + 1
                    if b < a:
                        a = b
                    if a < far:
                        following[i] = a
                        if a < least:
                            least = a
                if least <= most:
                    stack.append((child, following, depth + 1))


def distance(a: str, b: str) -> int:
    """Edits between two strings, exchanged neighbours counting one."""
    if a == b:
        return 0
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        before, last = last, row
    return last[-1]


def _segments(length: int, most: int) -> list[tuple[int, int]]:
    """Start and length of most + 1 nearly equal parts of a string."""
    parts = most + 1
    base, more = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        size = base + (i >= parts - more)
        out.append((at, size))
        at += size
    return out


def _shards(word: str) -> list[tuple[str, bool]]:
    """The shards a word is indexed in (True) and those it asks (False).

    Of two strings within k edits, one cut into k + 1 parts has a part that stands unchanged in the other, at most k
    places away; a shard is the length, the part's number and the part. So no neighbour is missed, and no shard holds
    more than the words with one same part.
    """
    n = len(word)
    most = bound(n)
    out = [(f"{n}.{i}.{word[s : s + size]}", True) for i, (s, size) in enumerate(_segments(n, most))]
    for length in range(max(5, n - most), n + most + 1):
        k = min(most, bound(length))
        if abs(length - n) > k:
            continue
        for i, (start, size) in enumerate(_segments(length, bound(length))):
            for at in range(max(0, start - k), min(n - size, start + k) + 1):
                out.append((f"{length}.{i}.{word[at : at + size]}", False))
    return list(dict.fromkeys(out))


def neighbours(words: DataFrame) -> DataFrame:
    """word, other: every two distinct words of the column word within the bound of the shorter one's length.

    Words go to shards (see _shards) by hash; each shard's words make a trie that its questions traverse. Shards come
    sorted, so a task keeps one trie at a time. words must be distinct.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, not index, w) for w in batch.column(0).to_pylist() for s, index in _shards(w)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["shard", "asks", "word"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trie, size, only = None, Trie(), 0, ""
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for shard, asks, word in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now:
                    now, trie, size = shard, Trie(), 0
                if not asks:
                    trie.add(word)
                    size, only = size + 1, word
                elif size > 1 or size == 1 and only != word:
                    for other, _ in trie.near(word, min(bound(len(word)), bound(int(shard.split(".", 1)[0])))):
                        if other != word:
                            found.add((word, other))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*sorted(found), strict=True)], ["word", "other"])

    sharded = words.select("word").mapInArrow(spread, "shard string, asks boolean, word string")
    met = sharded.repartition(F.col("shard")).sortWithinPartitions("shard", "asks").mapInArrow(meet, "word string, other string")
    return met.distinct()


def years_of(description: str | None) -> str:
    found = _YEARS.findall(description or "")
    return "-".join(found[:2])


def latin(name: str) -> list[str]:
    """Plain tokens of a name in letters, in order; an abbreviation keeps its point."""
    return [plain(t) for t in _TOKEN.findall(re.sub(r"(?<=[^\W\d_])[-–](?=[^\W\d_])", " ", name))]


# Traditional characters, and the simplified ones at the same places.
TRADITIONAL = "羅義錄葉鵬莊爛問鳳華雲龍馬書畫東長門車貝見風飛魚鳥黃齊龜陳張劉吳趙鄭許蘇蔣賈鄧盧鐘譚鄒陸韋傑強蘭蓮藍蕭藝藥榮樂樓樹橋機歡歷歸殘氣漢湯溫溝潔潛澤濟濤灣燈燦燭爐爾獨獻瑤環瓊當發盡監眾確禮禪種積穩窮競筆節範簡籌紀紅純紙級細紹終經綠維網緒線編緣縣總績繡繼纂續聖聞聰聲職聽肅興舊萬譜說騁鴻銅剛遊鶴論實寧淵綾驥駿齋鐵輝闊馳詞嶺騰關園絲寶嵐閣躍軒鸞錦臺鷺遠穎暉潤學曉記"
SIMPLIFIED = "罗义录叶鹏庄烂问凤华云龙马书画东长门车贝见风飞鱼鸟黄齐龟陈张刘吴赵郑许苏蒋贾邓卢钟谭邹陆韦杰强兰莲蓝萧艺药荣乐楼树桥机欢历归残气汉汤温沟洁潜泽济涛湾灯灿烛炉尔独献瑶环琼当发尽监众确礼禅种积稳穷竞笔节范简筹纪红纯纸级细绍终经绿维网绪线编缘县总绩绣继纂续圣闻聪声职听肃兴旧万谱说骋鸿铜刚游鹤论实宁渊绫骥骏斋铁辉阔驰词岭腾关园丝宝岚阁跃轩鸾锦台鹭远颖晖润学晓记"
_SIMPLE = str.maketrans(TRADITIONAL, SIMPLIFIED)


def han_form(name: str) -> str:
    """A name in Chinese characters without marks, honours and filler."""
    s = _MARKS.sub("", name).translate(_SIMPLE)
    s = re.sub("夫子", "", s) if len(s) > 3 else s
    s = _INNER.sub(r"\1", s)
    t = _HONORS.sub("", s)
    s = t if len(t) >= 2 else s
    return s.replace("之", "") if len(s) > 3 else s


def aliases(text: str | None) -> list[str]:
    """The names in an aliases_json; of texts that aren't arrays, those between semicolons."""
    if not text or text.strip() in ("", "null", "[]"):
        return []
    try:
        value = json.loads(text)
    except ValueError:
        value = re.split(r"[;；|]", text)
    if isinstance(value, str):
        value = [value]
    return [v for v in value if isinstance(v, str) and v.strip()] if isinstance(value, list) else []


NODE = T.StructType([T.StructField("script", T.StringType()), T.StructField("form", T.StringType()), T.StructField("years", T.StringType()), T.StructField("root", T.StringType())])


def parse_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, script, form, years, root, by) for each name of an entity; by is 0 for its own name, 1 for an alias."""
    for key, name, kind, alias, description in rows:
        root = (kind or "").split(".")[0].strip().lower()
        years = years_of(description)
        for by, raw in [(0, name), *((1, a) for a in aliases(alias))]:
            shown = canonical(raw) if raw else None
            if not shown or not shown.strip():
                continue
            if re.search(f"[{_HAN}]", shown):
                form = han_form(shown)
                if not form or by and (len(form) < 3 or re.search("先生|居士|山人", shown)):
                    continue
                if root == "person" and not years and len(form) == 2 and len(_MARKS.sub("", shown)) > 2:
                    form = f"{form}#{key}"  # a given name with an honour and no years: only an alias can tell whose
                yield key, "han", form, years, root, by
            else:
                tokens = [t for t in latin(shown) if t.rstrip(".") not in SUFFIXES]
                if by and ("the" in tokens or any(t.rstrip(".") in TITLES for t in tokens) or any(len(t.rstrip(".")) == 1 for t in tokens)):
                    continue
                tokens = [t for t in tokens if t not in ARTICLES and t.rstrip(".") not in TITLES] or tokens
                if tokens:
                    yield key, "latin", " ".join(tokens), years, root, by


def given_match(a: list[str], b: list[str], formal: dict[str, frozenset[str]], sure: bool) -> bool:
    """Whether given names can be the same person's; initials and cut forms count only if sure (equal known years)."""
    if not a or not b:
        return False
    x, y = a[0].rstrip("."), b[0].rstrip(".")
    if x == y and len(x) > 1:
        return True
    if min(len(x), len(y)) == 1:
        forms = {n[0] for n in (x, y, *formal.get(x, ()), *formal.get(y, ()))} if sure else {x[0], y[0]}
        return len(forms) == 1 or x[0] == y[0]
    if (a[0].endswith(".") and y.startswith(x)) or (b[0].endswith(".") and x.startswith(y)):
        return True
    fx, fy = formal.get(x, frozenset()) | {x}, formal.get(y, frozenset()) | {y}
    if fx & fy:
        return True
    return any(distance(p, q) <= (1 if min(len(p), len(q)) < 7 else 2) and min(len(p), len(q)) > 3 for p in fx for q in fy)


def same_name(a: str, b: str, core_a: str, core_b: str, root: str, sure: bool, formal: dict[str, frozenset[str]]) -> bool:
    """Whether two names with near core tokens mean one thing: of persons' other tokens, however many, each is compared with each."""
    rest_a, rest_b = a.split(" "), b.split(" ")
    rest_a.remove(core_a)
    rest_b.remove(core_b)
    if root == "person":
        if RANKS & set(rest_a) != RANKS & set(rest_b):
            return False
        if not rest_a or not rest_b:
            return sure and rest_a == rest_b
        rest_a, rest_b = list(dict.fromkeys(rest_a)), list(dict.fromkeys(rest_b))
        long_a, long_b = [t for t in rest_a if len(t.rstrip(".")) > 1], [t for t in rest_b if len(t.rstrip(".")) > 1]
        # two equal ones suffice, and a set finds them without comparing each with each
        if {t.rstrip(".") for t in long_a} & {t.rstrip(".") for t in long_b}:
            return True
        some_a, some_b = (long_a, long_b) if long_a and long_b else (rest_a, rest_b)
        return any(given_match([x], [y], formal, sure) for x in some_a for y in some_b)
    (words_a, links_a), (words_b, links_b) = _roles(rest_a), _roles(rest_b)
    if len(words_a) != len(words_b) or any(distance(p, q) > (1 if min(len(p), len(q)) < 5 else 2) for p, q in zip(words_a, words_b, strict=True)):
        return False
    return links_a == links_b or sure and ("?" in links_a or "?" in links_b) or root != "work" and _without_of(links_a) == _without_of(links_b)


def _without_of(links: list[str]) -> list[str]:
    """"Academy of X" is "X Academy"."""
    rest = list(links)
    if "of" in rest:
        rest.remove("of")
    return rest


LINKS = ("of", "for", "and")


def _roles(tokens: list[str]) -> tuple[list[str], list[str]]:
    """Content words and linking words of a title; misspelt linking words are set right, "?" if it isn't clear which."""
    words, links = [], []
    for t in tokens:
        bare = t.rstrip(".")
        if bare and len(bare) < 6 and distance(bare, "the") <= 1:
            continue
        scores = sorted((distance(bare, x), x) for x in LINKS)
        if scores[0][0] == 0 or len(bare) < 4 and scores[0][0] <= 1 or len(bare) < 6 and scores[0][0] <= 1 + (len(bare) > 4):
            links.append("?" if scores[0][0] and scores[1][0] == scores[0][0] else scores[0][1])
        else:
            words.append(bare)
    return words, links


@lru_cache(4)
def common_words(path: str | None = None) -> frozenset[str]:
    """The whole words of at least four letters in a public vocabulary: what every text has is seldom a name's core.

    The list is the same whatever the table, so two names link or don't by themselves alone.
    """
    words = set()
    with open(path or rank_file(), "rb") as lines:
        for line in lines:
            token = base64.b64decode(line.split()[0]).decode("utf-8", "replace")
            if token[:1] == " " and len(token) > 4 and token[1:].isalpha():
                words.add(plain(token[1:]))
    return frozenset(words)


@lru_cache(4)
def _weak(given: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """Common words and given names, and their forms that lack one letter."""
    words = common_words() | given
    return words, frozenset(w[:i] + w[i + 1 :] for w in words if len(w) > 3 for i in range(len(w)))


def link(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """id, group: the entities that mean one person, work, idea, school, event or place share a group (its least id).

    Nodes are distinct (script, plain form, years, root of the type), so exact copies meet once. Names in letters are
    joined on their core (longest token that is no common word): equal cores, or near ones by the trie join over distinct cores; then
    the other tokens are checked in every order, with nicknames, initials, cut and misspelt forms. Names in Chinese
    characters are joined on their form without honours and marks; with one character amiss, or without the family
    name, only if their years are known and equal. Years that are both known and differ forbid a link; a node without
    years that would link nodes of different years links to none of them. Entities with null or empty names stay alone.
    """
    nodes, members = _nodes(entities)
    told = written(_alias_nodes(nodes, members), "name-aliases")
    # an alias that another's years forbid has no part in the names' edges
    nodes = written(nodes.join(told.filter("NOT counts"), "node", "left_anti"), "name-nodes")
    edges = _latin_edges(nodes, forms).unionByName(_han_edges(nodes))
    edges = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "name-edges")
    years = nodes.select(F.col("node"), "years")
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(years.select(F.col("node").alias("b"), F.col("years").alias("near_years")), "b")
    torn = near.filter("near_years <> ''").groupBy("a").agg(F.countDistinct("near_years").alias("n")).join(years.filter("years = ''").select(F.col("node").alias("a")), "a", "left_semi").filter("n > 1").select("a")
    kept = edges.join(torn, "a", "left_anti").join(torn.withColumnRenamed("a", "b"), "b", "left_anti")
    kept = kept.select("a", "b")
    return _groups(members, kept.unionByName(_alias_ties(nodes, members, told, kept)))


def _nodes(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, script, form, years, root) and members (id, node, by)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(parse_rows(zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["id", "script", "form", "years", "root", "by"])

    source = entities.filter(F.col("id").isNotNull() & F.col("canonical_name").isNotNull()).select(F.col("id").cast("bigint"), "canonical_name", "entity_type", "aliases_json", "description").distinct()
    parsed = source.mapInArrow(run, "id bigint, script string, form string, years string, root string, by int")
    node = F.xxhash64("script", "form", "years", "root")
    members = written(parsed.withColumn("node", node).groupBy("id", "node", "script", "form", "years", "root").agg(F.min("by").alias("by")), "name-members")
    return members.select("node", "script", "form", "years", "root").distinct(), members.select("id", "node", "by")


def _latin_edges(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    from pyspark.sql.functions import pandas_udf

    tokens = nodes.filter("script = 'latin'").withColumn("tokens", F.split("form", " "))
    pairs = {(plain(r["form"]), plain(r["formal"])) for r in forms.select("form", "formal").collect() if r["form"] and r["formal"]}
    formal = {f: frozenset(b for a, b in pairs if a == f) for f, _ in pairs}
    given = {x for p in pairs for x in p}

    @pandas_udf(T.StringType())
    def core_of(names):  # noqa: ANN001, ANN202
        import pandas as pd

        weak_words, near = _weak(frozenset(given))
        known: dict[str, bool] = {}

        def strong(token: str) -> bool:
            flag = known.get(token)
            if flag is None:
                # a common word with one letter amiss, or two exchanged, shares with it a form that lacks one letter
                amiss = len(token) > 3 and (token in near or any((t := token[:i] + token[i + 1 :]) in near or t in weak_words for i in range(len(token))))
                flag = known[token] = not token.endswith(".") and token not in weak_words and not amiss
            return flag

        out = []
        for name in names:
            all_tokens = name.split(" ")
            some = [t for t in all_tokens if strong(t)] or [t for t in all_tokens if t not in weak_words and not t.endswith(".")] or all_tokens
            out.append(max(some, key=lambda t: (len(t), t)))
        return pd.Series(out)

    cored = written(tokens.withColumn("core", core_of("form")).drop("tokens", "script"), "name-cores")
    words = cored.select(F.col("core").alias("word")).distinct()
    near = neighbours(words.filter(F.length("word") >= 5))
    cores = near.unionByName(words.select("word", F.col("word").alias("other"))).distinct()
    rest = F.array_except(F.split("form", " "), F.array("core"))
    heads = F.array_distinct(F.flatten(F.transform(rest, lambda t: F.array(F.concat(F.lit("<"), F.substring(t, 1, 1)), F.when(F.length(t) > 2, F.concat(F.lit(">"), F.substring(F.rtrim(t, F.lit(".")), -1, 1)))))))
    formal_rows = [(a, b) for a, b in sorted(pairs)]
    more = forms.sparkSession.createDataFrame(formal_rows or [("", "")], "short string, formal string")
    # a nickname's heads are those of its formal names as well
    nick = cored.select("node", F.explode(F.split("form", " ")).alias("short")).join(F.broadcast(more), "short").groupBy("node").agg(F.flatten(F.collect_set(F.array(F.concat(F.lit("<"), F.substring("formal", 1, 1)), F.concat(F.lit(">"), F.substring("formal", -1, 1))))).alias("extra"))
    keyed = cored.join(nick, "node", "left").withColumn("heads", F.array_union(F.when(F.size(rest) > 0, heads).otherwise(F.array(F.lit("-"))), F.coalesce("extra", F.array().cast("array<string>")))).drop("extra")
    keyed = written(keyed.withColumn("head", F.explode("heads")).filter(F.col("head").isNotNull()).drop("heads"), "name-keys")
    # both sides carry one key: the other side's core, the root, the head, and the years where both are known
    key = lambda core, *more: F.xxhash64(core, "root", "head", *more)
    columns = ["node", "form", "years", "core"]
    told = written(cores.join(keyed, F.col("word") == F.col("core")).select(*columns, "root", "head", "other"), "name-asks")
    met = None
    # dated names meet those of their own years only; undated ones, which are few as equal forms are one node, meet all
    for ask, answer, more in (("years <> ''", "years <> ''", ["years"]), ("years = ''", "years <> ''", []), ("years = ''", "years = ''", [])):
        left = told.filter(ask).select(*[F.col(c).alias(f"{c}_a") for c in columns], F.col("root"), key("other", *more).alias("key"))
        right = keyed.filter(answer).select(*[F.col(c).alias(f"{c}_b") for c in columns], F.col("root").alias("root_b"), key("core", *more).alias("key"))
        part = join_many(left, right, "key").filter("root = root_b")
        part = part.filter("node_a < node_b") if ask == answer else part
        part = part.select("node_a", "form_a", "years_a", "core_a", "node_b", "form_b", "years_b", "core_b", "root")
        met = part if met is None else met.unionByName(part)
    met = met.distinct()

    @pandas_udf(T.BooleanType())
    def same(form_a, form_b, core_a, core_b, root, years_a, years_b):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = zip(form_a, form_b, core_a, core_b, root, years_a, years_b, strict=True)
        return pd.Series([same_name(p, q, x, y, r, bool(u) and u == v, formal) for p, q, x, y, r, u, v in rows], dtype="boolean")

    return met.filter(same("form_a", "form_b", "core_a", "core_b", "root", "years_a", "years_b")).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _han_edges(nodes: DataFrame) -> DataFrame:
    han = nodes.filter("script = 'han'").select("node", "form", "years", "root")
    n = F.length("form")
    exact = F.array(F.concat_ws("|", F.lit("="), "root", "form"))
    # one character amiss, or two exchanged: the forms with one character left out meet
    places = F.sequence(F.lit(1), n)
    left_out = F.transform(places, lambda i: F.concat_ws("|", F.lit("-"), "root", "years", F.concat(F.substring(F.col("form"), F.lit(1), i - 1), F.substring(F.col("form"), i + 1, n))))
    whole = F.array(F.concat_ws("|", F.lit("-"), "root", "years", "form"))
    amiss = F.when((F.col("years") != "") & (n >= 3), F.concat(left_out, whole)).otherwise(F.array().cast("array<string>"))
    # without the family name: the given name of a person of the same years
    two = F.substring("form", 1, 2).isin(sorted(SURNAMES2))
    given = F.when(two, F.substring(F.col("form"), F.lit(3), n)).otherwise(F.substring(F.col("form"), F.lit(2), n))
    partial = F.when((F.col("years") != "") & (F.col("root") == "person"), F.array_compact(F.array(F.concat_ws("|", F.lit("+"), "years", "form"), F.when(F.length(given) >= 2, F.concat_ws("|", F.lit("+"), "years", given))))).otherwise(F.array().cast("array<string>"))
    keyed = han.withColumn("key", F.explode(F.concat(exact, amiss, partial)))
    # a star in each key: all nodes of a key to its least node; the years of exact keys are compared, those of others are equal
    dated = keyed.groupBy("key", "years").agg(F.min("node").alias("first"))
    stars = keyed.join(dated, ["key", "years"]).select(F.col("node").alias("a"), F.col("first").alias("b"))
    undated = dated.filter("key LIKE '=%' AND years = ''").select("key", F.col("first").alias("a"))
    beside = dated.filter("key LIKE '=%' AND years <> ''").select("key", F.col("first").alias("b"))
    return stars.unionByName(undated.join(beside, "key").select("a", "b"))


def _alias_nodes(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """node, span, counts: the nodes whose form is the own name of some entity, with the one known span of years of that form.

    Years count as they do for names. An alias's node has the years of its entity; it counts if it is an own node itself,
    or if the own nodes of its form have one known span of years at most and that is the entity's, or the entity has none.
    """
    named = nodes.join(members.filter("by = 0").select("node").distinct(), "node", "left_semi")
    known = F.when(F.col("years") != "", F.col("years"))
    spans = named.groupBy("script", "form", "root").agg(F.min(known).alias("first"), F.max(known).alias("last"))
    span = F.when(F.col("first") == F.col("last"), F.col("first"))
    single = F.col("first").isNull() | (span.isNotNull() & F.col("years").isin("", F.col("first")))
    met = nodes.join(spans, ["script", "form", "root"]).withColumns({"span": F.when(single, span), "single": single})
    return met.join(named.select("node", F.lit(True).alias("named")), "node", "left").select("node", "span", (F.col("single") | F.coalesce("named", F.lit(False))).alias("counts"))


def _alias_ties(nodes: DataFrame, members: DataFrame, told: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b: an entity's own node and the node of its alias, if that counts; the alias's name edges lead on from there.

    A node without years whose ties and edges lead to different years is tied to none.
    """
    alias = told.filter("counts").select(F.col("node").alias("alias"), "span")
    ties = members.filter("by = 1").select("id", F.col("node").alias("alias")).join(alias, "alias").join(members.filter("by = 0").select("id", "node"), "id")
    ties = written(ties.select(F.col("node").alias("a"), F.col("alias").alias("b"), "span").distinct(), "name-ties")
    near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).join(ties.select("a").distinct(), "a", "left_semi")
    led = near.join(nodes.filter("years <> ''").select(F.col("node").alias("b"), F.col("years").alias("span")), "b").select("a", "span").unionByName(ties.select("a", "span"))
    torn = led.groupBy("a").agg(F.countDistinct("span").alias("n")).filter("n > 1").join(nodes.filter("years = ''").select(F.col("node").alias("a")), "a", "left_semi")
    return ties.join(torn, "a", "left_anti").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of its connected group, for every node of the edges (a, b); no limit of rounds.

    Each round every node points to the least of itself and its neighbours, pointers are jumped (the pointer's pointer)
    until they rest at roots, and the edges are replaced by those between roots, which are fewer by half at least; it
    ends when none is left. A chain of n nodes takes a logarithm of n jumps. Every step is a written table and joins
    spread hot nodes; only whether anything is left reaches the driver.
    """
    links = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    roots = links.select(F.col("a").alias("node")).union(links.select("b")).distinct().withColumn("root", F.col("node"))
    while links.limit(1).count():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("to")), "points")
        while True:
            jumped = join_unique(points, points.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            jumped = written(jumped.select("node", F.coalesce("next", "to").alias("to"), (F.col("next") < F.col("to")).alias("moved")), "points")
            moved = jumped.filter("moved").limit(1).count()
            forget(points)
            points = jumped.select("node", "to")
            points._written_at = jumped._written_at
            if not moved:
                break
        end = lambda df, at: join_unique(df, points.select(F.col("node").alias(at), F.col("to").alias("__to")), at, "left").withColumn(at, F.coalesce("__to", at)).drop("__to")
        kept = written(end(roots, "root"), "roots")
        half = written(end(links, "a"), "links")
        following = written(end(half, "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
        for old in (links, half, points, roots):
            forget(old)
        roots, links = kept, following
    return roots


def _groups(members: DataFrame, edges: DataFrame) -> DataFrame:
    """id, group: the least id of all entities whose names are connected; an entity delivered with two names ties them."""
    own = members.filter("by = 0").select("id", "node")
    ties = own.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z"))
    ties = own.join(ties.filter("a <> z").select("id", "a"), "id").select("a", F.col("node").alias("b"))
    reached = join_unique(own, components(edges.unionByName(ties)), "node", "left").select("id", F.coalesce("root", "node").alias("root")).distinct()
    reached = written(reached, "name-roots")
    return join_unique(reached, reached.groupBy("root").agg(F.min("id").alias("group")), "root", "inner").select("id", "group").distinct()


def classes(groups: DataFrame) -> DataFrame:
    """id, group, n_links: every entity with its group and how many others are in it; in proportion to the data."""
    return join_unique(groups, groups.groupBy("group").agg((F.count(F.lit(1)) - 1).alias("n_links")), "group", "inner")


def pairs(groups: DataFrame) -> DataFrame:
    """id_a, id_b (smaller first): all pairs of a group, as the result's definition asks; large groups are spread over tasks."""
    some = written(classes(groups).filter("n_links > 0").select("id", "group"), "name-groups")
    return join_many(some.withColumnRenamed("id", "id_a"), some.withColumnRenamed("id", "id_b"), "group").filter("id_a < id_b").select("id_a", "id_b")
