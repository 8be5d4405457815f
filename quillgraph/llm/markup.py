"""Clean text from HTML, Markdown, wiki and LaTeX residue: one tree for all four, rendered as a page shows it."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, by how they are laid out.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul caption".split())
INLINES = frozenset("a abbr acronym b bdi bdo big button cite code data del dfn em font i img input ins kbd label mark math meter object output picture q ruby rb rp rt s samp select small span strike strong sub sup svg textarea time tt u var wbr br nobr center".split())
HIDDEN = frozenset("script style template noscript head iframe audio video canvas datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
KNOWN = BLOCKS | INLINES | HIDDEN | VOID | {"ref", "references", "nowiki", "col", "colgroup", "option"}
#: An opening tag on the left ends an open element on the right, up to the scope's border.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}), "tbody": ({"tbody", "thead", "tr"}, {"table"}), "option": ({"option"}, {"select"}),
}
MAGIC = re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NOINDEX|INDEX|NOGALLERY|NEWSECTIONLINK|HIDDENCAT)__", re.I)

_SPECIAL = re.compile(r"[<`*_~\[{}\\$\n]|&(?=[#A-Za-z])|!(?=\[)|'(?=')")
#: What a text must have somewhere to be parsed; everything that counts as a construct has one of these.
_ANY = re.compile(r"<[A-Za-z/!?]|&[#A-Za-z]\w*;|`|\*(?=[^\s*)])|\*\*|(?<!\w)_(?=\S)|~~|\[\[|\[\^|\[[^\]\n]*\]\(|\[(?:https?|ftp):|\{[|{\\]|\\[A-Za-z\[(]|\$|''|(?:^|\n)(?:[ ]{0,3}#|=|>|[ \t]*[-+*][ \t]+\S|\||[ \t]*~~~|---)|__[^\s*_~]", re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]{0,14})((?:\s+[^<>]*|/)?)>")
_COMMENT = re.compile(r"<!--.*?(?:-->|$)|<!DOCTYPE[^>]*>|<\?[a-z][^>]*>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_FENCE = re.compile(r"(`{3,}|~{3,})[^\n`]*\n(.*?)(?:\n[ \t]*\1[`~]*[ \t]*(?=\n|$)|$)", re.S)
_TICK = re.compile(r"(`+)([^`\n]+)\1(?!`)")
_STRONG = re.compile(r"(\*\*|__|~~)(?=[^\s*_~])((?:(?!\1)[^\n])+?)(?<=\S)\1")
_EMPH = re.compile(r"(?<![\w*_\\])([*_])(?=[^\s*_)])((?:(?!\1)[^\n])+?)(?<=\S)\1(?![\w*_])")
_IMAGE = re.compile(r"!\[([^\]\n]*)\]\(([^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_LINK = re.compile(r"\[([^\[\]\n]+)\]\(([^()\s]*)(?:\s+\"[^\"\n]*\")?\)")
_NOTE = re.compile(r"\[\^([^\]\s]{1,30})\](:?)[ \t]?")
_WIKILINK = re.compile(r"\[\[([^\[\]|\n]*)(?:\|([^\[\]\n]*))?\]\]")
_OUTLINK = re.compile(r"\[((?:https?|ftp)://[^\s\]]+)(?:\s+([^\]\n]*))?\]", re.I)
_TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
_QUOTES = re.compile(r"('{2,5})(?=[^\s'])([^\n]+?)(?<=[^\s'])\1(?!')")
_DISPLAY = re.compile(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|\$\$(.+?)\$\$", re.S)
_DOLLAR = re.compile(r"\$(?=[^\s$])([^$\n]*?[\\^_{}=][^$\n]*?|[A-Za-z])(?<=\S)\$(?!\d)")
_EQUATION = re.compile(r"\\begin\{(equation\*?|align\*?|displaymath|math|gather\*?|eqnarray\*?)\}(.*?)\\end\{\1\}", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting)\}(.*?)\\end\{\1\}", re.S | re.I)
_ENVIRONMENT = re.compile(r"\\(begin|end)\{([a-z]+\*?)\}(?:\[[^\]\n]*\])?", re.I)
_COMMAND = re.compile(r"\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{")
_BARE = re.compile(r"\\(item|noindent|newline|par|maketitle|tableofcontents|clearpage|newpage|bigskip|medskip|smallskip|centering|ldots|dots|LaTeX|TeX)\b\*?[ \t]?", re.I)
_GROUP = re.compile(r"\{\\(bf|it|em|tt|sc|rm|sl|sf|small|large|Large|huge|bfseries|itshape)\b[ \t]?", re.I)
_ATX = re.compile(r"[ ]{0,3}(#{1,6})[ \t]+(?=\S)")
_UNDERLINE = re.compile(r"(?:={3,}|-{3,})[ \t]*(?=\n|$)")
_WIKIHEAD = re.compile(r"(={2,6})[ \t]*([^=\n][^\n]*?)[ \t]*\1[ \t]*(?=\n|$)")
_BULLET = re.compile(r"([ \t]*)([-+]|\*(?=[ \t]))[ \t]+(?=\S)")
_WIKIBULLET = re.compile(r"(\*+|#+)(?=\[\[|''|\{\{)[ \t]*")
_NUMBERED = re.compile(r"([ \t]*)(\d{1,3})[.)][ \t]+(?=\S)")
_QUOTE = re.compile(r">[ \t]?")
_ROW = re.compile(r"\|(.+)\|[ \t]*(?=\n|$)")
_RULE = re.compile(r"\|?[ \t]*:?-{3,}:?[ \t]*(?:\|[ \t]*:?-{3,}:?[ \t]*)*\|?[ \t]*(?=\n|$)")
_REDIRECT = re.compile(r"#REDIRECT[ \t]*(?=\[\[)", re.I)
_WIKITABLE = re.compile(r"\{\|[^\n]*\n(.*?)(?:\n[ \t]*\|\}|$)", re.S)
_HEADS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "title": 1}
_SILENT = frozenset("label cite citep citet ref eqref pageref bibliography bibliographystyle usepackage documentclass input include index vspace hspace nocite pagestyle".split())
#: Nesting up to which an inner text is scanned at once; deeper ones wait their turn (see parse), so none is cut off.
DEPTH = 24
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Elements that may stand in a document's head; any other one ends it.
_HEAD = frozenset("title meta link base style script template noscript head".split())


def attributes(rest: str) -> dict[str, str]:
    """Names (small letters) and values of a tag's attributes; the first of several equal names counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class Node:
    __slots__ = ("children", "end", "hidden", "info", "items", "name")

    def __init__(self, name: str, end: str = "", info: str = "", hidden: bool = False) -> None:
        self.name, self.end, self.info, self.hidden, self.children, self.items = name, end, info, hidden, [], 0


class Tree:
    """Builds the tree; `end` of an open node says what closes it: "tag", "line", "brace" or "env"."""

    def __init__(self) -> None:
        self.root = Node("root")
        self.stack = [self.root]
        self.found: set[str] = set()
        self.later: list[tuple[Node, str]] = []
        self.count: dict[tuple[str, str], int] = {}  # open nodes by end and name

    def text(self, value: str) -> None:
        if value:
            self.stack[-1].children.append(value)

    def leaf(self, name: str, info: str = "", *children: str) -> None:
        node = Node(name, info=info)
        node.children.extend(children)
        self.stack[-1].children.append(node)

    def open(self, name: str, end: str, info: str = "", hidden: bool = False) -> Node:
        node = Node(name, end, info, hidden)
        self.stack[-1].children.append(node)
        self.stack.append(node)
        for key in ((end, name), (end, "")):
            self.count[key] = self.count.get(key, 0) + 1
        return node

    def cut(self, at: int) -> None:
        """Closes the node at a place of the stack and all within it."""
        for node in self.stack[at:]:
            self.count[node.end, node.name] -= 1
            self.count[node.end, ""] -= 1
        del self.stack[at:]

    def close(self, end: str, name: str | None = None) -> bool:
        if not self.count.get((end, name or "")):
            return False
        for at in range(len(self.stack) - 1, 0, -1):
            node = self.stack[at]
            if node.end == end and (name is None or node.name == name):
                self.cut(at)
                return True
            if end == "line" and node.end != "line":
                return False
        return False

    def tag(self, name: str, closing: bool, rest: str) -> None:
        """One HTML tag, with the end tags that it implies."""
        if closing:
            if name in ("p", "br") and not self.count.get(("tag", name)):
                self.leaf("br")
            else:
                self.close("tag", name)
            return
        if name not in _HEAD and self.count.get(("tag", "head")):
            self.close("tag", "head")
        known = attributes(rest)
        if name in VOID:
            self.leaf(name, "", *([known["alt"]] if name == "img" and "alt" in known else []))
            return
        ends, border = IMPLIED.get(name, (set(), set()))
        if name in BLOCKS and name not in IMPLIED:
            ends = {"p"}
            border = {"td", "th", "li", "table", "div", "blockquote"}
        if any(self.count.get(("tag", x)) for x in ends):
            for at in range(len(self.stack) - 1, 0, -1):
                if self.stack[at].name in border:
                    break
                if self.stack[at].name in ends and self.stack[at].end == "tag":
                    self.cut(at)
                    break
        if rest.endswith("/"):
            self.leaf(name)
            return
        info = name
        if name == "li" and self.count.get(("tag", "ol")):
            above = next((n for n in reversed(self.stack) if n.name in ("ol", "ul", "menu")), None)
            if above is not None and above.name == "ol":
                above.items = int(known["value"]) if known.get("value", "").isdecimal() else above.items + 1
                info = f"{above.items}."
        node = self.open(name, "tag", info, name in HIDDEN or "hidden" in known or bool(_UNSEEN.search(known.get("style", ""))))
        if name == "ol" and known.get("start", "").isdecimal():
            node.items = int(known["start"]) - 1

    def settle(self) -> None:
        """A hidden element that nothing ends hides nothing: these texts are fragments, and its end tag is elsewhere."""
        for node in self.stack[1:]:
            if node.end == "tag":
                node.hidden = False


def parse(text: str) -> Tree:
    """The tree of a text. Inner texts nested beyond DEPTH are scanned after the rest, each below its own node."""
    tree = Tree()
    _scan(tree, text, 0)
    tree.settle()
    while tree.later:
        node, inner = tree.later.pop()
        tree.stack, tree.count = [node], {}
        _scan(tree, inner, 1)
        tree.settle()
    return tree


def _line_start(tree: Tree, s: str, at: int, depth: int) -> int:
    """Constructs that only a line's start can have; the position after them."""
    found = tree.found
    first = s[at : at + 1]
    if first in ("`", "~") and (m := _FENCE.match(s, at)):
        found.add("markdown")
        tree.leaf("pre", "", m[2])
        return m.end()
    if first == "#":
        if m := _REDIRECT.match(s, at):
            found.add("wiki")
            return m.end()
        if m := _ATX.match(s, at):
            found.add("markdown")
            tree.open("h", "line", str(len(m[1])))
            return m.end()
    if first in ("*", "#") and (m := _WIKIBULLET.match(s, at)):
        found.add("wiki")
        tree.open("li", "line", "•")
        return m.end()
    if first == "=" and (m := _WIKIHEAD.match(s, at)):
        found.add("wiki")
        tree.open("h", "line", str(len(m[1])))
        _scan(tree, m[2], depth + 1)
        tree.close("line", "h")
        return m.end()
    if first == ">" and (m := _QUOTE.match(s, at)):
        found.add("markdown")
        tree.open("quote", "line")
        return _line_start(tree, s, m.end(), depth)
    if first == "{" and (m := _WIKITABLE.match(s, at)):
        found.add("wiki")
        _wiki_table(tree, m[1], depth)
        return m.end()
    if first == "|" and (m := _ROW.match(s, at)):
        if rule := _RULE.match(s, at):
            return _line_start(tree, s, rule.end() + 1, depth) if rule.end() < len(s) else rule.end()
        following = m.end() + 1
        earlier = tree.stack[-1].children[-2:]
        in_table = any(isinstance(x, Node) and x.name == "row" for x in earlier)
        if in_table or _RULE.match(s, following):
            found.add("markdown")
            tree.open("row", "")
            _cells(tree, m[1].split("|"), depth)
            return m.end()
    if first in ("-", "+", "*", " ", "\t") and (m := _BULLET.match(s, at)):
        if not s.startswith("- ", m.end()):
            found.add("markdown")
            tree.open("li", "line", "•")
            return m.end()
    elif first.isdecimal() and (m := _NUMBERED.match(s, at)):
        tree.open("li", "line", m[2] + ".")
        return m.end()
    end = s.find("\n", at)
    if end > at and s[end + 1 : end + 4] in ("===", "---") and (m := _UNDERLINE.match(s, end + 1)) and (line := s[at:end]).strip() and (m[0][0] == "=" or len(line) < 120):
        found.add("markdown")
        tree.open("h", "line", "1" if m[0][0] == "=" else "2")
        _scan(tree, line, depth + 1)
        tree.close("line", "h")
        return m.end()
    return at


def _cells(tree: Tree, cells: list[str], depth: int) -> None:
    """The cells of the row just opened; what a cell leaves open ends with it."""
    row = len(tree.stack) - 1
    for cell in cells:
        tree.open("cell", "")
        _scan(tree, cell.strip(), depth + 1)
        tree.cut(min(row + 1, len(tree.stack)))
    tree.cut(min(row, len(tree.stack)))


def _wiki_table(tree: Tree, body: str, depth: int) -> None:
    for row in re.split(r"(?:^|\n)[ \t]*\|-[^\n]*", body):
        cells = [c for line in row.split("\n") if line.strip()[:1] in ("|", "!") for c in re.split(r"\|\||!!", line.strip()[1:])]
        if cells:
            tree.open("row", "")
            _cells(tree, cells, depth)


def _scan(tree: Tree, s: str, depth: int) -> None:
    if depth > DEPTH:
        node = Node("span")
        tree.stack[-1].children.append(node)
        tree.later.append((node, s))
        return
    at = _line_start(tree, s, 0, depth) if depth == 0 else 0
    n = len(s)
    while at < n:
        m = _SPECIAL.search(s, at)
        if not m:
            tree.text(s[at:])
            break
        if m.start() > at:
            tree.text(s[at : m.start()])
        at = m.start()
        after = _at_special(tree, s, at, depth)
        if after > at:
            at = after
        else:
            tree.text(s[at])
            at += 1
    if depth == 0:
        while tree.close("line"):
            pass


def _at_special(tree: Tree, s: str, at: int, depth: int) -> int:
    """Handles the construct that begins at a special character; the position after it, or `at` if there is none."""
    c, found = s[at], tree.found
    if c == "\n":
        while tree.close("line"):
            pass
        tree.text("\n")
        return _line_start(tree, s, at + 1, depth) if depth == 0 else at + 1
    if c == "<":
        if m := _COMMENT.match(s, at):
            found.add("html")
            return m.end()
        m = _TAG.match(s, at)
        if m and (name := m[2].lower()) in KNOWN:
            found.add("wiki" if name in ("ref", "references", "nowiki") else "html")
            if name in ("pre", "script", "style", "textarea", "nowiki") and not m[1]:
                end = re.compile(rf"</{name}\s*>", re.I).search(s, m.end())
                if not end and name in ("script", "style"):
                    return m.end()
                inner, stop = (s[m.end() : end.start()], end.end()) if end else (s[m.end() :], len(s))
                if name in ("pre", "textarea", "nowiki"):
                    tree.leaf("pre" if name == "pre" else "span", "", html.unescape(re.sub(r"</?code[^<>]*>", "", inner)))
                return stop
            tree.tag(name, bool(m[1]), m[3])
            return m.end()
        return at
    if c == "&":
        m = _REFERENCE.match(s, at)
        if m and (value := html.unescape(m[0])) != m[0]:
            found.add("html")
            tree.text(value)
            return m.end()
        return at
    if c == "`":
        if m := _TICK.match(s, at):
            found.add("markdown")
            tree.leaf("code", "", m[2])
            return m.end()
        return at
    if c in "*_~":
        if c == "_" and (m := MAGIC.match(s, at)):
            found.add("wiki")
            return m.end()
        if m := _STRONG.match(s, at) or _EMPH.match(s, at):
            if m[1] == "__" and at and s[at - 1].isalnum():
                return at
            found.add("markdown")
            _scan(tree, m[2], depth + 1)
            return m.end()
        return at
    if c == "!":
        if m := _IMAGE.match(s, at):
            found.add("markdown")
            tree.text(m[1])
            return m.end()
        return at
    if c == "[":
        if m := _WIKILINK.match(s, at):
            found.add("wiki")
            if not re.match(r"\s*(?:Category|Kategorie|Catégorie|Categoría|分类|分類|Категория|File|Image|Datei)\s*:", m[1], re.I):
                _scan(tree, m[2] if m[2] is not None else m[1], depth + 1)
            return m.end()
        if m := _OUTLINK.match(s, at):
            found.add("wiki")
            _scan(tree, m[2] or m[1], depth + 1)
            return m.end()
        if m := _NOTE.match(s, at):
            found.add("markdown")
            if m[2]:
                tree.open("note", "line", m[1])
            return m.end()
        if m := _LINK.match(s, at):
            found.add("markdown")
            _scan(tree, m[1], depth + 1)
            return m.end()
        return at
    if c == "'":
        if m := _QUOTES.match(s, at):
            found.add("wiki")
            _scan(tree, m[2], depth + 1)
            return m.end()
        return at
    if c == "$":
        if m := _DISPLAY.match(s, at) or _DOLLAR.match(s, at):
            found.add("latex")
            tree.leaf("formula" if m[0].startswith("$$") else "math", "", next(x for x in m.groups() if x))
            return m.end()
        return at
    if c == "{":
        if m := _TEMPLATE.match(s, at):
            found.add("wiki")
            shown = [p.strip() for p in m[1].split("|")[1:] if "=" not in p]
            if shown:
                _scan(tree, shown[0], depth + 1)
            return m.end()
        if m := _GROUP.match(s, at):
            found.add("latex")
            tree.open("span", "brace")
            return m.end()
        if tree.count.get(("brace", "")):
            tree.open("braces", "brace")
            return at + 1
        return at
    if c == "}":
        return at + 1 if tree.close("brace") else at
    if c == "\\":
        return _latex(tree, s, at)
    return at


def _latex(tree: Tree, s: str, at: int) -> int:
    found = tree.found
    if at and (s[at - 1].isalnum() or s[at - 1] == ":") and not s[at - 1] > "ʯ" and not _COMMAND.match(s, at):
        return at
    if m := _EQUATION.match(s, at):
        found.add("latex")
        tree.leaf("formula", "", m[2].strip())
        return m.end()
    if m := _VERBATIM.match(s, at):
        found.add("latex")
        tree.leaf("pre", "", m[2].strip("\n"))
        return m.end()
    if m := _ENVIRONMENT.match(s, at):
        found.add("latex")
        if m[1].lower() == "begin":
            tree.open("quote" if "quot" in m[2].lower() else "div", "env", m[2].lower())
        else:
            while tree.stack[-1].end == "line":
                tree.cut(len(tree.stack) - 1)
            tree.close("env")
        return m.end()
    if m := _DISPLAY.match(s, at):
        found.add("latex")
        tree.leaf("formula" if s[at + 1] == "[" else "math", "", next(x for x in m.groups() if x).strip())
        return m.end()
    if m := _COMMAND.match(s, at):
        found.add("latex")
        name = m[1].lower()
        if name in _HEADS:
            tree.open("h", "brace", str(_HEADS[name]))
        elif name in _SILENT:
            tree.open("span", "brace", hidden=True)
        elif name == "footnote":
            tree.open("aside", "brace")
        else:
            tree.open("span", "brace")
        return m.end()
    if m := _BARE.match(s, at):
        found.add("latex")
        if m[1].lower() == "item":
            tree.close("line", "li")
            tree.open("li", "line", "•")
        elif m[1].lower() in ("ldots", "dots"):
            tree.text("…")
        elif m[1].lower() in ("latex", "tex"):
            tree.text(m[1])
        return m.end()
    return at


def _width(s: str) -> int:
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 0 if unicodedata.combining(c) else 1 for c in s)


class Page:
    """Writes the visible text and notes where its blocks lie."""

    def __init__(self, depth: int = 0) -> None:
        self.out: list[str] = []
        self.length, self.depth = 0, depth
        self.ends, self.shown = 0, False  # line ends at the end; whether anything is seen yet
        self.blocks: list[tuple[str, int, int]] = []

    def put(self, s: str) -> None:
        if s:
            self.out.append(s)
            self.length += len(s)
            bare = s.rstrip("\n")
            self.ends = len(s) - len(bare) + (0 if bare else self.ends)
            self.shown = self.shown or not s.isspace()

    def gap(self, lines: int) -> None:
        """At least so many line ends before what follows."""
        if self.shown:
            self.put("\n" * max(0, lines - self.ends))

    def children(self, root: Node) -> None:
        """Writes all that a node shows. Steps wait on a list, not on Python's stack, so no depth is too much."""
        work: list = self.parts(root)[::-1]
        while work:
            step = work.pop()
            if isinstance(step, str):
                self.put(step)
            elif isinstance(step, Node):
                work += self.steps(step)[::-1]
            elif isinstance(step, list):
                work += self.table(step)[::-1]
            else:
                step()

    def parts(self, node: Node) -> list:
        """A node's children, neighbouring table rows as one list; a blank line parts two tables of a Markdown text."""
        out: list = []
        blank = ""
        for kid in node.children:
            row = isinstance(kid, Node) and kid.name in ("row", "tr") and not kid.hidden
            if row and out and isinstance(out[-1], list) and (kid.name == "tr" or blank.count("\n") < 2):
                out[-1].append(kid)
                blank = ""
            elif isinstance(kid, str) and not kid.strip() and out and isinstance(out[-1], list):
                blank += kid
            else:
                out += [blank] if blank else []
                out.append([kid] if row else kid)
                blank = ""
        return out + ([blank] if blank else [])

    def table(self, rows: list[Node]) -> list:
        """The steps of a table with aligned cells; tables nested very deep keep their cells' text without alignment."""
        if self.depth > 20:
            return [x for row in rows for x in (lambda: self.gap(1), *[y for c in row.children if isinstance(c, Node) and not c.hidden for y in (*self.parts(c), "  ")])]
        cells = [[self.flat(c) for c in row.children if isinstance(c, Node) and not c.hidden] for row in rows]
        cells = [r for r in cells if r]
        if not cells:
            return []
        widths = [max(_width(r[k]) for r in cells if k < len(r)) for k in range(max(map(len, cells)))]
        lines = ["  ".join(c + " " * (widths[k] - _width(c)) for k, c in enumerate(r)).rstrip() for r in cells]
        return [lambda: self.gap(1), *self.block("table", "\n".join(lines)), lambda: self.gap(1)]

    def flat(self, node: Node) -> str:
        """A cell's text on one line."""
        page = Page(self.depth + 1)
        page.children(node)
        return re.sub(r"\s+", " ", "".join(page.out)).strip()

    def block(self, kind: str, *steps) -> list:  # noqa: ANN002
        """Steps whose output is noted as a block."""
        start: list[int] = []

        def end() -> None:
            if self.length > start[0]:
                self.blocks.append((kind, start[0], self.length))

        return [lambda: start.append(self.length), *steps, end]

    def steps(self, node: Node) -> list:
        """What writes a node: texts, nodes and calls, in order."""
        name = node.name
        if node.hidden:
            return []
        inner = self.parts(node)
        gap = lambda n: lambda: self.gap(n)
        if name == "br":
            return [gap(1)]
        if name == "hr":
            return [gap(2)]
        if name == "h" or name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            return [gap(2), *self.block(f"heading {(node.info if name == 'h' else '') or name[1]}", *inner), gap(2)]
        if name == "li":
            mark = node.info if node.info not in ("li", "") else "•"
            return [gap(1), *self.block("item", mark + " ", *inner)]
        if name == "pre":
            return [gap(1), *self.block("code", "".join(node.children).strip("\n")), gap(1)]
        if name in ("code", "math", "tt", "kbd", "samp"):
            return self.block("formula" if name == "math" else "code", *inner)
        if name == "formula":
            return [gap(1), *self.block("formula", "".join(node.children).strip()), gap(1)]
        if name in ("quote", "blockquote"):
            return [gap(1), *self.block("quote", *inner), gap(1)]
        if name == "note":
            return self.block("note", *inner)
        if name == "aside" and node.info != "aside":
            return self.block("note", " (", *inner, ")")
        if name == "braces":
            return ["{", *inner, "}"]
        if name in ("p", "table", "ul", "ol", "dl", "section", "article"):
            return [gap(2), *inner, gap(2)]
        if name in BLOCKS:
            return [gap(1), *inner, gap(1)]
        return inner


def render(text: str | None) -> tuple[str | None, list[str], list[tuple[str, int, int]]]:
    """Clean text, the markup languages found, and the blocks (kind, start, end) in the clean text.

    Null gives null without markup; a text without any construct comes out unchanged, whatever signs it has. Headings
    stand on lines of their own, list items begin with a bullet or their number, code and formulas keep their source,
    table cells are aligned; comments, hidden elements, labels and categories aren't shown.
    """
    if text is None:
        return None, [], []
    if not _ANY.search(text):
        return text, [], []
    tree = parse(text)
    if not tree.found:
        return text, [], []
    page = Page()
    page.children(tree.root)
    clean = "".join(page.out)
    lead = len(clean) - len(clean.lstrip("\n"))
    clean = clean.strip("\n") if text.strip("\n") == text else clean
    lead = lead if text.strip("\n") == text else 0
    blocks = [(k, max(0, min(s - lead, len(clean))), max(0, min(e - lead, len(clean)))) for k, s, e in page.blocks]
    return clean, sorted(tree.found), blocks


def cleaned(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, clean, markup (array of languages) and blocks (array of kind, start_pos, end_pos) of every row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start_pos", pa.int32()), ("end_pos", pa.int32())]))
        for batch in batches:
            clean, found, blocks = [], [], []
            for value in batch.column(1).to_pylist():
                c, f, b = render(value)
                clean.append(c)
                found.append(f)
                blocks.append([{"kind": k, "start_pos": s, "end_pos": e} for k, s, e in b])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(blocks, kind)], ["key", "clean", "markup", "blocks"])

    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, clean string, markup array<string>, blocks array<struct<kind:string,start_pos:int,end_pos:int>>"
    return df.select(key, text).mapInArrow(run, schema).withColumnRenamed("key", key)
