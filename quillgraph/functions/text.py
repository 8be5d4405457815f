"""Text columns: titles, slugs, markup strips, JSON tiers, tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F



def _accents() -> tuple[str, str]:
    """Small letters with marks of the Latin, Greek and Cyrillic blocks, and what they are without them."""
    marked, bare = [], []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base.isalpha() and c == c.lower() and base == base.lower():
            marked.append(c)
            bare.append(base)
    return "".join(marked), "".join(bare)


#: Letters with accents and their plain forms, for search terms.
ACCENTED, BARE = _accents()
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"[^\p{L}\p{N}]+"


def ascii_lower(text: Column) -> Column:
    """Only A to Z are folded."""
    return F.translate(text, UPPER, LOWER)


def has_text(text: Column, query: str) -> Column:
    """Literal containment without regard to ASCII case; wildcards have no meaning, null texts don't contain."""
    return F.coalesce(F.contains(ascii_lower(text), ascii_lower(F.lit(query))), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def terms(text: Column) -> Column:
    """Search terms in order: lower case, without accents; letters and digits make terms, all else separates."""
    return F.filter(F.split(F.translate(F.lower(text), ACCENTED, BARE), SPLIT), lambda t: t != "")


def title_of(text: Column) -> Column:
    """The first heading of level one in the first 20 lines, else the first line, cut to 200; null if that is empty."""
    lines = F.split(text, "\n")
    heads = F.filter(F.slice(lines, 1, 20), lambda x: x.rlike(r"^#\s+.+"))
    first = F.substring(strip(F.element_at(lines, 1)), 1, 200)
    return F.when(F.size(heads) > 0, strip(F.regexp_extract(F.element_at(heads, 1), r"^#\s+(.+)", 1))).otherwise(F.when(first != "", first))


def slug_of(title: Column, content: Column) -> Column:
    base = F.substring(F.regexp_replace(strip(F.lower(title)), "[^a-z0-9一-鿿]+", "-"), 1, 60)
    return F.concat(base, F.lit("-"), F.substring(F.md5(content), 1, 8))


def note_title(content: Column) -> Column:
    return F.element_at(F.split(strip(F.substring(content, 1, 50)), "\n"), 1)


def html_text(text: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


# What converted books leave behind.
BOOK_RESIDUE = (
    r"(?i)\{\.calibre\d+\}",
    r"(?imd)^(?:ISBN|字数|Word Count)[:\s].*$",
    r"(?id)!\[.*?\]\(.*?\)",
    r"(?id)\[\]\(.*?\)",
    r"(?imd)(?:关注|加入|订阅)\s*.{0,30}(?:频道|群组|telegram|公众号).{0,80}",
)


def without_residue(text: Column) -> Column:
    for pattern in BOOK_RESIDUE:
        text = F.regexp_replace(text, pattern, "")
    return text


def even_space(text: Column) -> Column:
    return strip(F.regexp_replace(text, "\n{3,}", "\n\n"))


def json_in(text: Column) -> Column:
    """The JSON object in a model's answer: the text itself, else a fenced block, else from the first to the last brace."""
    # How a fenced block and an object are told.
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1)
    braced = F.regexp_extract(text, r"\{[\s\S]*\}", 0)
    valid = lambda c: F.when(F.json_object_keys(c).isNotNull(), c)
    return F.coalesce(valid(strip(text)), valid(strip(fenced)), valid(braced))
