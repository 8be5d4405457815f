"""Time texts of many tools and zones, brought to one instant in UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.plans.skew import join_unique
from quillgraph.session import written

# Month names by language, as tools print them.
MONTHS = {
    "jan": 1, "january": 1, "janvier": 1, "januar": 1, "enero": 1, "feb": 2, "february": 2, "février": 2, "fevrier": 2, "februar": 2, "febrero": 2,
    "mar": 3, "march": 3, "mars": 3, "märz": 3, "marzo": 3, "apr": 4, "april": 4, "avril": 4, "abril": 4, "may": 5, "mai": 5, "mayo": 5,
    "jun": 6, "june": 6, "juin": 6, "juni": 6, "junio": 6, "jul": 7, "july": 7, "juillet": 7, "juli": 7, "julio": 7,
    "aug": 8, "august": 8, "août": 8, "aout": 8, "agosto": 8, "sep": 9, "sept": 9, "september": 9, "septembre": 9, "septiembre": 9,
    "oct": 10, "october": 10, "octobre": 10, "oktober": 10, "octubre": 10, "nov": 11, "november": 11, "novembre": 11, "noviembre": 11,
    "dec": 12, "december": 12, "décembre": 12, "decembre": 12, "dezember": 12, "diciembre": 12, "okt": 10, "dez": 12,
}
# Minutes east of UTC of abbreviations, where the writer's zone doesn't use them itself.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "IST": 330, "NPT": 345, "CST": -360, "CDT": -300, "EST": -300, "EDT": -240, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "NST": -210, "NDT": -150,
    "AST": -240, "ADT": -180, "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780, "HKT": 480, "SGT": 480,
}

EPOCH = datetime(1970, 1, 1)
_TIME = r"(?P<H>\d{1,2}):(?P<M>\d{2})(?::(?P<S>\d{2})(?:[.,](?P<f>\d{1,9}))?)?"
_HALF = r"(?:\s?(?P<half>[AaPp]\.?[Mm]\.?))?"
_ZONE = r"(?:\s*(?P<zone>Z|[+-]\d{2}:?\d{2}(?::\d{2})?|[+-]\d{1,2}|(?:UTC|GMT)[+-]\d{1,2}(?::?\d{2})?|[A-Z]{2,5})?\s*(?:\[[^\]]+\])?)"
_FORMS = [
    re.compile(p)
    for p in (
        rf"(?P<y>\d{{4}})[-/.](?P<m>\d{{1,2}})[-/.](?P<d>\d{{1,2}})(?:[T ]\s*{_TIME}{_HALF}{_ZONE})?",
        rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})[T ]?(?P<H>\d{{2}})(?P<M>\d{{2}})(?P<S>\d{{2}})?(?:[.,](?P<f>\d{{1,9}}))?{_ZONE}",
        rf"(?P<a>\d{{1,2}})/(?P<b>\d{{1,2}})/(?P<y>\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?",
        rf"(?P<d>\d{{1,2}})\.\s?(?P<m>\d{{1,2}})\.\s?(?P<y>\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?",
        rf"(?:\w{{2,9}}\.?,\s*)?(?P<d>\d{{1,2}})\.?\s(?P<name>[^\W\d_]+)\.?,?\s(?P<y>\d{{4}})(?:,?\s+(?:{_TIME}|(?P<H2>\d{{1,2}})\s?h\s?(?P<M2>\d{{2}})?){_HALF}{_ZONE})?",
        rf"(?:\w{{2,9}}\.?,\s*)?(?P<name>[^\W\d_]+)\.?\s(?P<d>\d{{1,2}}),?\s(?P<y>\d{{4}})(?:,?\s+{_TIME}{_HALF}{_ZONE})?",
        r"(?P<y>\d{4})年(?P<m>\d{1,2})月(?P<d>\d{1,2})日\s*(?:(?P<half>上午|下午|午前|午後|凌晨|晚上)?\s*(?P<H>\d{1,2})(?::|：|时|時|点)(?P<M>\d{1,2})?(?:(?::|：|分)(?P<S>\d{1,2})?秒?)?)?",
    )
]
_NUMBER = re.compile(r"(-?)(\d{1,19})(?:\.(\d+))?")


@lru_cache(4096)
def _zone(name: str | None) -> ZoneInfo | timezone:
    try:
        return ZoneInfo(name) if name else timezone.utc
    except Exception:  # an unknown zone name
        return timezone.utc


@lru_cache(65536)
def _abbreviation(zone: str | None, text: str, year: int) -> int | None:
    """Minutes east of UTC of an abbreviation: as the writer's zone uses it in that year, else as commonly used."""
    at = _zone(zone)
    for month in range(1, 13):
        moment = datetime(year, month, 15, 12, tzinfo=at)
        if moment.tzname() == text:
            return round(moment.utcoffset().total_seconds() / 60)
    return ABBREVIATIONS.get(text)


def _offset(text: str, zone: str | None, year: int) -> int | None:
    text = text.strip()
    if text in ("Z", "UTC", "GMT") and text != "GMT":
        return 0
    m = re.fullmatch(r"(?:UTC|GMT)?([+-])(\d{1,2})(?::?(\d{2}))?(?::\d{2})?", text)
    if not m:
        return _abbreviation(zone, text, year)
    hours, minutes = int(m[2]), int(m[3] or 0)
    return None if hours > 18 or minutes > 59 else (hours * 60 + minutes) * (-1 if m[1] == "-" else 1)


def parse_instant(text: str | None, zone: str | None, day_first: bool | None) -> int | None:
    """Microseconds since 1970-01-01 UTC that a text names, or None.

    Null, empty, worded or impossible times (month 13, 30 February, hour 27) give None. A zone or offset in the text
    prevails; otherwise it is wall time in zone (unknown or null zones count as UTC): a repeated hour is its first
    pass, a skipped one is read with the offset before the change (both are fold 0). Digits past microseconds are cut.
    """
    if text is None:
        return None
    s = text.strip()
    if not s:
        return None
    m = _NUMBER.fullmatch(s)
    if m and not (len(m[2]) == 14 and m[2][:2] in ("19", "20")):
        return _number(m)
    for form in _FORMS:
        m = form.fullmatch(s)
        if m:
            return _instant(m.groupdict(), zone, day_first)
    return None


def _number(m: re.Match) -> int | None:
    sign, whole, rest = m.groups()
    n = len(whole)
    if n < 9 or (rest and n > 13):
        return None
    scale = 6 if n <= 11 else 3 if n <= 14 else 0 if n <= 17 else -3
    micros = int(whole) * 10**scale if scale >= 0 else int(whole) // 1000
    if rest and scale > 0:
        micros += int((rest + "000000")[:scale])
    return -micros if sign else micros


def _instant(g: dict, zone: str | None, day_first: bool | None) -> int | None:
    if g.get("a"):
        g["d"], g["m"] = (g["a"], g["b"]) if day_first else (g["b"], g["a"])
    month = MONTHS.get(g["name"].lower()) if g.get("name") else int(g["m"])
    hour, minute = int(g.get("H") or g.get("H2") or 0), int(g.get("M") or g.get("M2") or 0)
    half = (g.get("half") or "").lower().replace(".", "")
    if half in ("am", "pm"):
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + 12 * (half == "pm")
    elif half in ("上午", "午前", "凌晨") and hour == 12:
        hour = 0
    elif half in ("下午", "午後", "晚上") and hour < 12:
        hour += 12
    try:
        wall = datetime(int(g["y"]), month or 0, int(g["d"]), hour, minute, int(g.get("S") or 0), int(((g.get("f") or "") + "000000")[:6]))
    except ValueError:
        return None
    if g.get("zone"):
        minutes = _offset(g["zone"], zone, wall.year)
        if minutes is None:
            return None
        utc = wall - timedelta(minutes=minutes)
    else:
        try:
            utc = wall.replace(tzinfo=_zone(zone)).astimezone(timezone.utc).replace(tzinfo=None)
        except (OverflowError, ValueError):
            return None
    gap = utc - EPOCH
    return (gap.days * 86400 + gap.seconds) * 1_000_000 + gap.microseconds


@F.pandas_udf(T.LongType())
def _parse(text: pd.Series, zone: pd.Series, day_first: pd.Series) -> pd.Series:
    cells = zip(text, zone, day_first, strict=True)
    return pd.Series([parse_instant(t, z if isinstance(z, str) else None, d is True or d == 1) for t, z, d in cells], dtype="Int64")


DICTIONARY = "text string, tz_name string, day_first boolean, utc_micros bigint, word binary"
#: Goes up when the reading of texts changes, so that a store of older readings is left alone.
READING = 2


def _word(text: Column) -> Column:
    """128 bits that stand for a text with its zone and order of day and month, null for a null text."""
    return F.when(text.isNotNull(), F.unhex(F.md5(F.concat_ws("\u001f", text, "tz_name", F.col("day_first").cast("string")))))


def dictionary(pairs: DataFrame, store: str | None = None) -> DataFrame:
    """Each distinct (text, tz_name, day_first), parsed once: DICTIONARY's columns; null texts are left out.

    With a store, a Parquet folder that stays, only triples that it lacks are parsed and appended; then all of it is
    returned. A triple that two writers or a repeated append have brought twice has the same reading and counts once.
    """
    spark = pairs.sparkSession
    zoned = pairs.filter(F.col("text").isNotNull()).select("text", F.coalesce("tz_name", F.lit("")).alias("tz_name"), F.coalesce("day_first", F.lit(False)).alias("day_first"))
    distinct = zoned.withColumn("word", _word(F.col("text"))).groupBy("word").agg(F.min(F.struct("text", "tz_name", "day_first")).alias("t")).select("t.*", "word")
    parsed = lambda df: df.select("text", "tz_name", "day_first", _parse("text", "tz_name", "day_first").alias("utc_micros"), "word")
    if store is None:
        return parsed(distinct)
    folder = f"{store}/reading-{READING}"
    try:
        distinct = distinct.join(spark.read.schema(DICTIONARY).parquet(folder).select("word"), "word", "left_anti")
    except Exception as e:  # the store's first use
        if "PATH_NOT_FOUND" not in str(e):
            raise
    parsed(distinct).write.mode("append").parquet(folder)
    return stored(spark, store)


def stored(spark: SparkSession, store: str) -> DataFrame:
    """A store's triples, each once."""
    known = spark.read.schema(DICTIONARY).parquet(f"{store}/reading-{READING}")
    return known.groupBy("word").agg(F.min(F.struct("text", "tz_name", "day_first", "utc_micros")).alias("t")).select("t.*", "word")


def normalise(rows: DataFrame, writers: DataFrame, store: str | None = None, text: str = "raw_time") -> DataFrame:
    """rows with utc_micros: their time text read with their writer's zone and order of day and month.

    rows needs writer_id and the text column. writers is the fixed list of writers (one small row each, by contract
    of the data; it is joined without a hint, so Spark broadcasts it only while its size is known to be small). Rows
    are joined back to the dictionary by a digest of text, zone and order; a text that very many rows share ("n/a") is
    met by join_unique's split of hot keys. Rows without a writer are read as UTC, month first; a null text gives null.
    """
    zoned = rows.join(writers.select("writer_id", "tz_name", "day_first").dropDuplicates(["writer_id"]), "writer_id", "left").withColumns({"tz_name": F.coalesce("tz_name", F.lit("")), "day_first": F.coalesce("day_first", F.lit(False))})
    zoned = written(zoned.withColumn("__word", _word(F.col(text))), "times")
    words = dictionary(zoned.select(F.col(text).alias("text"), "tz_name", "day_first"), store)
    left = zoned.drop("tz_name", "day_first")
    return join_unique(left, words.select(F.col("word").alias("__word"), "utc_micros"), "__word", "left").drop("__word")
