"""Joins that keep a hot key from ending in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import written

#: A key that holds more than one row in SHARE is hot; by counting, there are fewer than SHARE such keys.
SHARE = 500
#: Rows that one task takes without harm, be they all of one key; a smaller table isn't counted by key.
FEW = 50_000


def hot_keys(df: DataFrame, key: str, total: int | None = None) -> dict:
    """The keys that hold more than 1/SHARE of df's rows (or of total) with their counts: fewer than SHARE, whatever the data.

    A table of FEW rows or less has none, as no key of it can burden a task.
    """
    total = df.count() if total is None else total
    if total <= FEW:
        return {}
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).count()
    return {r[0]: r[1] for r in counts.filter(F.col("count") * SHARE > F.lit(total)).collect()}


def join_unique(left: DataFrame, right: DataFrame, key: str, how: str = "left", total: int | None = None) -> DataFrame:
    """left joined to right, which has each key at most once; hot keys of left don't meet in one task.

    Keys with more than 1/SHARE of left's rows are counted exactly (partial counts before the shuffle). They are fewer
    than SHARE, so their rows of right are broadcast; all other keys go through the ordinary shuffled join, where no
    key holds more than 1/SHARE of the rows. Null keys take neither join and keep null columns (how="left") or vanish
    (how="inner"). total is left's number of rows if it is known, or a number of that order.
    """
    hot = list(hot_keys(left, key, total))
    more = [c for c in right.columns if c != key]
    known = left.filter(F.col(key).isNotNull())
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    parts = [known.filter(~is_hot).join(right, key, how)] if hot else [known.join(right, key, how)]
    if hot:
        parts.append(known.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how))
    if how == "left":
        null = left.filter(F.col(key).isNull())
        for c in more:
            null = null.withColumn(c, F.lit(None).cast(right.schema[c].dataType))
        parts.append(null)
    columns = [*left.columns, *more]
    out = parts[0].select(*columns)
    for p in parts[1:]:
        out = out.unionByName(p.select(*columns))
    return out


def join_many(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join where keys may repeat on both sides; a key that is hot on either side is spread over many tasks.

    The rows of a hot key are laid in as many blocks as it holds 1/SHARE of its side's rows, by a hash of the whole row,
    and meet every block of the other side, which is repeated for that. Both sides should be written tables, as they
    are read twice. Null keys vanish.
    """
    spark = left.sparkSession
    sides = [hot_keys(left, key), hot_keys(right, key)]
    if not any(sides):
        return left.join(right, key)
    blocks = []
    for df, hot in zip((left, right), sides, strict=True):
        total = sum(hot.values()) and df.count()
        blocks.append({k: max(1, -(-n * SHARE // total)) for k, n in hot.items()})
    table = spark.createDataFrame([(k, blocks[0].get(k, 1), blocks[1].get(k, 1)) for k in {*blocks[0], *blocks[1]}], f"`{key}` {left.schema[key].dataType.simpleString()}, __l long, __r long")

    def laid(df: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        spread = df.join(F.broadcast(table), key, "left").withColumns({own: F.coalesce(own, F.lit(1)), other: F.coalesce(other, F.lit(1))})
        return spread.withColumns({mine: F.pmod(F.xxhash64(*df.columns), own), theirs: F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))}).drop(own, other)

    met = laid(left, "__l", "__r", "__i", "__j").join(laid(right, "__r", "__l", "__j", "__i"), [key, "__i", "__j"])
    return met.drop("__i", "__j")


#: Bits that one key sets in its word of a Bloom filter, keys that share a word on average, and words of one filter: at
#: most so many rows (16 bytes each) are broadcast at once, whatever the number of keys.
BITS, KEYS, WORDS = 4, 4, 1 << 21


class Bloom:
    """A Bloom filter of the values of one column, laid in 64-bit words and, beyond `words` of them, in several filters.

    A key's hash gives its filter, its word there and BITS bits of that word. Everything is built-in expressions: the
    words are made by bit_or (partial before the shuffle) and written as a table; test() joins one filter at a time by
    broadcast, which has `words` rows at most. Null keys are in no filter. Of the keys that aren't there, about one in
    a hundred passes.
    """

    def __init__(self, keys: DataFrame, key: str, words: int = WORDS, n_keys: int | None = None) -> None:
        n = keys.count() if n_keys is None else n_keys
        need = max(1, -(-n // KEYS))
        self.n_filters = -(-need // words)
        self.n_words = min(words, need)
        known = keys.filter(F.col(key).isNotNull()).select(*self.place(key))
        self.table = written(known.groupBy("__filter", "__word").agg(F.bit_or("__mask").alias("__bits")), "bloom", "__filter")

    def place(self, key: str) -> list[Column]:
        """Filter, word and bits of a key's hash."""
        h, g = F.xxhash64(F.col(key)), F.xxhash64(F.col(key), F.lit(7))
        mask = F.expr("0L")
        for i in range(BITS):
            mask = mask.bitwiseOR(F.call_function("shiftleft", F.expr("1L"), F.shiftright(g, 6 * i).bitwiseAND(63).cast("int")))
        return [F.pmod(h, F.lit(self.n_filters)).cast("int").alias("__filter"), F.pmod(F.shiftrightunsigned(h, 20), F.lit(self.n_words)).alias("__word"), mask.alias("__mask")]

    def test(self, rows: DataFrame, key: str, name: str = "maybe") -> DataFrame:
        """rows with a boolean column: false only if the key is surely not among the filter's keys.

        With several filters the rows are first laid apart by filter (written, not shuffled), so each is read once.
        """
        placed = rows.select("*", *self.place(key))
        if self.n_filters > 1:
            placed = written(placed, "bloom-rows", "__filter")
        out = None
        for at in range(self.n_filters):
            mine = placed.filter(F.col("__filter") == at) if self.n_filters > 1 else placed
            words = self.table.filter(F.col("__filter") == at).select("__word", "__bits")
            hit = F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
            part = mine.join(F.broadcast(words), "__word", "left").select(*rows.columns, (hit & F.col(key).isNotNull()).alias(name))
            out = part if out is None else out.unionByName(part)
        return out


def in_order(rows: DataFrame, column: str, *order: str, first: int = 0) -> DataFrame:
    """rows with their number in an order, from `first`; ranges are sorted apart, so no task sees the whole table.

    The rows are written once; what is summed up in one place are the ranges' sizes, one row a partition.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    spread = written(spread, "numbered")
    sizes = spread.groupBy("__p").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = spread.join(F.broadcast(before.select("__p", "__first", "__before")), "__p")  # one row a partition
    return placed.withColumn(column, (F.lit(first) + F.col("__before") + F.col("__i") - F.col("__first")).cast("long")).drop("__p", "__i", "__first", "__before")
