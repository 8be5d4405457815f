"""References to records that don't exist, were removed, or arrive later than what refers to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.plans.skew import WORDS, Bloom, join_unique
from quillgraph.session import written


def references(df: DataFrame, table: str, field: str, parent: str, row_id: str = "id", seen: str = "loaded_at") -> DataFrame:
    """The non-null references of one field: table_name, field_name, row_id, parent, key, seen (earliest delivery).

    Repeated deliveries of a row count once; a row id that was delivered with two values refers to both.
    Null keys are no reference; an empty text is one. Null ids group together; a null delivery time sorts last.
    """
    return (
        df.select(F.col(row_id).cast("bigint").alias("row_id"), F.col(field).cast("string").alias("key"), F.col(seen).alias("seen"))
        .filter(F.col("key").isNotNull())
        .groupBy("row_id", "key")
        .agg(F.min("seen").alias("seen"))
        .select(F.lit(table).alias("table_name"), F.lit(field).alias("field_name"), "row_id", F.lit(parent).alias("parent"), "key", "seen")
    )


def parents(df: DataFrame, parent: str, key: str, removals: DataFrame, seen: str = "loaded_at") -> DataFrame:
    """One row for each key that was delivered or removed: parent, key, first, last, removed (latest removal).

    Only non-null keys count. The union of both logs is aggregated once, so there is no join here.
    """
    kept = df.select(F.col(key).cast("string").alias("key"), F.col(seen).alias("at"), F.lit(None).cast("timestamp_ntz").alias("gone"))
    gone = removals.filter(F.col("table_name") == parent).select(F.col("row_key").alias("key"), F.lit(None).cast("timestamp_ntz").alias("at"), F.col("removed_at").alias("gone"))
    return (
        kept.unionByName(gone)
        .filter(F.col("key").isNotNull())
        .groupBy("key")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"), F.max("gone").alias("removed"), F.max(F.when(F.col("gone").isNull(), 1).otherwise(0)).alias("delivered"))
        .select(F.lit(parent).alias("parent"), "key", "first", "last", "removed", F.col("delivered") == 1)
        .toDF("parent", "key", "first", "last", "removed", "delivered")
    )


def orphans(refs: DataFrame, known: DataFrame, words: int = WORDS) -> DataFrame:
    """References whose record doesn't exist, or exists but first arrives after them: table_name, field_name, row_id, kind, period.

    A Bloom filter of all known parent keys proves most definite orphans without a join ("missing"), at every size:
    `words` bounds what is broadcast at once, and more keys make more filters. Only positives go through the exact join,
    which weeds out the filter's false positives and tells "removed", "missing" and "late" apart; hot parent keys are
    joined there by broadcast of their few rows (see join_unique). period is null if no delivery time is known.
    """
    tag = lambda df: df.withColumn("tagged", F.concat_ws("\u001f", "parent", "key")).drop("parent", "key")
    known = written(tag(known), "parents")
    tested = written(Bloom(known, "tagged", words).test(tag(refs), "tagged"), "references")
    sure, open_ = tested.filter("NOT maybe").withColumn("kind", F.lit("missing")), tested.filter("maybe").drop("maybe")
    joined = join_unique(open_, known, "tagged", "left", tested.count())
    exists = F.coalesce(F.col("delivered"), F.lit(False)) & ~F.coalesce(F.col("removed") > F.col("last"), F.lit(False))
    kind = F.when(~exists, F.when(F.col("removed").isNotNull(), "removed").otherwise("missing")).when(F.col("first") > F.col("seen"), "late")
    found = joined.withColumn("kind", kind).filter(F.col("kind").isNotNull())
    columns = ["table_name", "field_name", "row_id", "kind", F.date_format("seen", "yyyy-MM").alias("period")]
    return found.select(*columns).unionByName(sure.select(*columns))


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted for each table, field, kind and period."""
    return found.groupBy("table_name", "field_name", "kind", "period").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("row_id").alias("n_rows"))
