"""Readers of the Parquet tables, raw and as the model sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as delivered, every delivery included."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def last_delivery(df: DataFrame, key: str, *more: str) -> DataFrame:
    """One row for each key: of several deliveries the latest; equal times are decided by the columns in more.

    Deliveries are few for each key, so a max_by over a struct (partial on the map side) serves; no window sort.
    Null keys form one group. A table without rows gives none.
    """
    rest = [c for c in df.columns if c != key]
    order = F.struct(F.col("loaded_at"), *[F.col(c) for c in more])
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(key, "__r.*").select(*df.columns)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
