"""The incremental behaviours as Structured Streaming: trace counters and replaced documents (note files: sources.note_files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.session import scratch, written
from quillgraph.sources.files import replace_by_path


def trace_counts(spark: SparkSession, folder: str, glob: str, out: str, checkpoint: str | None = None) -> StreamingQuery:
    """Footprint counts by user and source over event files as they come, written to a Parquet folder a batch.

    Counters are kept in the state store and written in update mode through foreachBatch, so a batch that is repeated
    after a failure replaces its own folder.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    kind = F.col("event_type")
    events = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)
    log = events.select("user_id", F.when(kind == "purchase", "record").when(kind.isin("view", "click"), "navigate").otherwise("search").alias("source"), "ts")
    counts = log.groupBy("user_id", "source").agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_seen"))

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return counts.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start()


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The newest counter of each user and source among the batches written."""
    rows = spark.read.parquet(out)
    return rows.groupBy("user_id", "source").agg(F.max_by("count", "batch").alias("count"), F.max("last_seen").alias("last_seen"))


#: Folders that a table kept by ingest_stream has; a batch rewrites only those its paths fall in.
BUCKETS = 64


def ingest_stream(stream: DataFrame, table: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Documents that come again by path replace their older rows; a batch rewrites only the buckets that its paths fall in.

    A row's bucket is a hash of its path. Each touched bucket is written as a new version named after the batch, and
    the newest version of each bucket is the current state (see ingested), so a batch that fails or is repeated leaves
    or makes the same table.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = written(batch.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")), "batch")
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most `buckets`
        old = _newest(spark, table, number, touched)
        after = rows.drop("bucket") if old is None else replace_by_path(old, rows.drop("bucket"))
        placed = after.withColumn("bucket", F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int"))
        placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{table}/v={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, table: str, before: int | None, buckets: list[int] | None) -> DataFrame | None:
    """The rows of the newest version (before a batch) of each bucket; only the folders' names are looked at to find them."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    newest: dict[int, int] = {}
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{table}/v=*/bucket=*")) if fs.exists(root) else None
    for status in found or []:
        place = status.getPath()
        bucket, version = int(place.getName()[7:]), int(place.getParent().getName()[2:])
        done = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(place.getParent(), "_SUCCESS"))
        if done and (before is None or version < before) and (buckets is None or bucket in buckets):
            newest[bucket] = max(newest.get(bucket, -1), version)
    if not newest:
        return None
    return spark.read.parquet(*[f"{table}/v={v}/bucket={b}" for b, v in sorted(newest.items())])


def ingested(spark: SparkSession, table: str) -> DataFrame | None:
    """The current state of a table kept by ingest_stream; None before its first batch."""
    return _newest(spark, table, None, None)
