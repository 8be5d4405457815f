"""Notes as Markdown files with a head: writing, reading, and keeping a table in step with a folder."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.operators.notes import frontmatter, head_text
from quillgraph.session import written
from quillgraph.sources.files import sync_plan

NOTE = "slug string, title string, created_at string, updated_at string, source_docs array<string>, entities array<string>, content string"


def write_notes(notes: DataFrame, folder: str) -> DataFrame:
    """slug, file: writes each note (columns of NOTE) to <folder>/<slug>.md; the folder (a path or URI) is shared by all executors.

    Files are written where the rows are, under another name first and then put in place, so a repeated task leaves the
    same files. Null lists count as empty; a slug that is no plain file name is an error.
    """
    uri = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(uri)
        files.create_dir(root)
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                slug = row["slug"] or ""
                if not slug or slug != os.path.basename(slug) or slug.startswith("."):
                    raise ValueError(f"not a file name: {slug!r}")
                meta = {k: " ".join((row[k] or "").split()) for k in ("title", "slug", "created_at", "updated_at")}
                text = head_text(meta, {"source_docs": row["source_docs"] or [], "entities": row["entities"] or []}, row["content"] or "")
                path = posixpath.join(root, f"{slug}.md")
                draft = f"{path}.{os.getpid()}.part"
                with files.open_output_stream(draft) as f:
                    f.write(text.encode())
                files.move(draft, path)
                made.append((slug, path))
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["slug", "file"])

    columns = [c.split()[0] for c in NOTE.split(", ")]
    return written(notes.select(*columns).mapInArrow(run, "slug string, file string"), "note-files")


def parsed(files: DataFrame) -> DataFrame:
    """NOTE's columns and modified from binary files (path, modificationTime, content); what a head lacks is filled.

    The slug is the head's or else the file's stem, the title the head's or the slug; times are the head's or the file's.
    """
    stem = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    rows = files.select(stem.alias("stem"), F.col("modificationTime").alias("modified"), F.decode("content", "UTF-8").alias("text"))
    read = frontmatter(rows, "stem", "text").join(rows.select("stem", "modified"), "stem")
    meta = lambda k: F.when(F.col("meta")[k] != "", F.col("meta")[k])
    when = F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss")
    many = lambda k: F.coalesce(F.col("lists")[k], F.array().cast("array<string>"))
    slug = F.coalesce(meta("slug"), F.col("stem"))
    return read.select(slug.alias("slug"), F.coalesce(meta("title"), slug).alias("title"), F.coalesce(meta("created_at"), when).alias("created_at"), F.coalesce(meta("updated_at"), when).alias("updated_at"), many("source_docs").alias("source_docs"), many("entities").alias("entities"), F.col("body").alias("content"), "modified")


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes in a folder's .md files, by slug; other files are passed over."""
    return parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)).orderBy("slug")


def merged(known: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The notes after a sync and each file's action: "added", "updated" if the file is newer than the note, else "skipped".

    A note's updated_at is compared as a time in UTC. Notes without a file stay. One full join on the slug.
    """
    there = known.select("slug", F.to_timestamp("updated_at").alias("updated_at"))
    plan = sync_plan(found.select("slug", "modified"), there)
    new = found.join(plan.filter("action <> 'skipped'").select("slug"), "slug", "left_semi")
    columns = [c for c in known.columns if c != "slug"]
    side = new.select("slug", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in columns if c in found.columns])
    both = known.join(side, "slug", "full")
    picked = [F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in found.columns and c != "created_at" else F.coalesce(F.col(c), F.col(f"__{c}")).alias(c) if c in found.columns else F.col(c) for c in columns]
    return both.select("slug", *picked), plan


def sync(spark: SparkSession, folder: str, known: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """known (slug and any of NOTE's columns) brought in step with a folder, and how many files were checked, added, updated, skipped."""
    found = written(read_notes(spark, folder), "notes-read")
    after, plan = merged(known, found)
    counts = {r["action"]: r["count"] for r in plan.groupBy("action").count().collect()}
    return after, {"checked": sum(counts.values()), **{k: counts.get(k, 0) for k in ("added", "updated", "skipped")}}


def sync_stream(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Files that come into a folder are merged into a table of notes; each batch writes the table's next version.

    The newest complete version under `table` is the current state; a batch that is repeated overwrites its own.
    """
    kind = spark.read.format("binaryFile").load(folder).schema
    files = spark.readStream.format("binaryFile").schema(kind).option("pathGlobFilter", "*.md").load(folder)

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        found = parsed(batch)
        try:
            old = session.read.schema(NOTE).parquet(posixpath.join(table, f"v={number - 1}"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = session.createDataFrame([], NOTE)
        merged(old, found)[0].write.mode("overwrite").parquet(posixpath.join(table, f"v={number}"))

    return files.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
