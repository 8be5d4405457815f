"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "quillgraph", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session with UTC, AQE and Arrow on; used by tests and the benchmark, a cluster brings its own."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local master may leave it unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), f"quillgraph-{os.getuid()}")
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, folder: str):  # noqa: ANN202
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


_runs: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder; it is deleted when the driver's JVM ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_folder(spark)}/quillgraph/run-{uuid.uuid4().hex}"
        path, files = _path(spark, _runs[app])
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{_runs[app]}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: it cuts the lineage and survives a lost executor.

    With by, the rows are laid in one folder for each of that column's values, so a filter on it reads only those.
    """
    spark = df.sparkSession
    path = scratch(spark, label)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes a table of written() that nothing reads any more."""
    spark, place = df.sparkSession, getattr(df, "_written_at", None)
    if place:
        path, files = _path(spark, place)
        files.delete(path, True)
