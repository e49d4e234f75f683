"""Sessions, and this package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no shared folder, as in tests on one machine.
LOCAL_FALLBACK = "file:///tmp/checkpoints/tessella"

_shipped: set[str] = set()


def build_session(app: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times and adaptive plans; conf keys are given with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    builder = builder.config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once for each application.

    Python workers import functions by name, and an executor need not have the package installed.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tessella-")) / "tessella_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, f"{root.name}/{path.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; without one, a local folder if all executors are in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or LOCAL_FALLBACK).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Removes a work folder on any file system that Spark reaches."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Shuffle files of queries that run inside go when their query ends, and not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt over all cores, where they come from files too few and too small to occupy them; else as they are."""
    if rows.isStreaming:
        return rows
    spark, context = rows.sparkSession, rows.sparkSession.sparkContext
    cores, files = context.defaultParallelism, rows._jdf.inputFiles()  # the names stay in the JVM: there can be very many
    if not len(files) or len(files) >= cores:
        return rows
    size = 0
    for file in files:
        path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(file))
        size += path.getFileSystem(context._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    split = context._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    return rows if size >= cores * split else rows.repartition(cores)
