"""The shared folder of a cluster, and tables and files written to it.

Executors can be lost at any time, so everything that more than one stage needs is written to the
folder named in ``spark.checkpoint.dir`` (HDFS, an object store or a network disk) and read again:
a lost executor then costs its running tasks, never the work of earlier stages.
"""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

#: Ids broadcast at most.
BROADCAST_IDS = 1_000_000
#: Rows of one key that one task of a join takes.
HOT_ROWS = 20_000
#: Tasks of a stage at most, where their number follows the input.
MOST_TASKS = 20_000
#: Arrow batches sent to Python workers stay under both bounds, unless the session sets its own.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864", str(4 << 20))}

_folders: dict[str, list[str]] = {}


def workdir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one; ``discard`` removes it."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.setdefault(spark.sparkContext.applicationId, []).append(folder)
    return folder


def folders(spark: SparkSession) -> list[str]:
    """Work folders of this application that haven't been discarded."""
    return list(_folders.get(spark.sparkContext.applicationId, ()))


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes work folders, or parts of them, that no result still reads."""
    known = _folders.get(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        if path in known:
            known.remove(path)


def prepare(spark: SparkSession) -> None:
    """For operators with Python workers: sends the package, and keeps Arrow batches small where texts are long.

    Batch sizes that the session has set itself stay.
    """
    ship(spark)
    for key, (default, small) in BATCHES.items():
        if str(spark.conf.get(key, default)).lower() in (default, "64mb"):
            spark.conf.set(key, small)


def tasks_for(amount: int, each: int) -> int:
    """Tasks for an amount of work, at ``each`` a task, or more where that would make too many of them."""
    return max(1, min(-(-amount // each), MOST_TASKS))


def join_hot(left: DataFrame, right: DataFrame, key: str, spread: Column, folder: str, how: str = "inner") -> DataFrame:
    """left joined with right on key, where one key may have any share of left's rows and right has few of each.

    A key of more than HOT_ROWS rows of left is dealt to several tasks by a hash of ``spread``, and its
    rows of right are repeated for each of them. left is counted first and so should be a written table.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > HOT_ROWS)
    hot = materialize(counts.select(key, F.ceil(F.col("_n") / HOT_ROWS).cast("int").alias("_parts")), folder)
    n = hot.count()
    if not n:
        return left.join(right, key, how)
    hot = F.broadcast(hot) if n <= BROADCAST_IDS else hot
    dealt = left.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread), F.coalesce("_parts", F.lit(1))).cast("int"))
    copies = right.join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    return dealt.drop("_parts").join(copies.drop("_parts"), [key, "_part"], how).drop("_part")


#: What workers keep from task to task, by name, with what forgets it.
kept_by_workers: dict[str, Callable[[], None]] = {}


def forget_others(keeps: str) -> None:
    for name, forget in kept_by_workers.items():
        if name != keeps:
            forget()


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidied(run, keeps: str = ""):
    """A function on Arrow batches that frees what other functions keep from task to task, and gives back what a task has freed.

    Python workers are used again, by other stages too, and would hold the peaks of all of them.
    """

    @functools.wraps(run)
    def wrapped(batches):
        forget_others(keeps)
        yield from run(batches)
        give_back()

    return wrapped


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Writes a table into the shared folder and reads it again, which cuts its lineage."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, as Python workers can open it, and the path on it."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")
