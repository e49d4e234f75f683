"""Sinks: JSON lines, CSV, artifacts, reports and metric logs."""

from __future__ import annotations

import functools
import json
import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StructType

from ..operators.evaluate import split_predictions
from .files import SharedFile


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON texts."""
    nested = {f.name for f in rows.schema.fields if isinstance(f.dataType, (MapType, ArrayType, StructType))}
    flat = rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in rows.columns])
    flat.write.mode("overwrite").csv(path, header=True, escape='"')


def feature_keys(rows: DataFrame) -> list[str]:
    """The double columns, from the schema."""
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, DoubleType)]


def write_artifact(spark: SparkSession, value, path) -> None:
    SharedFile(spark, path).write(json.dumps(value, ensure_ascii=False, indent=2))


def write_label_ids(ids: DataFrame, path) -> None:
    """A JSON object from label to id; there is a row a class."""
    write_artifact(ids.sparkSession, {r.label: r.id for r in ids.orderBy("id").collect()}, path)


def write_distribution(distribution: DataFrame, path: str) -> None:
    """Lines ``label: count``, the most frequent first."""
    rows = distribution.orderBy(F.desc("n"), "label").select(F.concat("label", F.lit(": "), F.col("n").cast("string")).alias("value"))
    rows.coalesce(1).write.mode("overwrite").text(path)


def write_predictions(rows: DataFrame, folder: str) -> None:
    """text and predicted_label of the default class, of the others, and of all."""
    for name, part in split_predictions(rows).items():
        write_csv(part.select("text", "predicted_label"), f"{folder}/{name}")


def write_truth_skeleton(rows: DataFrame, path: str) -> None:
    """The texts to be labelled by hand."""
    write_csv(rows.select("text"), path)


class MetricLog:
    """Logs a JSON line for each call of a decorated function: status 200 or 500, and its duration.

    Stores of clusters don't append to files, so every ``lines`` lines make a file of their own in the folder,
    which ``read_metrics`` reads as one table. ``close`` writes what is left.
    """

    def __init__(self, spark: SparkSession, folder, logger: str = "tessella", lines: int = 1):
        self.spark, self.folder, self.logger, self.lines = spark, str(folder).rstrip("/"), logger, lines
        self.waiting: list[str] = []

    def append(self, method: str, status: int, seconds: float, message: str = "") -> None:
        line = {
            "timestamp": datetime.now().isoformat(timespec="seconds"), "logger": self.logger, "method": method, "status_code": status,
            "duration_ms": round(1000 * seconds), "duration_readable": f"{seconds:.2f}s", "message": message,
        }
        self.waiting.append(json.dumps(line, ensure_ascii=False))
        if len(self.waiting) >= self.lines:
            self.close()

    def close(self) -> None:
        if self.waiting:
            SharedFile(self.spark, f"{self.folder}/{time.time_ns()}-{uuid.uuid4().hex}.json").write("\n".join(self.waiting) + "\n")
            self.waiting = []

    def timed(self, function):
        @functools.wraps(function)
        def call(*args, **kwargs):
            began = time.monotonic()
            try:
                out = function(*args, **kwargs)
            except Exception as e:
                self.append(function.__name__, 500, time.monotonic() - began, str(e))
                raise
            self.append(function.__name__, 200, time.monotonic() - began)
            return out

        return call
