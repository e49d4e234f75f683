"""Scans: HTML folders, token files, label files, artifacts and metric logs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.features import FEATURES, NULL_FEATURES
from .files import SharedFile
from .paths import current_version

PAGE_SCHEMA = T.StructType([T.StructField("filename", T.StringType()), T.StructField("content", T.StringType())])
#: A token record: text, position, all numeric fields, and meta.
TOKEN_SCHEMA = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("position", T.LongType()),
        *[T.StructField(f, T.DoubleType()) for f in (*FEATURES, *NULL_FEATURES)],
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    ]
)
METRIC_SCHEMA = "timestamp string, logger string, method string, status_code int, duration_ms int, duration_readable string, message string"


def read_html(spark: SparkSession, folder: str, pattern: str = "*.html", limit: int | None = None, ordered: bool = False) -> DataFrame:
    """(filename, content) of the folder's own files, in order of their names if limited or asked. A missing folder raises."""
    rows = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    pages = rows.select(F.col("_metadata.file_name").alias("filename"), F.col("value").alias("content"))
    pages = pages.orderBy("filename") if limit or ordered else pages
    return pages.limit(limit) if limit else pages


def read_tokens(spark: SparkSession, path: str, labelled: bool = False, tolerant: bool = False) -> DataFrame:
    """Token records of JSON lines; with labels only if asked, and without the lines that aren't JSON if tolerant."""
    schema = T.StructType([*TOKEN_SCHEMA.fields, T.StructField("label", T.StringType())])
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)
    return rows.filter(F.col("label").isNotNull()) if labelled else rows


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and quoted line feeds, by a schema that is never inferred."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', schema=schema)


def read_artifact(spark: SparkSession, path):
    """A small JSON file, or its newest version: feature keys, selected features or label ids."""
    return json.loads(SharedFile(spark, current_version(spark, path)).read())


def read_metrics(spark: SparkSession, path: str, method: str | None = None) -> DataFrame:
    """Metric log lines of a file or folder, of one method if named."""
    rows = spark.read.schema(METRIC_SCHEMA).json(path)
    return rows.filter(F.col("method") == method) if method else rows


def from_token_json(rows: DataFrame, column: str = "value") -> DataFrame:
    """Token records of a column of JSON texts."""
    return rows.select(F.from_json(column, TOKEN_SCHEMA).alias("t")).select("t.*")


def to_token_json(rows: DataFrame) -> DataFrame:
    """One JSON text a record, with null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value"))
