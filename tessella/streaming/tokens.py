"""Streams of pages: a folder that files are dropped into, parsed into tokens as they come.

Parsing and text features need a page at a time only, so the stream has no state. Page-wide windows are
computed for each micro-batch, which always holds whole pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import text_features, word_list
from ..operators.dom import parsed_tokens
from ..operators.features import token_features


def stream_pages(spark: SparkSession, folder: str, pattern: str = "*.html", files_per_batch: int = 100) -> DataFrame:
    """(page_id, html) of files as they appear; page_id is the file name."""
    rows = (
        spark.readStream.format("text")
        .option("wholetext", True)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
    )
    return rows.select(F.col("_metadata.file_name").alias("page_id"), F.col("value").alias("html"))


def stream_tokens(pages: DataFrame) -> DataFrame:
    """Tokens with the features of their own text; stateless."""
    rows = parsed_tokens(pages, numbers=()).filter("error is null").withColumn("words", word_list(F.col("text")))
    return rows.withColumns(text_features(F.col("text"), F.col("words"))).drop("words")


def write_features(pages: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """All hundred features of each micro-batch's pages, each batch in a folder of its own so that a repeat overwrites it."""

    def save(batch: DataFrame, number: int) -> None:
        token_features(parsed_tokens(batch), **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return pages.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
