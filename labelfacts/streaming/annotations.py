"""Annotation files as they arrive: each file's response is handled once, by checkpoint and a state of seen names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import extract_expiry
from ..operators.annotations import blocks
from ..sources.readers import ANNOTATIONS


def stream(spark: SparkSession, path: str, files_each: int = 1000) -> DataFrame:
    """Responses with ``arrived``; a name that comes again within a day is dropped, and its state after that."""
    rows = spark.readStream.schema(ANNOTATIONS).option("maxFilesPerTrigger", files_each).json(path).withColumn("arrived", F.current_timestamp())
    return rows.withWatermark("arrived", "1 day").dropDuplicatesWithinWatermark(["file"])


def expiry(responses: DataFrame) -> DataFrame:
    return blocks(responses).select("file", "text", extract_expiry("text").alias("expiry_date"))


def run(rows: DataFrame, out: str, checkpoint: str, of: Callable[[DataFrame], DataFrame] = expiry) -> StreamingQuery:
    """Append to Parquet what is there now, then stop."""
    return of(rows).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
