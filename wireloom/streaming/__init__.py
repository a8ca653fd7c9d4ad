"""Feeds from streams. Parsing holds no state, so a stream of documents is parsed as a table of them is."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.api import Feeds, parse_documents


def document_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """feed_id (the file's path), content and arrived of the files that appear in a folder."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return files.select(F.col("path").alias("feed_id"), "content", F.col("modificationTime").alias("arrived"))


def parse_stream(docs: DataFrame, content: str = "content", **options) -> Feeds:
    """feeds and entries as streams."""
    return parse_documents(docs, content, **options)


def entries_by_window(entries: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Entries a window of their publishing time and feed; entries later than `late` are not waited for."""
    dated = entries.where("published_ts is not null").withWatermark("published_ts", late)
    return dated.groupBy(F.window("published_ts", width), "feed_id").agg(F.count("*").alias("entries"))
