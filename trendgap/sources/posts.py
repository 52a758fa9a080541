"""Readers and writers of post files (newline-delimited JSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendgap.schemas import POST, RAW_SCRAPE

LINES_PER_FILE = 500_000


def read_scrapes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RAW_SCRAPE).json(path)


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(POST).json(path)


def read_posts_stream(spark: SparkSession, path: str, max_files: int) -> DataFrame:
    """New files under `path`, each exactly once per checkpoint of the reading query, at
    most `max_files` per micro-batch."""
    reader = spark.readStream.schema(POST).option("maxFilesPerTrigger", max_files)
    return reader.json(path)


def write_posts(posts: DataFrame, path: str) -> None:
    """Land one batch as a new set of files, gzipped: names of fields and most values repeat
    from line to line. Fields that are NULL are left out. A gzipped file is read by one task,
    so files end after LINES_PER_FILE lines."""
    writer = posts.write.mode("append").option("maxRecordsPerFile", LINES_PER_FILE)
    writer.option("zlib.compress.level", "BEST_SPEED").json(path, compression="gzip")
