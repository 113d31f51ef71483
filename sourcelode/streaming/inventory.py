"""Streams of file snapshots: inventory by language in event-time windows, and duplicates as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn

SNAPSHOT = "repo_id STRING, path STRING, content STRING, bytes BIGINT, seen TIMESTAMP"


def snapshots(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """Parquet files of snapshots (SNAPSHOT) as they are put into the folder."""
    return spark.readStream.schema(SNAPSHOT).option("maxFilesPerTrigger", max_files).parquet(folder)


def language_windows(files: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Files, bytes and lines by window and language; rows later than the watermark are left out."""
    known = files.withColumn("language", fn.language(F.col("path"))).filter("language IS NOT NULL")
    return (
        known.withWatermark("seen", late)
        .groupBy(F.window("seen", width).alias("window"), "language")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.sum(fn.line_count(F.col("content"))).alias("lines"))
        .select("window.start", "window.end", "language", "files", "bytes", "lines")
    )


def first_copies(files: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first snapshot of each text; copies within the watermark are dropped. State is bounded by the watermark."""
    return files.withColumn("hash", fn.fingerprint(F.col("content"))).withWatermark("seen", late).dropDuplicatesWithinWatermark(["hash"])


def duplicate_counts(files: DataFrame) -> DataFrame:
    """For update mode: texts seen more than once so far, with the smallest path."""
    hashed = files.select("repo_id", "path", fn.fingerprint(F.col("content")).alias("hash"))
    return hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).filter("n > 1")
