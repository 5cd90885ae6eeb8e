"""Directory streams: image files as they arrive, and keep-first deduplication of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def frame_stream(spark: SparkSession, folder: str, glob: str = "*.jpg", per_trigger: int = 10) -> DataFrame:
    """(path, modified, content): files of a folder as an unbounded stream, a few per micro-batch."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    stream = reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", str(per_trigger)).load(folder)
    return stream.select("path", F.col("modificationTime").alias("modified"), "content")


def every_nth_frame(frames: DataFrame, skip: int, most: int | None = None) -> DataFrame:
    """Frames whose number, the last digits of the file name, is a multiple of ``skip``; with ``most`` the first so many from 0."""
    number = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1).cast("long")
    kept = frames.withColumn("frame", number).filter(F.col("frame") % skip == 0)
    return kept if most is None else kept.filter(F.col("frame") < skip * most)


def first_panoramas(stream: DataFrame, watermark: str = "1 day") -> DataFrame:
    """The first row of each pano_id of a stream (pano_id, ts, ...), remembered for as long as the watermark says."""
    return stream.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["pano_id"])


def windowed_counts(stream: DataFrame, key: str, width: str = "5 minutes", watermark: str = "10 minutes") -> DataFrame:
    """(start, key, n, total): counts and sums per window of event time; late rows beyond the watermark are dropped by Spark."""
    grouped = stream.withWatermark("ts", watermark).groupBy(F.window("ts", width).alias("w"), key)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
