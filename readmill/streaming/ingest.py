"""Streams of reads: FASTQ files that arrive in a folder, and statistics over late and repeated deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from readmill.sources.fastq import records_of


def fastq_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100, split_bytes: int = 64 << 20) -> DataFrame:
    """Records of FASTQ files as they arrive, read by byte ranges: only paths and lengths pass through the stream's source."""
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "length")
    return records_of(files, split_bytes)


def once_within(df: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once, with state kept only as long as a repeated delivery may be late."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def arrivals(df: DataFrame, time: str, late: str, width: str, *keys: str) -> DataFrame:
    """Counts per window of event time and keys, final once the watermark has passed the window."""
    return (
        df.withColumn(time, F.col(time).cast("timestamp"))
        .withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count("*").alias("n"), F.sum(F.length("sequence")).alias("n_bases"))
        .select(F.col("w.start").alias("window_start"), *keys, "n", "n_bases")
    )


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there as Parquet and ends; a restart goes on where it stopped."""
    q = df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
