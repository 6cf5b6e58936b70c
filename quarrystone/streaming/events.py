"""Streaming forms of the event operators; they extend the batch ones.

All state is bounded by a watermark: late rows beyond it are dropped by
Structured Streaming, as stated, and windows close.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_of_each(stream: DataFrame, digest: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each digest once within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([digest])


def windowed_detection(stream: DataFrame, by: str, value: str, thresholds: tuple[float, ...], ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows at or above each threshold by tumbling window."""
    counts = [F.count_if(F.col(value) >= t).alias(f"detected_{i}") for i, t in enumerate(thresholds)]
    got = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), *counts)
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", *[f"detected_{i}" for i in range(len(thresholds))])


def sessions(stream: DataFrame, by: str, gap: str = "30 minutes", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    got = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def committed(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes each micro-batch once: its folder is named by the batch, so a repeated one replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
