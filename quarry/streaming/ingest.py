"""Streams: folders that grow, and events by time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import incremental


def follow(spark: SparkSession, folder: str, checkpoint: str, merge: Callable[[DataFrame, int], None], once: bool = True):
    """New files of a folder as micro-batches (source, path, content, digest); a file that comes again with other content comes again as a row.

    merge gets each batch and its number, and must treat a repeated number as done.
    """
    rows = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = rows.select(F.element_at(F.split("path", "/"), -1).alias("source"), "path", "content", F.sha2("content", 256).alias("digest"))
    writer = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_into(manifest: DataFrame, chunks: DataFrame, batch: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest) after a batch: files with a known digest are skipped, others replace their rows."""
    new = incremental.changed(batch.select("source", "digest", "path", "content"), manifest)
    made = parse(new)
    ok = made.select("source").distinct()
    return incremental.merge_chunks(chunks, made, ok), incremental.merge_manifest(manifest, new.select("source", "digest"), ok, ok)


def windowed(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event type and time window, with a watermark for late rows."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")
