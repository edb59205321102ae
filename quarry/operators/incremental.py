"""Which files to process and what the tables become: joins of listing, manifest and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed(files: DataFrame, manifest: DataFrame, force: bool = False) -> DataFrame:
    """files (source, digest) that are new or differ from manifest (source, digest); all of them when forced."""
    if force:
        return files
    m = manifest.select("source", F.col("digest").alias("old"))
    return files.join(m, "source", "left").where(~F.col("digest").eqNullSafe(F.col("old"))).drop("old")


def removed(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Sources of the manifest that the whole directory listing does not have."""
    return manifest.join(listing.select("source"), "source", "left_anti").select("source")


def missing(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested sources that are not there."""
    return requested.select("source").distinct().join(available.select("source"), "source", "left_anti")


def replaced(succeeded: DataFrame, gone: DataFrame) -> DataFrame:
    return succeeded.select("source").union(gone.select("source")).distinct()


def merge_chunks(existing: DataFrame, new: DataFrame, sources: DataFrame) -> DataFrame:
    """Chunks of sources that are not replaced, and the new ones."""
    return existing.join(sources.select("source"), "source", "left_anti").unionByName(new, allowMissingColumns=True)


def merge_manifest(manifest: DataFrame, hashes: DataFrame, sources: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Old digests of what is not replaced, new digests of what succeeded; what failed keeps its old one."""
    kept = manifest.join(sources.select("source"), "source", "left_anti").select("source", "digest")
    return kept.unionByName(hashes.join(succeeded.select("source").distinct(), "source", "left_semi").select("source", "digest"))


def cached(files: DataFrame, cache: DataFrame, fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(hits with their cached chunks, misses) of files (source, digest) under one parser fingerprint."""
    at = cache.where(F.col("fingerprint") == fingerprint).drop("fingerprint")
    return files.join(at, ["source", "digest"]), files.join(at.select("source", "digest").distinct(), ["source", "digest"], "left_anti")


def source_counts(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    n = chunks.groupBy("source").agg(F.count("*").alias("chunks"))
    return manifest.select("source").join(n, "source", "left").select("source", F.coalesce("chunks", F.lit(0)).alias("chunks"))


def breaker(outcomes: DataFrame, most: int = 3) -> DataFrame:
    """Rows (pos, source, failed, in_row): failures in a row up to each outcome; `in_row >= most` is where a build stops."""
    from pyspark.sql.window import Window

    w = Window.orderBy("pos")  # one build's ordered file outcomes: a short list
    run = F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w)
    rows = outcomes.withColumn("run", run)
    return rows.withColumn("in_row", F.sum(F.col("failed").cast("int")).over(Window.partitionBy("run").orderBy("pos"))).withColumn("stop", F.col("in_row") >= most).drop("run")
