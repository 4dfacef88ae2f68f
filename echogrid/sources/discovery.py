"""Remote files of all source kinds on one schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import within_retention

REMOTE = ["input_id", "frame_ts", "url", "filename", "metadata"]


def discover(parts: Sequence[DataFrame], inputs: DataFrame, limit: int | None = None) -> DataFrame:
    """Union of the sources' files, enabled inputs only, newest ``limit`` per input."""
    merged = parts[0].select(*REMOTE)
    for part in parts[1:]:
        merged = merged.unionByName(part.select(*REMOTE))
    enabled = merged.join(F.broadcast(inputs.where("enabled").select("input_id")), "input_id", "left_semi")
    if limit is None:
        return enabled
    order = W.partitionBy("input_id").orderBy(F.col("frame_ts").desc(), F.col("url"))
    return enabled.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def wanted_downloads(remote: DataFrame, local: DataFrame, inputs: DataFrame, now) -> DataFrame:
    """Remote files inside retention that have no non-empty local file of that name."""
    recent = remote.join(F.broadcast(inputs.select("input_id", "retention_s")), "input_id").where(within_retention(now))
    have = local.where(F.col("length") > 0).select("input_id", "filename")
    return recent.drop("retention_s").join(have, ["input_id", "filename"], "left_anti")


def sync_status(attempts: DataFrame) -> DataFrame:
    """Per input: files, downloads and whether it failed.

    ``attempts`` has (input_id, filename, downloaded, skipped, error); a skipped
    file (missing chunk) is left out, an error marks its input and hides its files.
    """
    failed = F.max(F.when(F.col("error").isNotNull(), 1).otherwise(0)) == 1
    kept = F.col("error").isNull() & ~F.col("skipped")
    grouped = attempts.groupBy("input_id").agg(
        failed.alias("failed"),
        F.count(F.when(kept, 1)).alias("_files"),
        F.count(F.when(kept & F.col("downloaded"), 1)).alias("_downloaded"),
        F.min("error").alias("error"),
    )
    return grouped.select(
        "input_id", "failed", "error",
        F.when(F.col("failed"), F.lit(0)).otherwise(F.col("_files")).cast("bigint").alias("files"),
        F.when(F.col("failed"), F.lit(0)).otherwise(F.col("_downloaded")).cast("bigint").alias("downloaded"),
    )


def sync_summary(files: DataFrame) -> DataFrame:
    """Files, downloads and news per source and input, with subtotals per source and in all."""
    return files.rollup("source_id", "input_id").agg(
        F.count(F.lit(1)).alias("files"), F.sum(F.col("downloaded").cast("int")).alias("downloaded"), F.bool_or("downloaded").alias("has_new")
    )
