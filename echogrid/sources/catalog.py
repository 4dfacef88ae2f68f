"""Catalog of local input files."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def as_time(now: Column | datetime | str) -> Column:
    """A fixed reference time as a TIMESTAMP_NTZ column."""
    return now if isinstance(now, Column) else F.lit(str(now)).cast("timestamp_ntz")


def list_folders(spark: SparkSession, folders: Mapping[str, str], glob: str = "*") -> DataFrame:
    """Files of each input's folder; contents are never read, only their listing."""
    listed = None
    for input_id, folder in folders.items():
        part = (
            spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
            .select(
                F.lit(input_id).alias("input_id"), "path", names.filename_of(F.col("path")).alias("filename"),
                "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
            )
        )
        listed = part if listed is None else listed.unionByName(part)
    if listed is None:
        raise ValueError("no folders given")
    return listed


def usable_files(files: DataFrame, inputs: DataFrame) -> DataFrame:
    """Files with a wanted suffix and a readable timestamp, with their input's settings.

    ``inputs`` is the configuration of a few inputs and is broadcast.
    """
    config = inputs.select("input_id", "suffixes", "ts_pattern", "retention_s")
    joined = files.join(F.broadcast(config), "input_id")
    wanted = F.array_contains("suffixes", names.suffix_of(F.col("filename"))) & ~F.endswith(F.col("filename"), F.lit(".part"))
    stamped = joined.where(wanted).withColumn("frame_ts", names.parsed_timestamp(F.col("filename"), F.col("ts_pattern")))
    return stamped.where(F.col("frame_ts").isNotNull())


def within_retention(now: Column | datetime | str) -> Column:
    """Frames on or after the cutoff; no retention keeps everything."""
    cutoff = F.timestamp_add("SECOND", -F.col("retention_s"), as_time(now))
    return F.col("retention_s").isNull() | (F.col("frame_ts") >= cutoff)


def scan_catalog(files: DataFrame, inputs: DataFrame, now: Column | datetime | str | None = None) -> DataFrame:
    """The input index: ``(input_id, frame_ts, path, filename)``, one row per path.

    Without ``now`` the cutoff counts from the current time, in UTC like the frames.
    """
    reference = F.convert_timezone(None, F.lit("UTC"), F.localtimestamp()) if now is None else now
    kept = usable_files(files, inputs).where(within_retention(reference))
    return kept.groupBy("input_id", "frame_ts", "path").agg(F.max("filename").alias("filename"))


def files_for(catalog: DataFrame, input_id: str, frame_ts: Column | datetime | str) -> DataFrame:
    return catalog.where((F.col("input_id") == input_id) & (F.col("frame_ts") == as_time(frame_ts)))


def timestamps_for(catalog: DataFrame, input_id: str) -> DataFrame:
    return catalog.where(F.col("input_id") == input_id).select("frame_ts").distinct()
