"""Stored forecast fields: each write replaces a forecast's whole set.

A write is a version of its own: cells and frames go to folders that nothing
else writes to, and one small commit record per forecast, put only where there
is none of that number, makes them the ones that are read.  Writers of one
forecast may overlap: the last to commit wins, whole.  Versions that a later
record has replaced are dropped; what is not yet committed is left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key
from ..operators.tiles import DEFAULT_TILE
from .folders import Folders

CELLS = "issue_ts TIMESTAMP_NTZ, valid_ts TIMESTAMP_NTZ, row INT, col INT, value FLOAT, forecast_id STRING, issue STRING, version STRING, lead_min INT"
FRAMES = "issue_ts TIMESTAMP_NTZ, valid_ts TIMESTAMP_NTZ, lead_min INT, forecast_id STRING, version STRING"


def _issue(column: str = "issue_ts"):
    return F.date_format(F.col(column), "yyyyMMddHHmmss").alias("issue")


def new_version() -> str:
    return uuid.uuid4().hex


def write_cells(cells: DataFrame, path: str, version: str | None = None) -> None:
    """Store the finite cells of new issues beside what is there, in folders by forecast, issue, version and lead."""
    stored = cells.select("issue_ts", "valid_ts", "row", "col", F.col("value").cast("float").alias("value"), "forecast_id", _issue(), F.lit(version or new_version()).alias("version"), "lead_min")
    spread = stored.repartition("forecast_id", "issue", "lead_min", F.floor(F.col("row") / DEFAULT_TILE))
    spread.sortWithinPartitions("forecast_id", "issue", "lead_min", "row", "col").write.mode("append").partitionBy("forecast_id", "issue", "version", "lead_min").parquet(f"{path}/cells")


def write_frames(frames: DataFrame, path: str, version: str | None = None) -> None:
    """List the frames of one issue per forecast and commit them; from then on that issue is the one that is read."""
    spark, version = frames.sparkSession, version or new_version()
    listed = frames.select("issue_ts", "valid_ts", F.col("lead_min").cast("int").alias("lead_min"), "forecast_id", F.lit(version).alias("version"))
    listed.write.mode("append").partitionBy("forecast_id", "version").parquet(f"{path}/frames")
    written = spark.read.schema(FRAMES).parquet(f"{path}/frames").where(F.col("version") == version)
    for (forecast,) in written.select("forecast_id").distinct().collect():  # forecasts are configured, some tens
        commit(spark, path, forecast, version)


def write_fields(cells: DataFrame, frames: DataFrame, path: str) -> None:
    """Store one issue per forecast in place of what the store held for it.

    ``frames`` lists every (forecast_id, issue_ts, lead_min, valid_ts), echoes or
    not; ``cells`` has the finite values.  Cells come first and are not read
    until their version is committed, so a reader, or a failure in between,
    sees the old issue whole.  Other forecasts stay.
    """
    version = new_version()
    write_cells(cells, path, version)
    write_frames(frames, path, version)


def commit(spark: SparkSession, path: str, forecast: str, version: str) -> int:
    """Put the forecast's next commit record, then drop the versions that earlier records name; the record's number."""
    folders = Folders(spark, path)
    home = folders.named("commits", "forecast_id", forecast)
    number = max(folders.numbers(home), default=0) + 1
    while not folders.put(folders.below(home, f"{number:012d}"), version):
        number += 1
    drop_replaced(folders, forecast, number)
    return number


def drop_replaced(folders: Folders, forecast: str, number: int) -> None:
    """Remove the cells, frames and records of the forecast's commits before ``number``."""
    home = folders.named("commits", "forecast_id", forecast)
    for older in folders.numbers(home):
        if older >= number:
            break
        record = folders.below(home, f"{older:012d}")
        version = folders.first_line(record)
        folders.drop(folders.named("frames", "forecast_id", forecast, f"version={version}"))
        for issue in folders.names(folders.named("cells", "forecast_id", forecast)):
            held = folders.named("cells", "forecast_id", forecast, issue)
            folders.drop(folders.below(held, f"version={version}"))
            if not folders.names(held):
                folders.drop(held)
        folders.drop(record)


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(forecast_id, version) of each forecast's last commit record."""
    records = spark.read.schema("value STRING, forecast_id STRING").text(f"{path}/commits").select("forecast_id", F.col("value").alias("version"), F.col("_metadata.file_name").alias("number"))
    return records.groupBy("forecast_id").agg(F.max_by("version", "number").alias("version"))


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """Issue times and leads of what is committed, without touching a cell.

    The schema is given, as a forecast id that looks like a number or a date would else be read as one.
    """
    return spark.read.schema(FRAMES).parquet(f"{path}/frames").join(committed(spark, path), ["forecast_id", "version"], "left_semi").drop("version")


def existing_minutes(spark: SparkSession, path: str, forecast_id: str, issue_ts: str) -> DataFrame:
    frames = read_frames(spark, path)
    return frames.where((F.col("forecast_id") == forecast_id) & (F.col("issue_ts") == F.lit(issue_ts).cast("timestamp_ntz"))).select("lead_min")


def read_fields(spark: SparkSession, path: str, forecast_id: str | None = None, lead_min: int | None = None) -> DataFrame:
    """Cells of the committed versions; filters on forecast and lead read their folders only."""
    cells, current = spark.read.schema(CELLS).parquet(f"{path}/cells"), committed(spark, path)
    if forecast_id is not None:
        cells, current = (df.where(F.col("forecast_id") == forecast_id) for df in (cells, current))
    if lead_min is not None:
        cells = cells.where(F.col("lead_min") == lead_min)
    return attach_by_key(cells, current, ["forecast_id", "version"], ["lead_min", "row", "col"]).drop("issue", "version")
