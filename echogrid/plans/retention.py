"""What retention removes and what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..sources.catalog import as_time

STALE_PART_S = 3600


def expired_inputs(files: DataFrame, inputs: DataFrame, now) -> DataFrame:
    """Input files older than their retention; unreadable names and partial files stay."""
    from ..sources.catalog import usable_files, within_retention

    return usable_files(files, inputs).where(~within_retention(now)).select(*files.columns, "frame_ts")


def expired_outputs(outputs: DataFrame, products: DataFrame, now, forecasts: bool = False) -> DataFrame:
    """Outputs of frames past retention: each expired sidecar takes its variants along.

    ``outputs`` has (product_id, name).  Images whose sidecar is missing stay, as
    do names that do not parse.
    """
    config = products.select(
        "product_id", "base_prefix", "retention_s", F.transform("variants", lambda v: v.getField("name")).alias("_names")
    )
    joined = outputs.join(F.broadcast(config), "product_id")
    stem = F.regexp_extract("name", r"^(.*)\.json$", 1)
    parse = names.forecast_base_timestamp if forecasts else names.base_timestamp
    sidecars = joined.where(F.endswith(F.col("name"), F.lit(".json"))).withColumn("_stem", stem)
    timed = sidecars.withColumn("frame_ts", parse(F.col("_stem"), F.col("base_prefix")))
    cutoff = F.timestamp_add("SECOND", -F.col("retention_s"), as_time(now))
    old = timed.where(F.col("frame_ts") < cutoff)
    wanted = old.select("product_id", "frame_ts", F.explode(names.output_file_names(F.col("_stem"), F.col("_names"))).alias("name"))
    return outputs.join(wanted, ["product_id", "name"])


def expired_fields(fields: DataFrame, retention_s: int | None, now) -> DataFrame:
    """Stored forecast fields to delete: old issues, unreadable ones, stale partial files."""
    if retention_s is None:
        return fields.where(F.lit(False))
    reference = as_time(now)
    part = F.endswith(F.col("path"), F.lit(".part"))
    stale = F.col("modified") < F.timestamp_add("SECOND", F.lit(-STALE_PART_S), reference)
    old = F.col("issue_ts").isNull() | (F.col("issue_ts") < F.timestamp_add("SECOND", F.lit(-retention_s), reference))
    return fields.where(F.when(part, stale).otherwise(old))


def survivors(rows: DataFrame, expired: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(expired.select(*keys), keys, "left_anti")


def newest_by_name(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keep the ``limit`` greatest names per key; a limit of zero or less keeps all."""
    if limit <= 0:
        return rows
    order = W.partitionBy(*keys).orderBy(F.col("name").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def newest_frames(outputs: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Keep the variants of the ``limit`` newest frames per key.

    Which frames count is decided by their main overlay; other variants follow
    their timestamp.
    """
    if limit <= 0:
        return outputs
    stamped = outputs.withColumn("_stub", F.regexp_extract("name", r"^radar_(\d{8}_\d{4})_", 1))
    main = stamped.where(F.col("name").rlike(r"^radar_\d{8}_\d{4}_overlay\.png$")).select(*keys, "name", "_stub")
    kept = newest_by_name(main, keys, limit).select(*keys, "_stub")
    other = F.col("_stub") == ""
    return stamped.where(other).unionByName(stamped.where(~other).join(kept, [*keys, "_stub"], "left_semi").select(*stamped.columns)).drop("_stub")
