"""Chunked array stores: time axis, frontier, georeferencing, chunks as cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import attach_by_key

# Frames looked back where an input has no retention.
DEFAULT_WINDOW = 12


def axis_rows(stores: DataFrame) -> DataFrame:
    """A store's packed nanosecond axis as rows ``(…, idx, axis_ts)``."""
    others = [name for name in stores.columns if name != "axis"]
    exploded = stores.select(*others, F.posexplode("axis").alias("idx", "_ns"))
    return exploded.select(*others, "idx", F.timestamp_micros(F.floor(F.col("_ns") / 1000)).cast("timestamp_ntz").alias("axis_ts"))


def frontier(axis: DataFrame, stores: DataFrame, key: str = "store_id") -> DataFrame:
    """Last axis entry at or before each store's ``last_valid``, clamped to the axis.

    An as-of lookup by aggregate: one value per store out of a partial maximum,
    no inequality join.
    """
    limit = stores.where(F.col("last_valid").isNotNull()).select(key, "last_valid")
    joined = attach_by_key(axis, limit, [key], ["idx"])
    reached = F.max(F.when(F.col("axis_ts") <= F.col("last_valid"), F.struct("axis_ts", "idx")))
    first = F.min(F.struct("axis_ts", "idx"))
    return joined.groupBy(key).agg(F.coalesce(reached, first).alias("_at")).select(
        key, F.col("_at.idx").alias("frontier_idx"), F.col("_at.axis_ts").alias("frontier_ts")
    )


def store_frames(axis: DataFrame, stores: DataFrame, window: Column, key: str = "store_id") -> DataFrame:
    """The newest ``window`` frames up to the frontier, with chunk URL and file name.

    ``stores`` has (store_id, input_id, store_url, variable, last_valid).
    """
    config = stores.select(key, "input_id", "store_url", "variable", window.alias("_window")).join(frontier(axis, stores, key), key)
    joined = attach_by_key(axis, config, [key], ["idx"])
    recent = (F.col("idx") <= F.col("frontier_idx")) & (F.col("idx") > F.col("frontier_idx") - F.greatest(F.lit(1), F.col("_window")))
    return joined.where(recent).select(
        "input_id", F.col("axis_ts").alias("frame_ts"),
        F.concat_ws("/", "store_url", "variable", F.concat(F.col("idx").cast("string"), F.lit(".0.0"))).alias("url"),
        F.concat("input_id", F.lit("_"), F.date_format("axis_ts", "yyyyMMddHHmmss"), F.lit(".h5")).alias("filename"),
        F.create_map(F.lit("index"), F.col("idx").cast("string")).alias("metadata"),
    )


_CRS = (
    "STRUCT<proj4: STRING, where_xsize: INT, where_ysize: INT, where_xscale: DOUBLE, where_yscale: DOUBLE, "
    "where_UL_lon: DOUBLE, where_UL_lat: DOUBLE>"
)


def georeference(metadata: DataFrame, variable: str = "RR", strict: bool = True) -> DataFrame:
    """Georeferencing out of consolidated metadata text; a missing group is an error."""
    schema = f"STRUCT<metadata: STRUCT<`crs/.zattrs`: {_CRS}, `{variable}/.zarray`: STRUCT<dtype: STRING>>>"
    others = [name for name in metadata.columns if name != "zmetadata"]
    parsed = metadata.withColumn("_m", F.from_json("zmetadata", schema).getField("metadata"))
    crs, array = F.col("_m").getField("crs/.zattrs"), F.col("_m").getField(f"{variable}/.zarray")
    complete = crs.isNotNull() & array.isNotNull()
    if strict:
        parsed = parsed.where(F.assert_true(complete, "metadata lacks the crs attributes or the array").isNull())
    else:
        parsed = parsed.where(complete)
    return parsed.select(
        *others, crs.proj4.alias("projdef"), crs.where_xsize.alias("xsize"), crs.where_ysize.alias("ysize"),
        crs.where_xscale.alias("xscale"), crs.where_yscale.alias("yscale"),
        crs.where_UL_lon.alias("ul_lon"), crs.where_UL_lat.alias("ul_lat"), array.dtype.alias("dtype"),
    )


def chunk_cells(chunks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A decoded chunk (``data`` array, ``xsize``) as cells in row-major order."""
    exploded = chunks.select(*keys, "xsize", F.posexplode("data").alias("_pos", "raw"))
    return exploded.select(
        *keys, F.floor(F.col("_pos") / F.col("xsize")).cast("int").alias("row"), (F.col("_pos") % F.col("xsize")).alias("col"), "raw"
    )
