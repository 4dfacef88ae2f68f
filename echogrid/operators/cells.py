"""Cell tables: one value per cell, dense grids, georeferencing, statistics."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions import values as V
from .skew import attach_by_key


def max_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per (keys, row, col) holding the largest value.

    Serves both as duplicate removal and as the maximum composite over inputs:
    NULL is ignored, clear sky loses to any echo, all-missing stays missing.
    The aggregate combines before the shuffle.
    """
    return cells.groupBy(*keys, "row", "col").agg(F.max("value").alias("value"))


def composite_inputs(cells: DataFrame, product_inputs: DataFrame, keys: Sequence[str] = ("frame_ts",)) -> DataFrame:
    """Maximum over all inputs of each product; the bridge table is a small dimension.

    Each input's cells are merged once, whatever the number of products that use
    it, and only products of several inputs are merged again.
    """
    merged = max_cells(cells, ["input_id", *keys])
    several = product_inputs.groupBy("product_id").agg((F.count(F.lit(1)) > 1).alias("_several"))
    bridge = product_inputs.select("product_id", "input_id").join(several, "product_id")
    routed = merged.join(F.broadcast(bridge), "input_id")
    columns = ["product_id", *keys, "row", "col", "value"]
    return max_cells(routed.where("_several"), ["product_id", *keys]).select(columns).unionByName(routed.where("NOT _several").select(columns))


def check_single_timestamp(frames: DataFrame, group: Sequence[str]) -> DataFrame:
    """Groups with their single timestamp; a group mixing timestamps is an error.

    Minimum and maximum decide it, so no set of timestamps is kept.
    """
    spread = frames.groupBy(*group).agg(
        F.min("frame_ts").alias("frame_ts"),
        F.max("frame_ts").alias("_last"),
        F.count(F.lit(1)).alias("fields"),
    )
    ok = F.assert_true(F.col("frame_ts") == F.col("_last"), "composite inputs must share a timestamp")
    return spread.where(ok.isNull()).drop("_last")


def mixed_timestamp_groups(frames: DataFrame, group: Sequence[str]) -> DataFrame:
    """The groups :func:`check_single_timestamp` would refuse, as a report."""
    return (
        frames.groupBy(*group)
        .agg(F.min("frame_ts").alias("first_ts"), F.max("frame_ts").alias("last_ts"))
        .where(F.col("first_ts") < F.col("last_ts"))
    )


def target_cells(grids: DataFrame) -> DataFrame:
    """Every (row, col) of each grid row, which carries ``height`` and ``width``.

    The few grid rows are exploded to raster rows, spread over the session's
    shuffle width, and only then exploded to columns, so that many tasks take
    part in generating a large grid.
    """
    width = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = grids.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1))).repartition(width, "row")
    return rows.withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))


def densify(cells: DataFrame, grids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All cells of each grid, with NULL where the cell table has no row."""
    full = target_cells(grids.select(*keys, "height", "width")).drop("height", "width")
    return full.join(cells.select(*keys, "row", "col", "value"), [*keys, "row", "col"], "left")


def with_centres(cells: DataFrame, x_min: Column, y_max: Column, px: Column, py: Column) -> DataFrame:
    return cells.withColumns(
        {"x": grid.column_centre(F.col("col"), x_min, px), "y": grid.row_centre(F.col("row"), y_max, py)}
    )


def crop(cells: DataFrame, x_low: Column, y_low: Column, x_high: Column, y_high: Column) -> DataFrame:
    """Cells whose centre (columns ``x``, ``y``) lies in the box."""
    return cells.where(F.col("x").between(x_low, x_high) & F.col("y").between(y_low, y_high))


def frame_stats(cells: DataFrame, keys: Sequence[str], size: Column | int) -> DataFrame:
    """Finite fraction, echo count, and minimum, median, mean, deviation, maximum of finite values.

    ``size`` is the number of cells of the whole grid; an absent row is a cell
    without a value.  Values are first counted per (frame, value), which
    combines before the shuffle and spreads a large frame; the second stage sees
    distinct values only.  The deviation is summed around the mean, merged from
    partial sums of the cells.
    """
    counted = cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    echo = F.when(V.is_echo(F.col("value")), F.col("value"))
    n = F.col("n")
    echoes = F.sum(F.when(echo.isNotNull(), n).otherwise(0))
    total = F.sum(echo * n)
    spread = cells.groupBy(*keys).agg(F.stddev_samp(echo).alias("stdev_value")).select(*[F.col(k).alias(f"_{k}") for k in keys], "stdev_value")
    counts = counted.groupBy(*keys).agg(
        F.sum(n).alias("cells"),
        echoes.alias("echoes"),
        (echoes / (size if isinstance(size, Column) else F.lit(size))).alias("finite_fraction"),
        F.min(echo).alias("min_value"),
        F.percentile(echo, F.lit(0.5), F.when(echo.isNotNull(), n).otherwise(0)).alias("median_value"),
        F.when(echoes > 0, F.try_divide(total, echoes)).alias("mean_value"),
        F.max(echo).alias("max_value"),
    )
    same = functools.reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return counts.join(spread, same).select(*counts.columns[:-1], "stdev_value", "max_value")


def fill_missing(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and clear-sky cells take the frame's smallest finite value.

    Adds ``valid``.  Frames without a finite value are left out.  The minimum is
    aggregated and joined back with a salt rather than computed in a window, so
    a frame is never held by one task.
    """
    echo = F.when(V.is_echo(F.col("value")), F.col("value"))
    floor = cells.groupBy(*keys).agg(F.min(echo).alias("frame_min")).where(F.col("frame_min").isNotNull())
    joined = attach_by_key(cells, floor, keys, ["row", "col"])
    return joined.withColumns(
        {"valid": V.is_echo(F.col("value")), "value": F.coalesce(F.when(V.is_echo(F.col("value")), F.col("value")), F.col("frame_min"))}
    )


def empty_frames(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames with no finite value at all."""
    return (
        cells.groupBy(*keys)
        .agg(F.max(V.is_echo(F.col("value"))).alias("_any"))
        .where(~F.col("_any"))
        .select(*keys)
    )


def rescale_to_byte(filled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Minimum-maximum rescale to 0..255 with truncation; flat frames keep offsets from the minimum."""
    top = filled.groupBy(*keys).agg(F.max("value").alias("frame_max"))
    joined = attach_by_key(filled, top, keys, ["row", "col"])
    low, high = F.col("frame_min"), F.col("frame_max")
    scaled = F.when(high - low > 1e-8, (F.col("value") - low) / (high - low) * 255).otherwise(F.col("value") - low)
    return joined.withColumn("level", F.floor(scaled).cast("int"))


def masked_rmse(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Root mean square and differing fraction over cells finite in both rasters."""
    a = left.select(*keys, "row", "col", F.col("value").alias("a")).where(V.is_echo(F.col("a")))
    b = right.select(*keys, "row", "col", F.col("value").alias("b")).where(V.is_echo(F.col("b")))
    both = a.join(b, [*keys, "row", "col"])
    return both.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.sqrt(F.avg(F.pow(F.col("a") - F.col("b"), 2))).alias("rmse"),
        F.avg(F.when(F.col("a") != F.col("b"), 1.0).otherwise(0.0)).alias("differing"),
    )
