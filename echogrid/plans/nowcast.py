"""Nowcasts for all forecasts and issues in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions import values as V
from ..functions.projection import Crs
from ..operators import motion as M
from ..operators import neighbourhood as N
from ..operators.raster import composite_to_grid
from ..operators.skew import attach_by_key
from ..operators.tiles import DEFAULT_TILE
from ..session import cut_lineage


def lead_minutes(minutes: Sequence[int]) -> list[int]:
    """Leads without repeats, ascending; a lead that is not positive is an error."""
    ordered = sorted(set(minutes))
    if ordered and ordered[0] <= 0:
        raise ValueError(f"forecast minutes must be positive, got {ordered}")
    return ordered


def history_steps(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per issue: newest frame, minutes to the one before it, and frame count.

    ``history`` has (keys, frame_ts), a handful of rows per issue.  Fewer than
    two frames, or two newest frames at one time, is an error.
    """
    newest = F.sort_array(F.collect_list("frame_ts"), asc=False)
    folded = history.groupBy(*keys).agg(newest.alias("_ts")).withColumns(
        {"frames": F.size("_ts"), "issue_frame": F.get("_ts", F.lit(0)), "_before": F.get("_ts", F.lit(1))}
    )
    dt = F.timestamp_diff("SECOND", F.col("_before"), F.col("issue_frame")) / 60.0
    timed = folded.withColumn("dt_min", dt)
    enough = F.assert_true(F.col("frames") >= 2, "a forecast needs at least 2 history frames")
    ordered = F.assert_true(F.col("dt_min") > 0, "history frames must have increasing timestamps")
    return timed.where(enough.isNull() & ordered.isNull()).select(*keys, "frames", "issue_frame", "dt_min")


def numbered_history(history: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, frame_ts, pos, last): frames of each issue numbered from the oldest."""
    stamps = history.groupBy(*keys).agg(F.sort_array(F.collect_list("frame_ts")).alias("_ts"))
    numbered = stamps.select(*keys, F.size("_ts").alias("last"), F.posexplode("_ts").alias("_i", "frame_ts"))
    return numbered.select(*keys, "frame_ts", (F.col("_i") + 1).alias("pos"), "last")


def history_cells(
    cells: DataFrame, history: DataFrame, targets: DataFrame, sources: DataFrame, source_crs: Mapping[str, Crs],
    keys: Sequence[str] = ("product_id",), stamp: str = "frame_ts",
) -> DataFrame:
    """Input cells of the history frames, resampled onto each product's grid and merged.

    Frames no product needs are dropped before the resampling join.
    """
    needed = cells.join(history.select(stamp).distinct(), stamp, "left_semi")
    merged = composite_to_grid(needed, targets, sources, source_crs, keys, [stamp])
    return merged.join(history.select(*keys, stamp), [*keys, stamp], "left_semi")


def motion_vectors(
    cells: DataFrame, history: DataFrame, keys: Sequence[str], height: int, width: int,
    method: str = "lucas_kanade", tile: int = DEFAULT_TILE,
) -> DataFrame:
    """Cleaned, declustered vectors per issue, from all neighbouring history pairs."""
    check_method(method)
    frames = _frames(history, issue_settings(history, keys, height, width, (), None, method, 1, 1), keys)
    return _vectors(_opened(cells, frames, keys, tile), frames, keys, tile)


def check_method(method: str) -> None:
    if method not in M.MOTION_METHODS:
        raise ValueError(f"unknown motion method {method!r}; known: {sorted(M.MOTION_METHODS)}")


def issue_settings(history: DataFrame, keys: Sequence[str], height: int, width: int, minutes: Sequence[int], floor: float | None, method: str, motion_grid_step: int, warp_grid_step: int) -> DataFrame:
    """The same settings for every issue of a history."""
    leads = F.array(*map(F.lit, lead_minutes(minutes))).cast("array<int>")
    return history.select(*keys).distinct().withColumns(
        {
            "height": F.lit(height), "width": F.lit(width), "floor": F.lit(floor).cast("double"), "method": F.lit(method), "leads": leads,
            "motion_grid_step": F.lit(motion_grid_step), "warp_grid_step": F.lit(warp_grid_step),
        }
    )


def checked_settings(settings: DataFrame) -> DataFrame:
    """Settings with ascending leads; an unknown method or a lead that is not positive is an error."""
    leads = F.array_sort(F.array_distinct("leads"))
    known = F.col("method").isin(*M.MOTION_METHODS)
    good = F.assert_true(F.coalesce(known, F.lit(False)), F.concat(F.lit("unknown motion method "), F.coalesce("method", F.lit("NULL"))))
    positive = F.assert_true(F.coalesce(F.array_min("leads") > 0, F.lit(True)), F.lit("forecast minutes must be positive"))
    return settings.where(good.isNull() & positive.isNull()).withColumn("leads", leads)


def _frames(history: DataFrame, settings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The numbered history frames with their issue's settings: a few rows per issue, used throughout and written once."""
    return cut_lineage(numbered_history(history, keys).join(checked_settings(settings), list(keys)))


def _opened(cells: DataFrame, frames: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    """Opened history frames, keyed by issue, grid and place in the history.

    The grid's size is part of the key, so every tile operator finds it there.
    Read by the ranges, the scores, the tracking and as the newest frame: written
    once to the shared folder.  Issues without motion need their newest frame only.
    """
    wanted = frames.where((F.col("method") != "zero") | (F.col("pos") == F.col("last"))).select(*keys, "frame_ts", "pos", "last", "height", "width")
    rows = attach_by_key(cells, wanted, [*keys, "frame_ts"], ["row", "col"])
    return cut_lineage(N.open_frames(rows, [*keys, "height", "width", "pos", "last"], F.col("height"), F.col("width"), tile, raw=True))


def _vectors(opened: DataFrame, frames: DataFrame, keys: Sequence[str], tile: int) -> DataFrame:
    grid = [*keys, "height", "width"]
    frame, size = [*grid, "pos", "last"], (F.col("height"), F.col("width"))
    refined = [name for name, refine in M.MOTION_METHODS.items() if refine]
    tracked = frames.where(F.col("method") != "zero").select(*frame, F.col("method").isin(*refined).alias("_refine"))
    # A row per frame that five steps read: written once, or each would aggregate the frames again.
    ranges = cut_lineage(N.level_range(opened, frame).join(tracked, frame))
    scores = N.frame_corners(opened.where(F.col("pos") < F.col("last")), ranges, frame, *size, tile=tile, candidates=True)
    features = N.select_features(scores, frame, *size)
    vectors = M.track_frames(opened, ranges, features, grid, *size, F.col("_refine"), tile=tile).select(*keys, "x", "y", "u", "v")
    return M.decluster(M.drop_outliers(vectors, keys), keys)


def nowcast(
    cells: DataFrame,
    history: DataFrame,
    keys: Sequence[str],
    height: int,
    width: int,
    minutes: Sequence[int],
    floor: float | None = None,
    method: str = "lucas_kanade",
    motion_grid_step: int = 2,
    warp_grid_step: int = 2,
    tile: int = DEFAULT_TILE,
) -> DataFrame:
    """:func:`nowcast_all` with the same grid, leads, floor, method and steps for every issue."""
    check_method(method)
    return nowcast_all(cells, history, issue_settings(history, keys, height, width, minutes, floor, method, motion_grid_step, warp_grid_step), keys, tile)


def nowcast_all(cells: DataFrame, history: DataFrame, settings: DataFrame, keys: Sequence[str], tile: int = DEFAULT_TILE) -> DataFrame:
    """Forecast cells ``(keys, issue_ts, lead_min, valid_ts, row, col, value)`` of all issues, each by its own settings.

    ``cells`` holds one row per (keys, frame_ts, row, col); frames outside
    ``history`` are ignored.  ``settings`` has one row per issue: ``height,
    width, floor`` (or NULL), ``method, leads`` (minutes), ``motion_grid_step,
    warp_grid_step``; issues without a row are left out.  Only finite cells above
    the floor are returned; everything else, such as an issue whose newest frame
    has no echo, is missing.  Velocities are per minute, so issues with different
    grids, frame spacings and lead lists share one plan.
    """
    frames = _frames(history, settings, keys)
    steps = history_steps(frames, keys)
    own = frames.where(F.col("pos") == F.col("last")).drop("frame_ts", "pos", "last")
    opened = _opened(cells, frames, keys, tile)
    vectors = _vectors(opened, frames, keys, tile)
    # A few hundred rows per issue, read by the halo and by the velocities.
    per_minute = cut_lineage(
        vectors.join(steps.select(*keys, "dt_min"), list(keys)).select(
            *keys, "x", "y", (F.col("u") / F.col("dt_min")).alias("u"), (F.col("v") / F.col("dt_min")).alias("v")
        )
    )
    source = opened.where((F.col("pos") == F.col("last")) & V.is_echo(F.col("raw"))).select(*keys, "row", "col", F.col("raw").alias("value"))
    issues = steps.select(*keys, F.col("issue_frame").alias("issue_ts")).join(own, list(keys))
    step = usable_step(F.col("height"), F.col("width"), F.col("motion_grid_step"))
    moved = M.extrapolate_vectors(source, per_minute, own, keys, F.col("leads"), F.col("height"), F.col("width"), step, F.col("warp_grid_step"), tile)
    timed = moved.join(issues.select(*keys, "issue_ts", "leads", "floor"), list(keys))
    value = F.when(F.col("floor").isNull() | (F.col("value") > F.col("floor")), F.col("value"))
    stamped = timed.select(*keys, F.get("leads", F.col("lead")).alias("lead_min"), "row", "col", value.alias("value"), "issue_ts").where(F.col("value").isNotNull())
    return stamped.withColumn("valid_ts", names.valid_time(F.col("issue_ts"), F.col("lead_min")))


def usable_step(height: Column, width: Column, step: Column) -> Column:
    """:func:`motion_step` over columns."""
    wanted = F.greatest(F.lit(1), step)
    coarse = F.least(F.ceil(height / wanted), F.ceil(width / wanted))
    return F.when(coarse >= 2, wanted).otherwise(1)


def motion_step(height: int, width: int, step: int, grid_max: int | None = None) -> int:
    """Coarsening step for densifying; grids under 2 x 2 coarse cells stay full."""
    wanted = max(1, step)
    if grid_max:
        wanted = max(wanted, -(-max(height, width) // grid_max))
    return wanted if min(-(-height // wanted), -(-width // wanted)) >= 2 else 1


def forecast_frames(history: DataFrame, keys: Sequence[str], minutes: Sequence[int]) -> DataFrame:
    """Every (issue, lead) with its step count and valid time, echoes or not."""
    steps = history_steps(history, keys)
    lead = F.explode(F.array(*map(F.lit, lead_minutes(minutes))))
    spread = steps.withColumn("lead_min", lead)
    return spread.select(
        *keys, F.col("issue_frame").alias("issue_ts"), "frames", "dt_min", "lead_min",
        (F.col("lead_min") / F.col("dt_min")).alias("lead_steps"),
        names.valid_time(F.col("issue_frame"), F.col("lead_min")).alias("valid_ts"),
    )
