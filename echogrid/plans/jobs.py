"""Order, history, coalescing and completeness of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names
from ..operators.skew import attach_by_key
from ..sources.catalog import as_time


def job_order(jobs: DataFrame, products: DataFrame) -> DataFrame:
    """Jobs by priority, newest first within one, then by product."""
    config = products.select("product_id", "priority")
    return jobs.join(F.broadcast(config), "product_id").orderBy("priority", F.col("frame_ts").desc(), "product_id")


def history_frames(ready: DataFrame, frames: int, issue: Column | str | None = None) -> DataFrame:
    """Last ``frames`` ready timestamps per product, at or before ``issue`` if given.

    ``pos`` counts from 1 at the oldest.  Products with fewer are left out.
    Ranks are limited before the shuffle.
    """
    if frames < 2:
        raise ValueError(f"a history needs at least 2 frames, got {frames}")
    known = ready if issue is None else ready.where(F.col("frame_ts") <= as_time(issue))
    order = W.partitionBy("product_id").orderBy(F.col("frame_ts").desc())
    ranked = known.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= frames)
    full = ranked.groupBy("product_id").agg(F.count(F.lit(1)).alias("_have"), F.max("frame_ts").alias("issue_ts"))
    enough = full.where(F.col("_have") == frames).drop("_have")
    return ranked.join(enough, "product_id").select("product_id", "issue_ts", (F.lit(frames + 1) - F.col("_n")).alias("pos"), "frame_ts")


def wanted_forecasts(history: DataFrame, forecasts: DataFrame, products: DataFrame, outputs: DataFrame) -> DataFrame:
    """Histories of enabled forecasts whose issue is not fully rendered yet."""
    from .readiness import expected_forecast_outputs

    enabled = forecasts.where(F.col("enabled") & (F.size("minutes") > 0))
    issues = history.select("product_id", "issue_ts").distinct().join(
        F.broadcast(enabled.select("forecast_id", "product_id", "minutes")), "product_id"
    )
    fields = issues.select("forecast_id", "issue_ts", F.explode(F.array_sort(F.array_distinct("minutes"))).alias("lead_min"))
    missing = expected_forecast_outputs(fields, forecasts, products).join(outputs.select("name"), "name", "left_anti")
    open_issues = missing.select("forecast_id", "issue_ts").distinct()
    joined = history.join(issues.select("forecast_id", "product_id", "issue_ts"), ["product_id", "issue_ts"])
    return joined.join(open_issues, ["forecast_id", "issue_ts"], "left_semi")


def latest_wanted(tasks: DataFrame, key: str, seq: str) -> DataFrame:
    """One pending task per key: the one that was set last, whatever its issue."""
    others = [name for name in tasks.columns if name != key]
    chosen = F.max_by(F.struct(*others), seq).alias("_task")
    return tasks.groupBy(key).agg(chosen).select(key, *[F.col(f"_task.{name}").alias(name) for name in others])


def drop_superseded(results: DataFrame, key: str, issue: str) -> DataFrame:
    """Results of each key's newest issue.

    The newest issue is aggregated and joined back with a salt, so one busy key
    is not one task.
    """
    newest = results.groupBy(key).agg(F.max(issue).alias("_newest"))
    spread = [name for name in results.columns if name != key]
    joined = attach_by_key(results, newest, [key], spread)
    return joined.where(F.col(issue) == F.col("_newest")).drop("_newest")


def unique_tasks(tasks: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One task per key: the one that came first."""
    others = [name for name in tasks.columns if name not in keys]
    chosen = F.min_by(F.struct(*others), F.col(seq)).alias("_task")
    return tasks.groupBy(*keys).agg(chosen).select(*keys, *[F.col(f"_task.{name}").alias(name) for name in others])


def expected_gaps(catalog: DataFrame, now, period_min: int = 5, warn_after_s: int = 3600) -> DataFrame:
    """Grid times between an input's first and last frame that have no file."""
    slots = catalog.select("input_id", "frame_ts").distinct()
    spans = slots.groupBy("input_id").agg(F.min("frame_ts").alias("_first"), F.max("frame_ts").alias("_last"))
    steps = F.floor(F.timestamp_diff("MINUTE", F.col("_first"), F.col("_last")) / period_min).cast("int")
    grid = spans.withColumn("_i", F.explode(F.sequence(F.lit(0), steps))).select(
        "input_id", F.timestamp_add("MINUTE", F.col("_i") * period_min, F.col("_first")).alias("frame_ts")
    )
    missing = grid.join(slots, ["input_id", "frame_ts"], "left_anti")
    age = F.timestamp_diff("SECOND", F.col("frame_ts"), as_time(now))
    return missing.withColumn("age_s", age).withColumn("overdue", F.col("age_s") > warn_after_s)


def completeness(catalog: DataFrame, inputs: DataFrame, now) -> DataFrame:
    """Frames held against the budget of each input's retention."""
    from ..sources.catalog import within_retention

    config = inputs.select("input_id", "retention_s", names.frame_budget(F.col("retention_s"), F.col("period_s"), F.col("source_kind")).alias("budget"))
    slots = catalog.select("input_id", "frame_ts").distinct().join(F.broadcast(config), "input_id")
    recent = within_retention(now) & (F.col("frame_ts") <= as_time(now))
    return slots.groupBy("input_id", "budget").agg(F.count(F.when(recent, 1)).alias("held"))


def product_budget(inputs: DataFrame, product_inputs: DataFrame) -> DataFrame:
    """Frames to look for per product: the largest budget over its inputs with a retention, NULL if none has one."""
    config = inputs.select("input_id", names.frame_budget(F.col("retention_s"), F.col("period_s")).alias("budget"))
    return product_inputs.join(config, "input_id").groupBy("product_id").agg(F.max("budget").alias("budget"))


def publish_latency(files: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Seconds from frame time to file time, against the declared delay.

    Latencies are counted per value first, so the median sees distinct values.
    """
    seconds = F.timestamp_diff("SECOND", F.col("frame_ts"), F.col("modified"))
    counted = files.groupBy(*keys, seconds.alias("latency_s")).agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(declared, keys)
    late = F.sum(F.when(F.col("latency_s") > F.col("publish_delay_s"), F.col("n")).otherwise(0))
    return joined.groupBy(*keys, "publish_delay_s").agg(
        F.sum("n").alias("files"), late.alias("late"), F.percentile("latency_s", F.lit(0.5), F.col("n")).alias("median_s"), F.max("latency_s").alias("max_s")
    )


def duplicate_bases(frames: DataFrame) -> DataFrame:
    """Output bases claimed more than once in a batch."""
    return frames.groupBy("base").agg(F.count(F.lit(1)).alias("claims")).where(F.col("claims") > 1)


def batch_result(decoded: DataFrame, keys: list[str]) -> DataFrame:
    """Frames rendered and failed in a batch; a failed frame never stops the others."""
    per_frame = decoded.groupBy(*keys).agg(F.max(F.col("error").isNotNull()).alias("failed"))
    return per_frame.agg(
        F.count(F.lit(1)).alias("frames"), F.count(F.when(~F.col("failed"), 1)).alias("rendered"), F.count(F.when(F.col("failed"), 1)).alias("failed")
    )


def stale_connections(messages: DataFrame, keys: list[str], now, stale_after_s: int = 600) -> DataFrame:
    """Per connection: whether its last message is older than the limit, to the microsecond."""
    last = messages.groupBy(*keys).agg(F.max("ts").alias("last_ts"))
    return last.withColumn("stale", F.col("last_ts") < F.timestamp_add("SECOND", F.lit(-stale_after_s), as_time(now)))


def connection_stale(connected: Column, last_ts: Column, now: Column, stale_after_s: int = 600) -> Column:
    """Disconnected is stale; connected without any message yet is not."""
    old = last_ts < F.timestamp_add("SECOND", F.lit(-stale_after_s), now)
    return F.when(~connected, True).when(last_ts.isNull(), False).otherwise(old)
