"""Which products are ready, which outputs are missing, what has to be uploaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def ready_timestamps(catalog: DataFrame, products: DataFrame, product_inputs: DataFrame) -> DataFrame:
    """Timestamps at which every input of an enabled product has a file.

    Relational division: distinct (input, timestamp), joined to the
    product-input bridge, counted per (product, timestamp).  Products and bridge
    are configuration, a few rows per product, and are broadcast.
    """
    enabled = product_inputs.join(F.broadcast(products.where("enabled").select("product_id")), "product_id", "left_semi")
    needed = enabled.groupBy("product_id").agg(F.countDistinct("input_id").alias("_needed"))
    bridge = F.broadcast(enabled.select("product_id", "input_id").distinct().join(F.broadcast(needed), "product_id"))
    slots = catalog.select("input_id", "frame_ts").distinct()
    found = slots.join(bridge, "input_id").groupBy("product_id", "frame_ts", "_needed").agg(F.count(F.lit(1)).alias("_found"))
    return found.where(F.col("_found") == F.col("_needed")).select("product_id", "frame_ts")


def job_files(ready: DataFrame, catalog: DataFrame, product_inputs: DataFrame) -> DataFrame:
    """The files of each job, one row per file, ordered by input then path.

    Kept long rather than packed into arrays, so a timestamp with very many
    files is no wide row.
    """
    routed = catalog.join(F.broadcast(product_inputs), "input_id")
    return routed.join(ready, ["product_id", "frame_ts"]).select("product_id", "frame_ts", "ord", "input_id", "path")


def expected_outputs(frames: DataFrame, products: DataFrame) -> DataFrame:
    """Sidecar and variant names each frame should have."""
    config = products.select("product_id", "base_prefix", F.transform("variants", lambda v: v.getField("name")).alias("_names"))
    joined = frames.join(F.broadcast(config), "product_id")
    base = names.base_name(F.col("base_prefix"), F.col("frame_ts"))
    spread = joined.withColumn("base", base).withColumn("name", F.explode(names.output_file_names(F.col("base"), F.col("_names"))))
    return spread.drop("_names", "base_prefix")


def expected_forecast_outputs(fields: DataFrame, forecasts: DataFrame, products: DataFrame) -> DataFrame:
    """Sidecar and variant names of stored forecast fields ``(forecast_id, issue_ts, lead_min)``."""
    names_of = products.select("product_id", "base_prefix", F.transform("variants", lambda v: v.getField("name")).alias("_names"))
    config = forecasts.select("forecast_id", "product_id").join(F.broadcast(names_of), "product_id")
    joined = fields.join(F.broadcast(config), "forecast_id")
    base = names.forecast_base_name(F.col("base_prefix"), F.col("issue_ts"), F.col("lead_min"))
    spread = joined.withColumn("base", base).withColumn("name", F.explode(names.output_file_names(F.col("base"), F.col("_names"))))
    return spread.drop("_names", "base_prefix", "product_id")


def pending_jobs(ready: DataFrame, products: DataFrame, outputs: DataFrame, include_existing: bool = False) -> DataFrame:
    """Ready frames whose sidecar or any variant is missing from ``outputs`` (file ``name``)."""
    if include_existing:
        return ready
    missing = expected_outputs(ready, products).join(outputs.select("name"), "name", "left_anti")
    return missing.select("product_id", "frame_ts").distinct()


def forecast_render_units(fields: DataFrame, forecasts: DataFrame, products: DataFrame, outputs: DataFrame) -> DataFrame:
    """Stored fields with incomplete outputs; fields without readable metadata are skipped."""
    readable = fields.where(F.col("issue_ts").isNotNull() & F.col("lead_min").isNotNull())
    missing = expected_forecast_outputs(readable, forecasts, products).join(outputs.select("name"), "name", "left_anti")
    return missing.select("forecast_id", "issue_ts", "lead_min", "base").distinct()


def missing_files(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote files without a non-empty local file of the same input and name."""
    return remote.join(local.where(F.col("length") > 0).select("input_id", "filename"), ["input_id", "filename"], "left_anti")


def pending_uploads(outputs: DataFrame, state: DataFrame) -> DataFrame:
    """Images with no upload record of the same path, size and modification time."""
    images = outputs.where(F.endswith(F.col("path"), F.lit(".png")))
    return images.join(state.select("path", "size", "mtime_ns"), ["path", "size", "mtime_ns"], "left_anti")


def pruned_state(state: DataFrame, outputs: DataFrame) -> DataFrame:
    """Upload records whose image still exists."""
    images = outputs.where(F.endswith(F.col("path"), F.lit(".png")))
    return state.join(images.select("path"), "path", "left_semi")


def upload_manifest(outputs: DataFrame, prefix: str) -> DataFrame:
    """Object key and content type of each output path."""
    return outputs.withColumns(
        {"key": names.object_key(F.lit(prefix), F.col("path")), "content_type": names.content_type(F.col("path"))}
    )


def next_attempts(failures: DataFrame, base_s: float = 5.0, cap_s: float = 300.0) -> DataFrame:
    """When each path may be tried again, from a log of failures ``(path, ts)``."""
    counted = failures.groupBy("path").agg(F.count(F.lit(1)).alias("attempts"), F.max("ts").alias("last_ts"))
    delay = names.retry_delay(F.col("attempts"), base_s, cap_s)
    return counted.withColumn("delay_s", delay).withColumn(
        "next_ts", F.timestamp_add("SECOND", F.col("delay_s").cast("int"), F.col("last_ts"))
    )


def overlay_backlog(listing: DataFrame, outputs: DataFrame, limit: int) -> DataFrame:
    """Of the newest ``limit`` listed names per source, those without an overlay, to be done oldest first."""
    from ..sources.listing import newest_names

    recent = newest_names(listing, ["source_id"], limit).withColumn("frame_ts", names.compact_timestamp(F.col("filename")))
    named = recent.where(F.col("frame_ts").isNotNull()).withColumn("name", names.overlay_name(F.col("frame_ts"), F.lit("overlay")))
    return named.join(outputs.select("name"), "name", "left_anti").drop("rank")


def extended_backlog(listing: DataFrame, outputs: DataFrame, local: DataFrame) -> DataFrame:
    """Frames whose standard overlay exists, an extended one is missing, and the input is at hand."""
    stamped = listing.withColumn("frame_ts", names.compact_timestamp(F.col("filename"))).where(F.col("frame_ts").isNotNull())
    have = outputs.select("name")
    overlay = lambda variant: names.overlay_name(F.col("frame_ts"), F.lit(variant))
    standard = stamped.withColumn("name", overlay("overlay")).join(have, "name", "left_semi").drop("name")
    both = F.array(overlay("overlay_extended"), overlay("overlay2x_extended"))
    lacking = standard.withColumn("name", F.explode(both)).join(have, "name", "left_anti").drop("name").distinct()
    return lacking.join(local.select("filename").distinct(), "filename", "left_semi")
