"""Announcements to remote files, on batch and streaming tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..sources import links


def matched_inputs(messages: DataFrame, inputs: DataFrame) -> DataFrame:
    """Messages joined to the inputs their topic concerns.

    Only inputs of the announcing source kind with a location match.  The input
    configuration is a few rows and is broadcast.
    """
    parsed = messages.withColumn("_topic", names.topic_parts(F.col("topic")))
    config = inputs.where((F.col("source_kind") == "ord_api") & F.col("location_id").isNotNull()).select(
        "input_id", F.col("location_id").alias("_loc"), F.col("quantity").alias("_qty")
    )
    joined = parsed.join(
        F.broadcast(config), (F.col("_topic.location") == F.col("_loc")) & (F.col("_topic.quantity") == F.col("_qty"))
    )
    return joined.drop("_topic", "_loc", "_qty")


def announced_links(messages: DataFrame, inputs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Links of the messages matching an input: ``(input_id, *carry, pos, href, type, title, length)``."""
    matched = matched_inputs(messages, inputs).select("input_id", *carry, "payload")
    return links.payload_links(matched)


def announced_file_stream(messages: DataFrame, inputs: DataFrame, horizon: str = "2 hours") -> DataFrame:
    """File rows of a message stream, each (input, file name) once within the horizon.

    ``messages`` has topic, payload and ``ts`` (TIMESTAMP).  Payloads that do not
    parse are dropped.  The key stays reserved for the retention horizon.
    """
    linked = announced_links(messages.withWatermark("ts", horizon), inputs, carry=("ts",))
    named = links.named_links(linked, inputs)
    return named.dropDuplicatesWithinWatermark(["input_id", "filename"]).select(
        "input_id", "frame_ts", F.col("href").alias("url"), "filename", "title", "ts"
    )
