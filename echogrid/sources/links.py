"""Links in announcement payloads, feature filters and lookback windows."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..functions.nested import parse_deep, parsed
from .catalog import as_time
from .listing import dedupe_by_url

LINK_TYPE = "application/x-odim"
LINK_FIELDS = "pos: int, href: string, type: string, title: string, length: string"


def _as_text(value: object) -> str | None:
    try:
        return value if value is None or isinstance(value, str) else json.dumps(value)
    except RecursionError:
        return None


def _links_of(payload: str | None) -> list[dict]:
    """Links of one payload: its own, then those of each nested coverage in turn, to any depth.

    Entries that are no objects, links of other types and links whose ``href``
    is no text are passed over; what stands beside them counts.
    """
    found, stack = [], [parsed(payload) if payload is not None else None]
    while stack:
        node = stack.pop()
        if not isinstance(node, dict):
            continue
        own, nested = node.get("links"), node.get("coverages")
        for link in own if isinstance(own, list) else ():
            if isinstance(link, dict) and link.get("type") == LINK_TYPE and isinstance(link.get("href"), str):
                found.append((link["href"], LINK_TYPE, _as_text(link.get("title")), _as_text(link.get("length"))))
        stack.extend(reversed(nested if isinstance(nested, list) else ()))
    return [dict(zip(("pos", "href", "type", "title", "length"), (pos, *link), strict=True)) for pos, link in enumerate(found)]


def payload_links(payloads: DataFrame) -> DataFrame:
    """One row per link of the wanted type, own links first, then nested coverages at any depth.

    Payloads that are not JSON objects have no links.  Only those that can hold
    the wanted type, spelled out or escaped, are parsed.  Works on streams too.
    """

    @F.pandas_udf(f"array<struct<{LINK_FIELDS}>>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(_links_of)

    others = [name for name in payloads.columns if name != "payload"]
    able = F.contains("payload", F.lit(LINK_TYPE.partition("/")[2])) | F.contains("payload", F.lit("\\u"))
    return payloads.where(able).select(*others, F.explode(found(F.col("payload"))).alias("_link")).select(*others, "_link.*")


def named_links(links: DataFrame, inputs: DataFrame) -> DataFrame:
    """Links that are files of their row's ``input_id``, with ``filename`` and ``frame_ts``.

    Keeps names with a wanted suffix and the input's quantity between ``@``
    signs, and drops names without a timestamp.  Works on streams too.
    """
    config = inputs.select("input_id", "suffixes", "ts_pattern", F.col("quantity").alias("_q"))
    named = links.join(F.broadcast(config), "input_id").withColumn("filename", names.filename_of(F.col("href")))
    suffix = F.exists("suffixes", lambda s: F.endswith(F.lower(F.col("filename")), s))
    quantity = F.contains(F.col("filename"), F.concat(F.lit("@"), F.col("_q"), F.lit("."))) | F.contains(
        F.col("filename"), F.concat(F.lit("@"), F.col("_q"), F.lit("@"))
    )
    stamped = named.where(suffix & quantity).withColumn("frame_ts", names.parsed_timestamp(F.col("filename"), F.col("ts_pattern")))
    return stamped.where(F.col("frame_ts").isNotNull()).drop("suffixes", "ts_pattern", "_q")


def link_files(links: DataFrame, inputs: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Remote files among links, one per URL: the last one's values, the first one's position."""
    rows = named_links(links, inputs).select(
        "input_id", "frame_ts", F.col("href").alias("url"), "filename",
        F.map_from_arrays(F.array(F.lit("length"), F.lit("type"), F.lit("title")), F.array("length", "type", "title")).alias("metadata"),
        F.struct(*order).alias("pos"),
    )
    return dedupe_by_url(rows, ["input_id"], "pos")


def lookback_filter(frames: DataFrame, inputs: DataFrame, now) -> DataFrame:
    """Frames from ``now`` back by the larger of the input's query lookback and its retention."""
    config = inputs.select("input_id", "retention_s", "lookback_min")
    minutes = F.greatest(
        F.col("lookback_min"),
        F.when(F.col("retention_s").isNull(), F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.col("retention_s") / 60).cast("int"))),
    )
    reference = as_time(now)
    joined = frames.join(F.broadcast(config), "input_id").withColumn("window_min", minutes)
    start = F.timestamp_add("MINUTE", -F.col("window_min"), reference)
    return joined.where((F.col("frame_ts") >= start) & (F.col("frame_ts") <= reference)).drop("retention_s", "lookback_min")


def feature_filter(
    features: DataFrame, standard_name: str, fmt: str, method: str,
    naming_authority: str | None = None, platform_prefixes: Sequence[str] = (),
) -> DataFrame:
    """Catalog features of one quantity, format and method, by authority and platform prefix."""
    keep = (F.col("standard_name") == standard_name) & (F.col("format") == fmt) & (F.col("method") == method)
    if naming_authority:
        keep = keep & (F.col("naming_authority") == naming_authority)
    if platform_prefixes:
        platform = F.regexp_replace(F.coalesce(F.col("platform_name"), F.lit("")), r"^[\[\]]+|[\[\]]+$", "")
        keep = keep & F.exists(F.array(*map(F.lit, platform_prefixes)), lambda prefix: F.startswith(platform, prefix))
    return features.where(F.coalesce(keep, F.lit(False)))
