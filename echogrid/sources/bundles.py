"""Forecast bundles: members of archives and what is left to render."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names


def bundle_members(members: DataFrame) -> DataFrame:
    """Members with their lead: ``(bundle, member, bundle_ts, member_ts, label, offset_min)``.

    Members without a timestamp or a numeric ``_ft`` label, or older than their
    bundle, are dropped.  The lead is the rounded time difference, not the label.
    Names are read in a generator, so that the conditions on what was read are
    not moved before it and each name is read once.
    """
    bundle_ts = names.bundle_timestamp(F.col("bundle"))
    member_ts = names.compact_timestamp(F.col("member"))
    # No label is NULL, not empty: a cast that fails raises and catches an error for each row.
    label = F.get(F.regexp_extract_all("member", F.lit(r"_ft(\d+)\.[^.]*$"), F.lit(1)), F.lit(0)).try_cast("int")
    read = F.inline(F.array(F.struct(bundle_ts.alias("bundle_ts"), member_ts.alias("member_ts"), label.alias("label"))))
    offset = F.rint(F.timestamp_diff("SECOND", F.col("bundle_ts"), F.col("member_ts")) / 60).cast("int")
    timed = members.select("*", read).withColumn("offset_min", offset)
    return timed.where(F.col("member_ts").isNotNull() & F.col("bundle_ts").isNotNull() & F.col("label").isNotNull() & (F.col("offset_min") >= 0))


def finished_stems(outputs: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """``stem`` of the overlay names that ``outputs`` has in every variant."""
    each = outputs.select("name", F.explode(F.array(*map(F.lit, variants))).alias("variant"))
    ending = names.overlay_ending(F.col("variant"))
    stem = F.substring("name", F.lit(1), F.length("name") - F.length(ending))
    found = each.where(F.endswith(F.col("name"), ending)).select(stem.alias("stem"), "variant")
    seen = [F.max(F.col("variant") == variant) for variant in variants]
    return found.groupBy("stem").agg(F.array(*seen).alias("seen")).where(F.forall("seen", lambda one: one)).select("stem")


def bundle_backlog(members: DataFrame, outputs: DataFrame, variants: tuple[str, ...] = ("overlay", "overlay2x")) -> DataFrame:
    """Members with at least one variant not yet written; ``outputs`` has file ``name``.

    Equal members count once.  A member stays one row: it is held against what is
    written in every variant, not each of its variants against every name.
    """
    timed = bundle_members(members.distinct())
    stemmed = timed.withColumn("stem", names.overlay_stem(F.col("bundle_ts"), F.col("offset_min")))
    return stemmed.join(finished_stems(outputs, variants), "stem", "left_anti").select(*timed.columns)
