"""The JSON document beside each rendered frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sidecars(frames: DataFrame, sources: DataFrame, variants: DataFrame) -> DataFrame:
    """``(base, sidecar)`` with the document as JSON text.

    ``frames`` has one row per base with timestamp, quantity, palette, crs and
    bounds.  ``sources`` has (base, ord, name), ``variants`` has (base, variant,
    width, height).  Both lists are part of the document and as long as the
    product has inputs and variants.
    """
    listed = sources.groupBy("base").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("ord", "name"))), lambda s: s["name"]).alias("sources")
    )
    sizes = variants.groupBy("base").agg(
        F.map_from_entries(
            F.array_sort(
                F.collect_set(
                    F.struct(
                        "variant",
                        F.struct(F.concat("base", F.lit("_"), "variant", F.lit(".png")).alias("file"), "width", "height").alias("size"),
                    )
                )
            )
        ).alias("variants")
    )
    joined = frames.join(listed, "base").join(sizes, "base")
    document = F.struct(
        F.date_format("frame_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "quantity", "palette", "crs",
        F.struct("west", "south", "east", "north").alias("bounds"), "sources", "variants",
    )
    return joined.select("base", F.to_json(document).alias("sidecar"))


def write_sidecars(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
