"""Product registry as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_documents(products: DataFrame) -> DataFrame:
    """Id, label, centre, bounds and publish delay of each product."""
    return products.select(
        F.col("product_id").alias("id"),
        "label",
        F.struct(F.col("lat").alias("latitude"), F.col("lon").alias("longitude")).alias("center"),
        F.struct("west", "south", "east", "north").alias("bounds"),
        F.col("publish_delay_s").alias("publishDelaySeconds"),
    )


def write_product_documents(products: DataFrame, path: str) -> None:
    """One JSON document per line; the registry is a few dozen rows."""
    product_documents(products).coalesce(1).write.mode("overwrite").json(path)
