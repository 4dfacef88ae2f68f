"""Exact deduplication: group by a 128-bit content hash, compare bytes inside a group.

The grouping key is the MD5 of the text followed by the text itself, so rows
meet by hash and are told apart by their bytes; equal rows are combined before
the shuffle, which makes a text held by a third of all rows cheap.  The flags
go back to the rows by narrow digests only, those of heavy texts by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .balance import attach, stored


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def _whole(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct text: its hashes, the largest id and the number of rows.

    A null text counts as empty.  Null ids never win over others; a class of
    null ids only has a null ``keep_id``.
    """
    rows = docs.select(F.col(id_col).alias("id"), _whole(text_col).alias("body"))
    merged = rows.groupBy(content_hash(F.col("body")).alias("h"), "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return merged.select("h", F.sha2("body", 256).alias("sha"), "keep_id", "group_size")


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The row with the largest id of equal texts is kept.  Rows that repeat id
    and text alike are one document: all of them carry the same flag, and a
    whole table of marks has them all, where ``survivors`` has one.  Classes
    were told apart by bytes; rows find theirs by MD5 and SHA-256 together.
    An empty table gives no rows; a long text travels once a class, at most.
    """
    rows = docs.select(F.col(id_col).alias("id"), _whole(text_col).alias("body")).select("id", content_hash(F.col("body")).alias("h"), F.sha2("body", 256).alias("sha"))
    repeated = stored(classes(docs, id_col, text_col).filter("group_size > 1"), "classes")
    joined = attach(rows, repeated, ["h", "sha"], "left", repeated.select("h", "sha", F.col("group_size").alias("_n")))
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows with all columns of ``docs``, one per distinct text.

    Null and empty texts are one class.  Rows that repeat id and text count
    once.  Texts cross the network once, equal ones combined beforehand.
    """
    names = docs.columns
    held = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text_col or c == id_col])
    rows = docs.select(_whole(text_col).alias("body"), F.struct(F.col(id_col).isNotNull().alias("has"), F.col(id_col).alias("id")).alias("rank"), held.alias("held"))
    best = rows.groupBy(content_hash(F.col("body")).alias("h"), "body").agg(F.max_by("held", "rank").alias("held"))
    return best.select(*[F.col("body").alias(c) if c == text_col else F.col(f"held.c{i}").alias(c) for i, c in enumerate(names)])
