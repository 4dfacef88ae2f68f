"""Joins and lookups that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 16


def attach_by_key(
    many: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    spread: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
    few_keys: bool = True,
) -> DataFrame:
    """Join per-key values (one row per key) onto many rows per key.

    The many side is salted with a hash of its ``spread`` columns and the small
    side is repeated once per salt, so a key with a third of all rows lands in
    ``salts`` tasks.  The salt is a function of the row, so a recomputed task
    gives the same rows.  Nothing is counted: adaptive execution broadcasts the
    small side if its measured bytes allow it.  The planner does not see that
    the small side is repeated and may broadcast it unmeasured: where keys grow
    with the rows, ``few_keys=False`` shuffles both sides.
    """
    salted_many = many.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(salts)))
    salted_keys = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    if not few_keys:
        salted_keys = salted_keys.hint("merge")
    return salted_many.join(salted_keys, [*keys, "_salt"], how).drop("_salt")
