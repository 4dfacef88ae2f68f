"""Decoding, classification and colours against known values."""

import math

import pytest
from pyspark.sql import functions as F

from echogrid import registry
from echogrid.functions import values as V
from echogrid.operators import raster as R

INF = float("inf")


def column(spark, rows, expression, name="x"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, {name} double")
    return [r.out for r in df.select("i", expression.alias("out")).orderBy("i").collect()]


def test_linear_decode(spark):
    raw = F.col("x")
    got = column(spark, [120.0, 180.0, 255.0, 0.0, None], V.linear_decode(raw, 0.5, -32.0, 255.0, 0.0))
    assert got == [28.0, 58.0, None, -INF, None]


def test_undetect_wins_over_an_equal_nodata(spark):
    assert column(spark, [7.0], V.linear_decode(F.col("x"), 1.0, 0.0, 7.0, 7.0)) == [-INF]


def test_fixed_undetect_value(spark):
    assert column(spark, [0.0], V.linear_decode(F.col("x"), 0.5, -32.0, 255.0, 0.0, undetect_value=-32.0)) == [-32.0]


def test_rain_to_reflectivity(spark):
    got = column(spark, [0.0, 2.5, None, math.nan, 10.0], V.rain_to_dbz(F.col("x")))
    assert got[0] == -INF and got[2] is None and got[3] is None
    assert got[1] == pytest.approx(29.377, abs=1e-3)
    assert got[4] == pytest.approx(39.010, abs=1e-3)


def test_store_encode_round_trip(spark):
    encoded = V.store_encode(F.col("x"))
    back = V.linear_decode(encoded, 1.0, 0.0, V.STORE_NODATA, V.STORE_UNDETECT)
    assert column(spark, [None, -INF, 12.5], back) == [None, -INF, 12.5]


@pytest.mark.parametrize("fill, missing", [(False, 15), (True, 16)])
def test_classify_standard(spark, fill, missing):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([None, 0.0, 6.0, 100.0, 4.0, 63.9, -INF])], "i int, value double")
    got = [r.idx for r in R.classify(df, registry.STANDARD_LEVELS, nodata_fill=fill).orderBy("i").collect()]
    assert got == [missing, 15, 0, 14, 0, 14, 15]


def test_uneven_levels_match_the_even_rule(spark):
    df = spark.createDataFrame([(float(v) / 3,) for v in range(-60, 240)], "value double")
    levels = F.array(*map(F.lit, registry.STANDARD_LEVELS))
    general = V.palette_index(F.col("value"), levels, F.lit(15), F.lit(16))
    even = V.even_palette_index(F.col("value"), 4.0, 4.0, 15, 16)
    assert df.where(general != even).count() == 0


def test_uneven_palette(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-1.0, 0.0, 1.0, 5.0, 9.0, None])], "i int, value double")
    got = [r.idx for r in R.classify(df, [0.0, 1.0, 5.0, 6.0]).orderBy("i").collect()]
    assert got == [3, 0, 1, 2, 2, 3]


def test_quantity_mismatch_is_an_error(spark):
    df = spark.createDataFrame([(1.0, "RATE")], "value double, quantity string")
    with pytest.raises(Exception, match="palette is for DBZH"):
        R.classify(df, registry.STANDARD_LEVELS, "DBZH").collect()


def test_floors_differ_at_the_boundary(spark):
    df = spark.createDataFrame([(4.0,)], "x double")
    row = df.select(V.mask_below(F.col("x"), 4.0).alias("a"), V.mask_at_or_below(F.col("x"), 4.0).alias("b")).first()
    assert (row.a, row.b) == (4.0, None)


def test_colours(spark):
    df = spark.createDataFrame([("#FE0100",), ("FE01",)], "c string")
    got = [(r.r, r.g, r.b) for r in df.select(*[V.hex_channel(F.col("c"), i).alias(n) for i, n in enumerate("rgb")]).collect()]
    assert got == [(254, 1, 0), (None, None, None)]
    assert spark.range(1).select(V.alpha_byte(F.lit(0.15)).alias("a")).first().a == round(0.15 * 255)


def test_palette_validation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], ["a", "b"]), ([1.0, 1.0, 3.0], ["a", "b"]), ([1.0, 2.0], ["a", "b"])], "l array<double>, c array<string>")
    assert [r.ok for r in df.select(V.palette_is_valid(F.col("l"), F.col("c")).alias("ok")).collect()] == [True, False, False]
    assert all(r.ok for r in registry.palettes(df.sparkSession).select(V.palette_is_valid(F.col("levels"), F.col("colors")).alias("ok")).collect())
