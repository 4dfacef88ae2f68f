"""Cell values and colours as Column expressions.

Missing is NULL and clear sky is minus infinity; NaN never enters a cell table,
because a NaN would win every ``max``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLEAR_SKY = float("-inf")

# Marshall-Palmer coefficients of Z = a * R ** b.
ZR_A = 200.0
ZR_B = 1.6

# Sentinels of stored reflectivity frames (gain 1, offset 0).
STORE_NODATA = -9999.0
STORE_UNDETECT = -8888.0


def linear_decode(
    raw: Column,
    gain: Column | float,
    offset: Column | float,
    nodata: Column | float,
    undetect: Column | float,
    undetect_value: float = CLEAR_SKY,
) -> Column:
    """Counts to physical values; undetect is tested first, so it wins over an equal nodata."""
    physical = raw * _col(gain) + _col(offset)
    return (
        F.when(raw == _col(undetect), F.lit(undetect_value))
        .when((raw == _col(nodata)) | raw.isNull() | F.isnan(raw), F.lit(None).cast("double"))
        .otherwise(physical)
    )


def store_encode(value: Column) -> Column:
    """Inverse boundary: NULL to the nodata sentinel, clear sky to undetect."""
    return (
        F.when(value.isNull(), F.lit(STORE_NODATA))
        .when(value == F.lit(CLEAR_SKY), F.lit(STORE_UNDETECT))
        .otherwise(value)
    )


def rain_to_dbz(rate: Column) -> Column:
    """Rain rate (mm/h) to reflectivity: missing stays missing, dry is clear sky."""
    slope = F.lit(10.0 * ZR_B)
    intercept = F.lit(10.0) * F.log10(F.lit(ZR_A))
    return (
        F.when(rate.isNull() | F.isnan(rate) | (F.abs(rate) == F.lit(float("inf"))), F.lit(None).cast("double"))
        .when(rate <= 0, F.lit(CLEAR_SKY))
        .otherwise(intercept + slope * F.log10(rate))
    )


def without_nan(value: Column) -> Column:
    """NaN to NULL, for values entering a cell table."""
    return F.when(~F.isnan(value), value)


def is_echo(value: Column) -> Column:
    """True for finite values only; NULL and infinities are not echoes."""
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.coalesce(finite, F.lit(False))


def cell_state(value: Column) -> Column:
    return (
        F.when(value.isNull(), "nodata")
        .when(value == F.lit(CLEAR_SKY), "undetect")
        .otherwise("echo")
    )


def mask_below(value: Column, floor: float) -> Column:
    """Values strictly under the floor become missing."""
    return F.when(value >= F.lit(floor), value)


def mask_at_or_below(value: Column, floor: float) -> Column:
    """Values at or under the floor become missing (the forecast rule)."""
    return F.when(value > F.lit(floor), value)


def palette_index(value: Column, levels: Column, n_colors: Column, nodata_slot: Column) -> Column:
    """Bin number by the last level not above the value.

    Below the first level gives the transparent slot ``n_colors``; missing gives
    ``nodata_slot``; values past the last level fall into the top bin.
    """
    reached = F.size(F.filter(levels, lambda level: level <= value)) - 1
    return (
        F.when(value.isNull(), nodata_slot)
        .when(reached < 0, n_colors)
        .otherwise(F.least(reached, n_colors - 1))
        .cast("smallint")
    )


def even_palette_index(value: Column, first: float, step: float, n_colors: int, nodata_slot: int) -> Column:
    """Same as :func:`palette_index` for evenly spaced levels, inside code generation."""
    bin_number = F.floor((value - F.lit(first)) / F.lit(step))
    return (
        F.when(value.isNull(), F.lit(nodata_slot))
        .when(value < F.lit(first), F.lit(n_colors))
        .when(value >= F.lit(first + step * n_colors), F.lit(n_colors - 1))
        .otherwise(F.least(bin_number, F.lit(n_colors - 1)))
        .cast("smallint")
    )


def hex_channel(color: Column, channel: int) -> Column:
    """Channel 0, 1 or 2 of ``#RRGGBB``; NULL where the text is not six hex digits."""
    bare = F.regexp_replace(color, r"^#+", "")
    digits = F.substring(bare, 1 + 2 * channel, 2)
    return F.when(F.regexp_like(bare, F.lit(r"^[0-9A-Fa-f]{6}$")), F.conv(digits, 16, 10).cast("int"))


def alpha_byte(alpha: Column) -> Column:
    """Opacity in [0, 1] to a byte, ties to even."""
    return F.rint(alpha * 255).cast("int")


def palette_is_valid(levels: Column, colors: Column) -> Column:
    """One more level than colours, strictly ascending."""
    steps = F.zip_with(
        F.slice(levels, 1, F.greatest(F.size(levels) - 1, F.lit(0))),
        F.slice(levels, 2, F.greatest(F.size(levels) - 1, F.lit(0))),
        lambda low, high: high > low,
    )
    return (F.size(levels) == F.size(colors) + 1) & F.forall(steps, lambda ok: ok)


def _col(value: Column | float) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))
