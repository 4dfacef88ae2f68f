"""The configured inputs, products, forecasts and palettes as small DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import schema

# Reflectivity palettes.  The standard one has 4 dBZ steps from
# 4 to 64; the extended one starts at -12 with four lighter tones in front.
STANDARD_COLORS = (
    "#390071", "#3001A9", "#0200FB", "#076CBC", "#00A400", "#00BB03", "#36D700", "#9CDD07",
    "#E0DC01", "#FBB200", "#F78600", "#FF5400", "#FE0100", "#A40003", "#FCFCFC",
)
LIGHT_COLORS = ("#E0D4EC", "#C8B8D8", "#B0A0C8", "#8B68A8")
STANDARD_LEVELS = tuple(float(level) for level in range(4, 68, 4))
EXTENDED_LEVELS = tuple(float(level) for level in range(-12, 68, 4))

PALETTES = (
    ("dbzh", "DBZH", list(STANDARD_LEVELS), list(STANDARD_COLORS)),
    ("dbzh_extended", "DBZH", list(EXTENDED_LEVELS), list(LIGHT_COLORS + STANDARD_COLORS)),
)

# Output variants (name, pooling factor).
DEFAULT_VARIANTS = (("overlay", 1.0), ("overlay_small", 1.5))

# Fill of missing cells for tinted products.
NODATA_TINT = (0, 0, 0, 0.15)

# Default policies.
RETENTION_S = 7200
PERIOD_S = 300
LOOKBACK_MIN = 30
PUBLISH_DELAY_S = 260
LEAD_MINUTES = (10, 20, 30, 40, 50, 60)
HISTORY_FRAMES = 3

# The three inputs.
# input, source, kind, location, timestamp pattern
INPUTS = (
    ("cz_maxz", "chmi_current", "http_directory", None, "compact"),
    ("opera_dbzh", "ord_api", "ord_api", "0-20010-0-OPERA", "dated"),
    ("it_sri_arco", "arco_radar", "arco_zarr", None, "compact"),
)

# The enabled products in registry order.
# id, label, west, south, east, north, centre latitude, centre longitude
PRODUCTS = (
    ("cz", "Czechia", 11.27, 48.05, 19.62, 51.46, 49.8, 15.47),
    ("de", "Germany", 4.71, 46.55, 16.17, 55.62, 51.16, 10.45),
    ("pl", "Poland", 12.94, 48.27, 25.28, 55.56, 52.0, 19.4),
    ("sk", "Slovakia", 15.76, 47.03, 23.63, 50.32, 48.7, 19.7),
    ("at", "Austria", 8.46, 45.66, 18.22, 49.73, 47.6, 14.1),
    ("be", "Belgium", 1.38, 48.78, 7.50, 52.22, 50.64, 4.66),
    ("ch", "Switzerland", 4.92, 45.10, 11.51, 48.52, 46.8, 8.23),
    ("dk", "Denmark", 6.82, 54.08, 12.26, 58.47, 56.0, 9.5),
    ("ee", "Estonia", 22.02, 56.80, 29.59, 60.39, 58.6, 25.0),
    ("fi", "Finland", 18.62, 59.09, 33.14, 70.79, 63.0, 26.0),
    ("fr", "France", -5.87, 41.61, 9.29, 51.81, 46.6, 2.5),
    ("gb", "United Kingdom", -7.54, 49.24, 2.95, 59.40, 53.5, -2.5),
    ("hr", "Croatia", 12.48, 42.22, 20.43, 47.27, 45.1, 15.5),
    ("hu", "Hungary", 15.05, 45.02, 23.95, 49.29, 47.16, 19.5),
    ("ie", "Ireland", -11.65, 50.73, -4.80, 56.10, 53.2, -8.0),
    ("is", "Iceland", -26.27, 62.68, -11.80, 67.25, 64.9, -18.6),
    ("it", "Italy", 4.52, 35.06, 20.48, 47.85, 42.9, 12.3),
    ("lv", "Latvia", 19.67, 54.95, 29.51, 58.79, 56.9, 25.0),
    ("lt", "Lithuania", 19.77, 53.17, 28.06, 57.16, 55.2, 23.9),
    ("md", "Moldova", 25.54, 44.74, 31.17, 49.21, 47.2, 28.5),
    ("mt", "Malta", 13.44, 35.08, 15.45, 36.71, 35.9, 14.4),
    ("nl", "Netherlands", 2.29, 50.03, 8.40, 54.18, 52.2, 5.5),
    ("no", "Norway", 3.45, 57.26, 33.19, 71.85, 61.5, 9.0),
    ("pt", "Portugal", -10.42, 36.27, -5.25, 42.87, 39.6, -8.0),
    ("ro", "Romania", 19.21, 42.93, 30.72, 48.99, 45.9, 25.0),
    ("rs", "Serbia", 17.82, 41.52, 23.97, 46.89, 44.0, 20.9),
    ("es", "Spain", -10.27, 35.29, 4.29, 44.51, 40.2, -3.7),
    ("se", "Sweden", 9.72, 54.62, 25.91, 69.75, 62.0, 15.0),
    ("si", "Slovenia", 12.33, 44.70, 17.56, 47.58, 46.1, 14.8),
)

# Where a product departs from the defaults.
PRODUCT_INPUTS = {"cz": ("cz_maxz",), "it": ("opera_dbzh", "it_sri_arco")}
PRODUCT_PRIORITY = {"cz": 0, "sk": 5}
PRODUCT_PUBLISH_DELAY_S = {"cz": 10, "it": 480}
UNOPTIMIZED = ("fi", "no", "se")
TINTED = ("it", "md")


def product_rows() -> list[tuple]:
    """One tuple per product, in the field order of :data:`schema.PRODUCTS`."""
    rows = []
    for product_id, name, *numbers in PRODUCTS:
        rows.append(
            (
                product_id,
                f"{name} radar",
                *map(float, numbers),
                PRODUCT_PUBLISH_DELAY_S.get(product_id, PUBLISH_DELAY_S),
                PRODUCT_PRIORITY.get(product_id, 10),
                RETENTION_S,
                f"radar_{product_id}",
                "dbzh",
                list(DEFAULT_VARIANTS),
                NODATA_TINT if product_id in TINTED else None,
                product_id not in UNOPTIMIZED,
                True,
            )
        )
    return rows


def products(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(product_rows(), schema.PRODUCTS)


def product_inputs(spark: SparkSession) -> DataFrame:
    rows = [
        (row[0], input_id, ord_)
        for row in product_rows()
        for ord_, input_id in enumerate(PRODUCT_INPUTS.get(row[0], ("opera_dbzh",)))
    ]
    return spark.createDataFrame(rows, schema.PRODUCT_INPUTS)


def inputs(spark: SparkSession) -> DataFrame:
    rows = [
        (input_id, source, kind, location, "DBZH", [".h5", ".hdf"], pattern, RETENTION_S, LOOKBACK_MIN, PERIOD_S, True)
        for input_id, source, kind, location, pattern in INPUTS
    ]
    return spark.createDataFrame(rows, schema.INPUTS)


def forecasts(spark: SparkSession) -> DataFrame:
    rows = [
        (
            f"{row[0]}_forecast", row[0], "lucas_kanade", list(LEAD_MINUTES), HISTORY_FRAMES,
            1000 if row[0] == "cz" else 1010, 2, None, 2, True,
        )
        for row in product_rows()
    ]
    return spark.createDataFrame(rows, schema.FORECASTS)


def palettes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PALETTES, schema.PALETTES)
