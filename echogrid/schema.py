"""Explicit schemas, as DDL text, of the tables the operators exchange."""

from __future__ import annotations

CRS = "STRUCT<kind: STRING, a: DOUBLE, f: DOUBLE, lat0: DOUBLE, lon0: DOUBLE, k: DOUBLE, x0: DOUBLE, y0: DOUBLE>"

INPUTS = (
    "input_id STRING, source_id STRING, source_kind STRING, location_id STRING, quantity STRING, "
    "suffixes ARRAY<STRING>, ts_pattern STRING, retention_s INT, lookback_min INT, period_s INT, enabled BOOLEAN"
)
PRODUCTS = (
    "product_id STRING, label STRING, west DOUBLE, south DOUBLE, east DOUBLE, north DOUBLE, "
    "lat DOUBLE, lon DOUBLE, publish_delay_s INT, priority INT, retention_s INT, base_prefix STRING, "
    "palette STRING, variants ARRAY<STRUCT<name: STRING, factor: DOUBLE>>, "
    "nodata_rgba STRUCT<r: INT, g: INT, b: INT, a: DOUBLE>, optimize BOOLEAN, enabled BOOLEAN"
)
PRODUCT_INPUTS = ("product_id STRING, input_id STRING, ord INT")
FORECASTS = (
    "forecast_id STRING, product_id STRING, method STRING, minutes ARRAY<INT>, history_frames INT, priority INT, "
    "motion_grid_step INT, motion_grid_max INT, warp_grid_step INT, enabled BOOLEAN"
)
PALETTES = ("name STRING, quantity STRING, levels ARRAY<DOUBLE>, colors ARRAY<STRING>")
FRAMES = (
    f"input_id STRING, frame_ts TIMESTAMP_NTZ, crs {CRS}, x_min DOUBLE, y_max DOUBLE, px DOUBLE, py DOUBLE, "
    "width INT, height INT, quantity STRING"
)
CELLS = ("input_id STRING, frame_ts TIMESTAMP_NTZ, row INT, col INT, value DOUBLE")
FORECAST_CELLS = (
    "forecast_id STRING, issue_ts TIMESTAMP_NTZ, lead_min INT, valid_ts TIMESTAMP_NTZ, row INT, col INT, value FLOAT"
)
REMOTE_FILES = (
    "input_id STRING, frame_ts TIMESTAMP_NTZ, url STRING, filename STRING, metadata MAP<STRING, STRING>"
)
LOCAL_FILES = ("input_id STRING, path STRING, filename STRING, length BIGINT, modified TIMESTAMP_NTZ")
UPLOAD_STATE = ("path STRING, size BIGINT, mtime_ns BIGINT")
NOTIFICATIONS = ("topic STRING, payload STRING, ts TIMESTAMP")
