"""Timestamps, base names and paths as Column expressions.

Parsing goes through ``try_cast`` to TIMESTAMP_NTZ, so bad digits become NULL
under ANSI mode and the session time zone never shifts a value.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import parsed

_DIGITS = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})$"


def _from_digits(digits: Column) -> Column:
    return F.regexp_replace(digits, _DIGITS, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz")


def compact_timestamp(text: Column) -> Column:
    """First run of eight plus six digits in a name, or NULL."""
    return _from_digits(F.regexp_extract(text, r"\d{8}\d{6}", 0))


def dated_name_timestamp(text: Column) -> Column:
    """``yyyyMMddTHHmm[ss]`` in a name, else the compact form."""
    pattern = r"(\d{8})T(\d{4})(\d{2})?"
    seconds = F.regexp_extract(text, pattern, 3)
    digits = F.concat(
        F.regexp_extract(text, pattern, 1),
        F.regexp_extract(text, pattern, 2),
        F.when(seconds == "", "00").otherwise(seconds),
    )
    return F.when(F.regexp_like(text, F.lit(r"\d{8}T\d{4}")), _from_digits(digits)).otherwise(compact_timestamp(text))


def bundle_timestamp(text: Column) -> Column:
    """``yyyyMMdd.HHmm`` of a forecast bundle name."""
    stamp = F.regexp_extract(text, r"\d{8}\.\d{4}", 0)
    return _from_digits(F.concat(F.replace(stamp, F.lit("."), F.lit("")), F.lit("00")))


# Timestamp parsers an input may name in its ``ts_pattern`` column.
TIMESTAMP_PARSERS = {
    "compact": compact_timestamp,
    "dated": dated_name_timestamp,
    "bundle": bundle_timestamp,
}


def parsed_timestamp(text: Column, pattern: Column) -> Column:
    """Dispatch on the parser name held by each row; unknown names give NULL."""
    branches = [F.when(pattern == name, parser(text)) for name, parser in TIMESTAMP_PARSERS.items()]
    return F.coalesce(*branches)


def filename_of(path: Column) -> Column:
    """Last segment of a path or URL, without query and fragment."""
    bare = F.regexp_replace(path, r"[?#].*$", "")
    return F.element_at(F.split(bare, "/"), -1)


def suffix_of(filename: Column) -> Column:
    """Lower-cased last suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(filename, r"[^.](\.[^./]+)$", 1))


def base_name(prefix: Column, ts: Column) -> Column:
    return F.concat(prefix, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmm"))


def forecast_base_name(prefix: Column, issue_ts: Column, minute: Column) -> Column:
    return F.concat(base_name(prefix, issue_ts), F.lit("_fct"), minute.cast("string"))


def overlay_stem(ts: Column, offset: Column | None = None) -> Column:
    """What the overlay names of all variants begin with, with a two-digit offset for forecasts."""
    stamp = F.concat(F.lit("radar_"), F.date_format(ts, "yyyyMMdd_HHmm"))
    return stamp if offset is None else F.concat(stamp, F.format_string("_forecast_fct%02d", offset))


def overlay_ending(variant: Column) -> Column:
    return F.concat(F.lit("_"), variant, F.lit(".png"))


def overlay_name(ts: Column, variant: Column, offset: Column | None = None) -> Column:
    """Single-product overlay name, with a two-digit offset for forecasts."""
    return F.concat(overlay_stem(ts, offset), overlay_ending(variant))


# Base-name builders a product may name; each maps (prefix, timestamp) to text.
BASE_NAME_BUILDERS = {"timestamped": base_name}


def output_file_names(base: Column, variant_names: Column) -> Column:
    """The sidecar and one image per variant, as an array of file names."""
    images = F.transform(variant_names, lambda name: F.concat(base, F.lit("_"), name, F.lit(".png")))
    return F.concat(F.array(F.concat(base, F.lit(".json"))), images)


def _stamp_timestamp(stamp: Column) -> Column:
    minutes = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})$"
    seconds = r"^(\d{4})(\d{2})(\d{2})_(\d{2})(\d{2})(\d{2})$"
    return F.coalesce(
        F.regexp_replace(stamp, minutes, "$1-$2-$3 $4:$5:00").try_cast("timestamp_ntz"),
        F.regexp_replace(stamp, seconds, "$1-$2-$3 $4:$5:$6").try_cast("timestamp_ntz"),
    )


def base_timestamp(stem: Column, prefix: Column) -> Column:
    """Inverse of :func:`base_name`; NULL where the stem is not of this product."""
    marked = F.startswith(stem, F.concat(prefix, F.lit("_")))
    stamp = F.substring(stem, F.length(prefix) + 2, F.length(stem))
    valid = F.regexp_like(stamp, F.lit(r"^\d{8}_\d{4}(\d{2})?$"))
    return F.when(marked & valid, _stamp_timestamp(stamp))


def forecast_base_timestamp(stem: Column, prefix: Column) -> Column:
    """Issue time of a ``…_fct<minute>`` stem; NULL where the minute is not decimal."""
    observed = F.regexp_extract(stem, r"^(.*)_fct\d+$", 1)
    return F.when(observed != "", base_timestamp(observed, prefix))


def next_publish(ts: Column, period_s: Column) -> Column:
    """Strictly next multiple of the period counted from midnight."""
    period = F.greatest(period_s, F.lit(1)).cast("bigint")
    day = F.date_trunc("day", ts).cast("timestamp_ntz")
    elapsed = F.hour(ts).cast("bigint") * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    ahead = (F.floor(elapsed / period) + 1) * period
    return F.timestamp_add("SECOND", ahead.cast("int"), day)


def valid_time(issue_ts: Column, minute: Column) -> Column:
    return F.timestamp_add("MINUTE", minute, issue_ts)


def topic_parts(topic: Column) -> Column:
    """``STRUCT<authority, location, quantity>`` of a four-part topic, else NULL."""
    parts = F.split(topic, "/")
    wanted = (F.size(parts) == 4) & (F.get(parts, F.lit(0)) == "ORD")
    return F.when(
        wanted,
        F.struct(
            F.get(parts, F.lit(1)).alias("authority"),
            F.get(parts, F.lit(2)).alias("location"),
            F.get(parts, F.lit(3)).alias("quantity"),
        ),
    )


def is_json_object(payload: Column) -> Column:
    """True where the whole text parses as JSON, to any depth, and its top level is an object.

    Only texts that begin as an object are parsed.
    """

    @F.pandas_udf("boolean")
    def is_object(texts: pd.Series) -> pd.Series:
        return texts.map(lambda text: text is not None and isinstance(parsed(text), dict)).astype(bool)

    begins = F.startswith(F.ltrim(payload, F.lit(" \t\n\r")), F.lit("{"))
    return is_object(F.when(begins, payload))


# Content types by file suffix.
CONTENT_TYPES = {".png": "image/png", ".json": "application/json", ".hdf": "application/x-hdf"}


def content_type(filename: Column) -> Column:
    suffix = suffix_of(filename)
    result = F.lit("application/octet-stream")
    for name, kind in CONTENT_TYPES.items():
        result = F.when(suffix == name, kind).otherwise(result)
    return result


def object_key(prefix: Column, relative: Column) -> Column:
    """Prefix without outer slashes, a slash, the relative path; no prefix, no slash."""
    bare = F.regexp_replace(prefix, r"^/+|/+$", "")
    return F.when(bare == "", relative).otherwise(F.concat_ws("/", bare, relative))


def retry_delay(attempts: Column, base_s: float = 5.0, cap_s: float = 300.0) -> Column:
    """Seconds to wait after ``attempts`` failures: doubling, capped."""
    exponent = F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(10))
    return F.least(F.lit(base_s) * F.pow(F.lit(2.0), exponent), F.lit(cap_s))


# Frames to look for where an input keeps everything, by kind of source.
UNLIMITED_FRAMES = {"arco_zarr": 12}


def frame_budget(retention_s: Column, period_s: Column, source_kind: Column | None = None) -> Column:
    """Frames an input should hold: retention over period plus two.

    Without a retention it is the fixed number of the input's kind of source,
    or NULL for kinds without one.
    """
    period = F.greatest(period_s, F.lit(1))
    frames = F.greatest(F.lit(1), F.floor(retention_s / period) + 2)
    unlimited = F.lit(None)
    for kind, count in UNLIMITED_FRAMES.items() if source_kind is not None else ():
        unlimited = F.when(source_kind == kind, count).otherwise(unlimited)
    return F.when(retention_s.isNotNull(), frames).otherwise(unlimited).cast("int")
