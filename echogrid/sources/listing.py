"""Links in HTML listings, URL resolution and query parameters."""

from __future__ import annotations

from collections.abc import Mapping
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import names

_LINE_HREF = r'(?i)href="([^"]+)"'


class _Anchors(HTMLParser):
    """Collects the ``href`` of every anchor; a parser, because attributes may hold any character."""

    def __init__(self) -> None:
        super().__init__()
        self.hrefs: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "a":
            self.hrefs += [value for name, value in attrs if name == "href" and value]


def _page_hrefs(html: str | None) -> list[str]:
    page = _Anchors()
    page.feed(html or "")
    return page.hrefs


def anchor_hrefs(html: Column) -> Column:
    """The ``href`` of every anchor of a page, in order, entities decoded; empty ones are left out."""

    @F.pandas_udf("array<string>")
    def hrefs(pages: pd.Series) -> pd.Series:
        return pages.map(_page_hrefs)

    return hrefs(html)


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(path, "/")
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda seen, part: F.when(part == "..", F.when(F.size(seen) > 1, F.slice(seen, 1, F.size(seen) - 1)).otherwise(seen))
        .when(part == ".", seen)
        .otherwise(F.concat(seen, F.array(part))),
    )
    text = F.array_join(kept, "/")
    closing = F.regexp_like(path, F.lit(r"/\.{1,2}$")) & ~F.endswith(text, F.lit("/"))
    return F.when(closing, F.concat(text, F.lit("/"))).otherwise(text)


def resolve_url(base: Column, href: Column) -> Column:
    """A link resolved against the page it stands on."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)?", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    tail = F.regexp_extract(href, r"^[^?#]*(.*)$", 1)
    target = F.regexp_extract(href, r"^([^?#]*)", 1)
    return (
        F.when(href == "", base)
        .when(F.regexp_like(href, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, _without_dots(target), tail))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .when(F.startswith(href, F.lit("#")), F.concat(origin, path, query, href))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, target)), tail))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: the page's columns but the HTML, ``pos``, ``href``, ``link``, ``filename``."""
    others = [name for name in pages.columns if name != "html"]
    exploded = pages.select(*others, F.posexplode(anchor_hrefs(F.col("html"))).alias("pos", "href"))
    resolved = exploded.withColumn("link", resolve_url(F.col("url"), F.col("href")))
    return resolved.withColumn("filename", names.filename_of(F.col("link")))


def listed_files(pages: DataFrame, inputs: DataFrame) -> DataFrame:
    """Remote files of HTML listing inputs; ``pages`` has (input_id, url, html).

    A page that was fetched again unchanged is parsed once; dealing pages out by
    what they hold also spreads a scan of few splits over all tasks.
    """
    config = inputs.select("input_id", "suffixes", "ts_pattern", "source_id")
    links = page_links(pages.select("input_id", "url", "html").distinct().join(F.broadcast(config), "input_id"))
    matching = F.exists("suffixes", lambda suffix: F.endswith(F.lower(F.col("filename")), suffix))
    stamped = links.where(matching).withColumn("frame_ts", names.parsed_timestamp(F.col("filename"), F.col("ts_pattern")))
    rows = stamped.where(F.col("frame_ts").isNotNull()).select(
        "input_id", "frame_ts", F.col("link").alias("url"), "filename",
        F.create_map(F.lit("source"), F.col("source_id")).alias("metadata"), "pos",
    )
    return dedupe_by_url(rows, ["input_id"], "pos")


def dedupe_by_url(rows: DataFrame, keys: list[str], seq: str, key: str = "url") -> DataFrame:
    """One row per URL: the last one's values at the first one's position."""
    others = [name for name in rows.columns if name not in (*keys, key, seq)]
    packed = F.max_by(F.struct(*others), F.col(seq)).alias("_row")
    folded = rows.groupBy(*keys, key).agg(packed, F.min(seq).alias(seq))
    return folded.select(*keys, key, *[F.col(f"_row.{name}").alias(name) for name in others], seq)


def first_href_per_line(pages: DataFrame, suffixes: tuple[str, ...] = (".hdf", ".tar")) -> DataFrame:
    """The older listing rule: first ``href`` of each line, wanted suffixes only."""
    others = [name for name in pages.columns if name != "html"]
    lines = pages.select(*others, F.posexplode(F.split("html", "\\R")).alias("line", "text"))
    href = lines.withColumn("href", F.regexp_extract("text", _LINE_HREF, 1)).where(F.col("href") != "")
    named = href.withColumn("filename", F.element_at(F.split("href", "/"), -1))
    if suffixes:
        named = named.where(F.lower("filename").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    return named.drop("text")


def newest_names(rows: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` greatest file names per key; ranks are limited before the shuffle."""
    order = W.partitionBy(*keys).orderBy(F.col("filename").desc())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def merge_query(url: Column, params: Mapping[str, str | Column]) -> Column:
    """The URL with the given parameters set, all others kept in place."""
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    plain = lambda text: F.url_decode(F.replace(text, F.lit("+"), F.lit(" ")))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda pair: pair != ""),
        lambda pair: F.struct(
            plain(F.regexp_extract(pair, r"^([^=]*)", 1)).alias("k"), plain(F.regexp_extract(pair, r"^[^=]*=(.*)$", 1)).alias("v")
        ),
    )
    given = F.array(
        *[F.struct(F.lit(k).alias("k"), (v if isinstance(v, Column) else F.lit(v)).alias("v")) for k, v in params.items()]
    )
    everything = F.concat(pairs, given)
    keys = F.array_distinct(F.transform(everything, lambda p: p.k))
    merged = F.transform(
        keys, lambda key: F.concat(F.url_encode(key), F.lit("="), F.url_encode(F.element_at(F.filter(everything, lambda p: p.k == key), -1).v))
    )
    return F.concat(base, F.lit("?"), F.array_join(merged, "&"), fragment)


def bounds_text(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.concat_ws(",", west.cast("string"), south.cast("string"), east.cast("string"), north.cast("string"))
