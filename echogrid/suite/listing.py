"""Queries over HTML listings, announcement payloads and chunk stores."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import registry
from ..functions import names
from ..sources import bundles, chunks, discovery, links, listing, rasters
from ..operators import cells as C
from ..session import cut_lineage
from . import query
from .raster import FRAME
from .views import CELLS, FILES, GRID, NOTES, OBS, SCAN, SETTLED, files, notifications, obs, scan, settled, table

_STRIPPED = r"""regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"""
_HREFS = rf"""hrefs AS (SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS raw FROM (SELECT page_id, url,
  regexp_extract_all({_STRIPPED}, '(?i)<a\s[^>]*?href\s*=\s*("[^"]+"|''[^'']+''|[^\s"''>]+)', 1) AS h FROM pages)),
lk AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, replace(trim(raw, '"'), '&amp;', '&') AS href,
  regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || replace(trim(raw, '"'), '&amp;', '&') AS link FROM hrefs
  UNION ALL SELECT page_id, CAST(pos AS INTEGER), href, 'https://odd.example' || href FROM (VALUES (-1, 0, '/yes.hdf'), (-1, 1, '/in.hdf'), (-1, 2, '/aé&.hdf'), (-1, 3, '/bare.hdf'),
    (-2, 0, '/yes.hdf'), (-2, 1, '/in.hdf')) o(page_id, pos, href))"""

# Pages that a pattern over tags gets wrong: other attributes that end in href, a bracket inside a value, numeric entities, no quotes.
_ODD_PAGES = (
    (-1, "https://odd.example/d/", """<a data-href="no.hdf" href="/yes.hdf">x</a><a title="a > b" HREF='/in.hdf'></a><a href="/&#x61;&eacute;&amp;.hdf"><a href=""><a name=x><A HREF=/bare.hdf><!-- <a href="/c"> --><script>'<a href="/s">'</script>"""),
    (-2, "https://odd.example/d/", '<link href="/l"><a class="href" href="/yes.hdf"><a id=1 href="/in.hdf" href="">'),
)


def odd_and_given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", "url", "html").union(spark.createDataFrame(_ODD_PAGES, "page_id long, url string, html string"))


@query("listing_hrefs", f"WITH {_HREFS} SELECT page_id, pos, href, link, list_last(string_split(link, '/')) AS filename FROM lk")
def listing_hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor of every page, resolved against the page's URL."""
    return listing.page_links(odd_and_given_pages(spark, sf_dir)).drop("url")


@query(
    "dedupe_last_wins",
    f"WITH {_HREFS} SELECT link AS url, arg_max(href, seq) AS href, arg_max(page_id, seq) AS page_id, min(seq).p AS first_page, min(seq).q AS first_pos FROM (SELECT *, {{'p': page_id, 'q': pos}} AS seq FROM lk) GROUP BY link",
)
def dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per URL over all pages: the last one's values at the first one's position."""
    rows = listing.page_links(odd_and_given_pages(spark, sf_dir)).select(F.col("link").alias("url"), "href", "page_id", F.struct("page_id", "pos").alias("seq"))
    found = listing.dedupe_by_url(rows, [], "seq")
    return found.select("url", "href", "page_id", F.col("seq.page_id").alias("first_page"), F.col("seq.pos").alias("first_pos"))


@query(
    "first_href_per_line",
    r"""WITH l AS (SELECT page_id, unnest(range(len(t))) AS line, unnest(t) AS text FROM (SELECT page_id, string_split_regex(html, '\r\n|\n|\r') AS t FROM pages)),
    h AS (SELECT page_id, CAST(line AS INTEGER) AS line, regexp_extract(text, '(?i)href="([^"]+)"', 1) AS href FROM l),
    n AS (SELECT *, list_last(string_split(href, '/')) AS filename FROM h WHERE href <> '')
    SELECT page_id % 10 AS source, filename, CAST(row_number() OVER (PARTITION BY page_id % 10 ORDER BY filename DESC) AS INTEGER) AS rank FROM (SELECT DISTINCT page_id % 10 AS page_id, filename FROM n) n
    QUALIFY rank <= 12""",
)
def first_href_per_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First link of each line, then the twelve greatest names per source."""
    lines = listing.first_href_per_line(table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("source"), "html"), suffixes=())
    return listing.newest_names(lines.select("source", "filename").distinct(), ["source"], 12)


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory listings of file names: each event rewrites its day's page with its own line."""
    day = F.date_format("slot_ts", "yyyyMMdd")
    page = F.concat(F.lit('<html><a href="../">up</a>\n<a href="'), "filename", F.lit('">'), "filename", F.lit("</a></html>"))
    url = F.concat(F.lit("https://data.example/radar/"), "input_id", F.lit("/"), day, F.lit("/"))
    return files(spark, sf_dir).select("input_id", url.alias("url"), page.alias("html"))


@query(
    "listed_files",
    f"""WITH {FILES} SELECT DISTINCT input_id, slot_ts AS frame_ts, 'https://data.example/radar/' || input_id || '/' || strftime(slot_ts, '%Y%m%d') || '/' || filename AS url, filename
    FROM files WHERE filename LIKE '%.hdf'""",
)
def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote files found in directory listings."""
    from .views import catalog_inputs

    found = listing.listed_files(listing_pages(spark, sf_dir), catalog_inputs(spark))
    return found.select("input_id", "frame_ts", "url", "filename")


@query(
    "url_parameters",
    r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([^?#]*)', 1) AS base, regexp_extract(url, '\?([^#]*)', 1) AS q, regexp_extract(url, '(#.*)$', 1) AS frag FROM pages),
    kv AS (SELECT *, list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT starts_with(x, 'page=')) AS rest, list_filter(string_split(q, '&'), lambda x: starts_with(x, 'page=')) AS hit FROM p)
    SELECT page_id, base || '?' || CASE WHEN len(hit) > 0 AND starts_with(q, 'page=') THEN array_to_string(list_concat(['page=' || (page_id % 9)], rest), '&')
      ELSE array_to_string(list_concat(rest, ['page=' || (page_id % 9)]), '&') END || '&bbox=5.5%2C46.0%2C24.2%2C55.2' || frag AS url FROM kv""",
)
def url_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page URLs with the page number replaced and a bounding box added."""
    box = listing.bounds_text(F.lit(5.5), F.lit(46.0), F.lit(24.2), F.lit(55.2))
    merged = listing.merge_query(F.col("url"), {"page": (F.col("page_id") % 9).cast("string"), "bbox": box})
    return table(spark, sf_dir, "pages").select("page_id", merged.alias("url"))


# --- announcements ---

_GOOD_NOTE = "event_id % 13 <> 0 AND event_id % 17 <> 0"


@query("payload_links", f"WITH {NOTES} SELECT event_id, CAST(0 AS INTEGER) AS pos, href, 'application/x-odim' AS type, 't' || (event_id % 3) AS title, CAST(event_id % 100 AS VARCHAR) AS length FROM notes WHERE {_GOOD_NOTE}")
def payload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all announcements, own and nested; bad payloads are skipped."""
    return links.payload_links(notifications(spark, sf_dir).select("event_id", "payload"))


@query(
    "topic_parse",
    f"""WITH {NOTES} SELECT event_id, CASE WHEN event_id % 19 <> 0 THEN 'eu.eumetnet' END AS authority, CASE WHEN event_id % 19 <> 0 THEN loc END AS location,
    CASE WHEN event_id % 19 <> 0 THEN qty END AS quantity, {_GOOD_NOTE} AS is_object FROM notes""",
)
def topic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = notifications(spark, sf_dir).select(
        "event_id", names.topic_parts(F.col("topic")).alias("p"), names.is_json_object(F.col("payload")).alias("is_object")
    )
    return parsed.select("event_id", "p.authority", "p.location", "p.quantity", "is_object")


@query(
    "announced_files",
    f"""WITH {NOTES}, m AS (SELECT *, list_last(string_split(href, '/')) AS filename FROM notes
      WHERE {_GOOD_NOTE} AND event_id % 19 <> 0 AND loc = '0-20010-0-OPERA' AND qty = 'DBZH' AND href LIKE '%.h5')
    SELECT 'opera_dbzh' AS input_id, time_bucket(INTERVAL 5 MINUTE, any_value(ts), TIMESTAMP '2000-01-01') AS frame_ts, href AS url, any_value(filename) AS filename, 't' || (max(event_id) % 3) AS title FROM m GROUP BY href""",
)
def announced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remote files announced to the inputs whose location and quantity match the topic."""
    from ..streaming.notifications import announced_links

    found = announced_links(notifications(spark, sf_dir), registry.inputs(spark), carry=("event_id",))
    rows = links.link_files(found, registry.inputs(spark), order=("event_id", "pos"))
    return rows.select("input_id", "frame_ts", "url", "filename", F.col("metadata")["title"].alias("title"))


@query(
    "feature_filter",
    """SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id % 2 = 0 AND user_id % 3 = 0 AND (event_id % 5 = 1 OR event_id % 5 = 3)""",
)
def feature_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog features by quantity, format, method, authority and platform prefix."""
    features = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("click", "view"), "DBZH").otherwise("TH").alias("standard_name"),
        F.when(F.col("user_id") % 2 == 0, "ODIM").otherwise("BUFR").alias("format"),
        F.lit("scan").alias("method"),
        F.when(F.col("user_id") % 3 == 0, "eu.eumetnet").alias("naming_authority"),
        F.get(F.array(*map(F.lit, ("[frabc]", "[debln]", "czbrd", "dkrom", "[plpoz]"))), (F.col("event_id") % 5).cast("int")).alias("platform_name"),
    )
    return links.feature_filter(features, "DBZH", "ODIM", "scan", "eu.eumetnet", ("de", "dk")).select("event_id")


@query(
    "lookback_window",
    f"""WITH {FILES}, w(input_id, m) AS (VALUES ('click', 120), ('error', 120), ('purchase', 30), ('signup', 1), ('view', 45))
    SELECT input_id, frame_ts, CAST(m AS INTEGER) AS window_min FROM (SELECT DISTINCT input_id, slot_ts AS frame_ts FROM files) JOIN w USING (input_id)
    WHERE frame_ts BETWEEN TIMESTAMP '2024-01-15 12:00:00' - INTERVAL 1 MINUTE * m AND TIMESTAMP '2024-01-15 12:00:00'""",
)
def lookback_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames inside each input's lookback, which retention may widen."""
    rows = [("click", 7200, 30), ("error", 7200, 10), ("purchase", None, 30), ("signup", 30, 0), ("view", 600, 45)]
    config = spark.createDataFrame(rows, "input_id string, retention_s int, lookback_min int")
    frames = files(spark, sf_dir).select("input_id", F.col("slot_ts").alias("frame_ts")).distinct()
    return links.lookback_filter(frames, config, "2024-01-15 12:00:00")


# --- chunk stores ---


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty stores; each one's newest valid time comes from a late order."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey")
    last = orders.groupBy((F.col("o_custkey") % 50).alias("store_id")).agg(F.max(F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderdate"))).alias("_last"))
    valid = F.timestamp_add("HOUR", F.lit(13), F.col("_last")) - F.expr("INTERVAL 30 DAYS")
    return last.select(
        "store_id", F.when(F.col("store_id") % 11 != 0, valid).alias("last_valid"), F.concat(F.lit("in"), F.col("store_id").cast("string")).alias("input_id"),
        F.lit("https://store.example/radar.zarr").alias("store_url"), F.lit("RR").alias("variable"),
    )


def store_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days each store has an order on, by day number."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate")
    day = F.datediff("o_orderdate", F.lit("1990-01-01").cast("date"))
    return orders.select((F.col("o_custkey") % 50).alias("store_id"), day.alias("idx"), F.col("o_orderdate").alias("axis_ts")).distinct()


_STORES = """ax AS (SELECT DISTINCT o_custkey % 50 AS store_id, o_orderdate AS axis_ts, CAST(date_diff('day', TIMESTAMP '1990-01-01', o_orderdate) AS INTEGER) AS idx FROM orders),
lv AS (SELECT o_custkey % 50 AS store_id, max(CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END) + INTERVAL 13 HOUR - INTERVAL 30 DAY AS last_valid FROM orders WHERE (o_custkey % 50) % 11 <> 0 GROUP BY ALL HAVING last_valid IS NOT NULL),
fr AS (SELECT store_id, coalesce(max(CASE WHEN axis_ts <= last_valid THEN idx END), min(idx)) AS frontier_idx FROM ax JOIN lv USING (store_id) GROUP BY ALL)"""


@query("asof_frontier", f"WITH {_STORES} SELECT fr.store_id, CAST(frontier_idx AS INTEGER) AS frontier_idx, axis_ts AS frontier_ts FROM fr JOIN ax ON ax.store_id = fr.store_id AND ax.idx = frontier_idx")
def asof_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last axis entry at or before each store's newest valid time."""
    return chunks.frontier(store_axis(spark, sf_dir), stores(spark, sf_dir))


@query(
    "store_frames",
    f"""WITH {_STORES} SELECT 'in' || store_id AS input_id, axis_ts AS frame_ts, 'https://store.example/radar.zarr/RR/' || idx || '.0.0' AS url,
    'in' || store_id || '_' || strftime(axis_ts, '%Y%m%d%H%M%S') || '.h5' AS filename FROM ax JOIN fr USING (store_id) WHERE idx <= frontier_idx AND idx > frontier_idx - 12""",
)
def store_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of the newest twelve axis steps of each store."""
    frames = chunks.store_frames(store_axis(spark, sf_dir), stores(spark, sf_dir), F.lit(chunks.DEFAULT_WINDOW))
    return frames.drop("metadata")


@query(
    "store_georeference",
    """SELECT s_suppkey, '+proj=tmerc +lat_0=42 +lon_0=12.5' AS projdef, CAST(1000 + s_suppkey AS INTEGER) AS xsize, CAST(1400 AS INTEGER) AS ysize, CAST(1000 AS DOUBLE) AS xscale, CAST(1000 AS DOUBLE) AS yscale,
    CAST(s_nationkey AS DOUBLE) AS ul_lon, CAST(47.5 AS DOUBLE) AS ul_lat, '<f4' AS dtype FROM supplier WHERE s_suppkey % 6 <> 0""",
)
def store_georeference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Georeferencing parsed from each store's metadata text; incomplete ones are left out."""
    crs = F.concat(
        F.lit('"crs/.zattrs":{"proj4":"+proj=tmerc +lat_0=42 +lon_0=12.5","where_xsize":'), (F.col("s_suppkey") + 1000).cast("string"),
        F.lit(',"where_ysize":1400,"where_xscale":1000.0,"where_yscale":1000.0,"where_UL_lon":'), F.col("s_nationkey").cast("string"), F.lit(',"where_UL_lat":47.5}'),
    )
    array = F.lit('"RR/.zarray":{"dtype":"<f4"}')
    text = F.concat(F.lit('{"metadata":{'), F.when(F.col("s_suppkey") % 6 == 0, array).otherwise(F.concat(crs, F.lit(","), array)), F.lit("}}"))
    return chunks.georeference(table(spark, sf_dir, "supplier").select("s_suppkey", text.alias("zmetadata")), strict=False)


@query(
    "chunk_cells",
    """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(embedding) AS raw FROM embeddings)
    SELECT vec_id, CAST(pos // 8 AS INTEGER) AS "row", CAST(pos % 8 AS INTEGER) AS "col", raw FROM e""",
)
def chunk_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors read as eight-wide chunks: cells in row-major order."""
    source = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("data"), F.lit(8).alias("xsize"))
    return chunks.chunk_cells(source, ["vec_id"])


MERCATOR = "+proj=merc +lat_ts=0 +lon_0=0 +x_0=-1254222.15 +y_0=-6702777.85 +a=6378137 +b=6378137"
_FILES_OF = f"""WITH {SCAN}, f AS (SELECT k, CASE WHEN k % 7 = 3 THEN 'no dataset with quantity DBZH; available: TH' WHEN k % 5 = 4 THEN 'ValueError: expected 8x32 values, found 248' END AS error FROM (SELECT DISTINCT k FROM scan))"""


def raster_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each scan as a file of counts in blocks of eight rows.

    Two datasets carry reflectivity, of which the composite is the one to read,
    though its name comes later; every seventh file has another quantity only,
    and every fifth has a block that is cut short.
    """
    count = (
        F.when(F.col("value").isNull(), F.lit(255)).when(F.col("value") == float("-inf"), F.lit(0)).otherwise(((F.col("value") + 32) / 0.5).cast("int"))
    )
    cells = scan(spark, sf_dir).select("k", "row", "col", count.alias("raw"), F.explode(F.array(F.lit("dataset1"), F.lit("dataset2"))).alias("dataset"))
    shifted = cells.withColumn("raw", F.when(F.col("dataset") == "dataset2", F.col("raw")).otherwise(F.lit(7)))
    frames = scan(spark, sf_dir).select("k").distinct()
    quantity = F.when(F.col("k") % 7 == 3, "TH").otherwise("DBZH")
    dataset = lambda name, product: F.struct(
        F.lit(name).alias("name"), F.lit(product).alias("product"), quantity.alias("quantity"), F.lit(0.5).alias("gain"), F.lit(-32.0).alias("offset"),
        F.lit(255.0).alias("nodata"), F.lit(0.0).alias("undetect"), F.lit("|u1").alias("dtype"),
    )
    header = F.struct(
        F.date_format(F.timestamp_add("MINUTE", F.col("k") * 5, F.lit("2026-06-05 00:00:00").cast("timestamp_ntz")), "yyyyMMdd").alias("date"),
        F.date_format(F.timestamp_add("MINUTE", F.col("k") * 5, F.lit("2026-06-05 00:00:00").cast("timestamp_ntz")), "HHmmss").alias("time"),
        F.lit(MERCATOR).alias("projdef"), F.lit(GRID).alias("xsize"), F.lit(GRID).alias("ysize"), F.lit(1555.7).alias("xscale"), F.lit(1555.7).alias("yscale"),
        F.lit(11.2669).alias("UL_lon"), F.lit(51.4584).alias("UL_lat"), F.lit("deflate").alias("packing"), F.array(dataset("dataset1", "PPI"), dataset("dataset2", "MAX")).alias("datasets"),
    )
    described = frames.withColumn("_h", header).select("k", F.to_json("_h").alias("header"), "_h.xsize", "_h.ysize", "_h.datasets")
    # written once, as files are
    parts = cut_lineage(rasters.pack_rasters(shifted, described, ["k"], 8))
    short_block = F.udf(lambda content, cut: zlib.compress(zlib.decompress(content)[:-8]) if cut else content, "binary")
    broken = F.coalesce((F.col("k") % 5 == 4) & (F.col("dataset") == "dataset2") & (F.col("first_row") == 16), F.lit(False))
    return parts.withColumn("content", short_block("content", broken))


@query(
    "raster_decode",
    f"""{_FILES_OF} SELECT s.k, "row", "col", CASE WHEN s.value IS NULL THEN 255::DOUBLE WHEN s.value = CAST('-Infinity' AS DOUBLE) THEN 0 ELSE (s.value + 32) * 2 END AS raw, {SETTLED}
    FROM (SELECT f.k, a.i AS "row", b.i AS "col", scan.value FROM f CROSS JOIN (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) t(i)) a CROSS JOIN (SELECT CAST(i AS INTEGER) AS i FROM range({GRID}) t(i)) b
      LEFT JOIN scan ON scan.k = f.k AND scan."row" = a.i AND scan."col" = b.i WHERE f.error IS NULL) s""",
)
def raster_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and decoded values of every cell of the files that decode."""
    return settled(rasters.decode_rasters(raster_files(spark, sf_dir), ["k"], "DBZH", [MERCATOR]).cells)


@query(
    "raster_frames",
    f"""{_FILES_OF} SELECT k, TIMESTAMP '2026-06-05' + INTERVAL 5 MINUTE * k AS frame_ts, CAST({GRID} AS INTEGER) AS xsize, CAST({GRID} AS INTEGER) AS ysize, 1555.7::DOUBLE AS xscale, 1555.7::DOUBLE AS yscale,
      round(6378137 * radians(11.2669::DOUBLE) - 1254222.15, 3) AS x_min, round(6378137 * ln(tan(pi() / 4 + radians(51.4584::DOUBLE) / 2)) - 6702777.85, 3) AS y_max,
      CASE WHEN k % 7 <> 3 THEN 'dataset2' END AS dataset, CASE WHEN k % 7 <> 3 THEN 'DBZH' END AS quantity, CASE WHEN k % 7 <> 3 THEN 0.5::DOUBLE END AS gain, CASE WHEN k % 7 <> 3 THEN -32.0::DOUBLE END AS "offset",
      CASE WHEN k % 7 <> 3 THEN 255.0::DOUBLE END AS nodata, CASE WHEN k % 7 <> 3 THEN 0.0::DOUBLE END AS undetect, error FROM f""",
)
def raster_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time, grid, anchor, chosen dataset and factors of every file, with what is wrong with it."""
    frames = rasters.decode_rasters(raster_files(spark, sf_dir), ["k"], "DBZH", [MERCATOR]).frames
    return frames.select(
        "k", "frame_ts", "xsize", "ysize", "xscale", "yscale", F.round("x_min", 3).alias("x_min"), F.round("y_max", 3).alias("y_max"), "dataset", "quantity", "gain", "offset", "nodata", "undetect", "error"
    )


@query(
    "batch_isolation",
    f"""{_FILES_OF} SELECT count(*) AS frames, count(CASE WHEN error IS NULL THEN 1 END) AS rendered, count(error) AS failed FROM f""",
)
def batch_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the batch above that decoded and that failed."""
    from ..plans.jobs import batch_result

    return batch_result(rasters.decode_rasters(raster_files(spark, sf_dir), ["k"], "DBZH", [MERCATOR]).frames, ["k"])


@query(
    "dataset_selection",
    """WITH d AS (SELECT l_orderkey, 'dataset' || (l_linenumber * 3) AS dataset, CASE l_returnflag WHEN 'A' THEN 'TH' ELSE 'DBZH' END AS quantity,
      CASE l_linestatus WHEN 'O' THEN CASE WHEN l_tax > 0.04 THEN 'MAX' ELSE 'PPI' END ELSE 'PPI' END AS product FROM lineitem),
    r AS (SELECT l_orderkey, dataset, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN product = 'MAX' THEN 0 ELSE 1 END, dataset) AS pos FROM d WHERE quantity = 'DBZH')
    SELECT d.l_orderkey, any_value(r.dataset) AS dataset, string_agg(DISTINCT d.quantity, ',' ORDER BY d.quantity) AS available FROM d LEFT JOIN r ON r.l_orderkey = d.l_orderkey AND r.pos = 1 GROUP BY ALL""",
)
def dataset_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset read of each file (an order with its lines), and what the file offers."""
    lines = table(spark, sf_dir, "lineitem")
    datasets = lines.select(
        "l_orderkey",
        F.concat(F.lit("dataset"), (F.col("l_linenumber") * 3).cast("string")).alias("dataset"),
        F.when(F.col("l_returnflag") == "A", "TH").otherwise("DBZH").alias("quantity"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") > 0.04), "MAX").otherwise("PPI").alias("product"),
    )
    return rasters.dataset_choices(datasets, ["l_orderkey"], "DBZH")


@query(
    "discovery_union",
    f"""WITH {FILES}, {_STORES}, lf AS (SELECT DISTINCT input_id, slot_ts AS frame_ts, 'https://data.example/radar/' || input_id || '/' || strftime(slot_ts, '%Y%m%d') || '/' || filename AS url, filename FROM files WHERE filename LIKE '%.hdf'),
    sf AS (SELECT 'in' || store_id AS input_id, axis_ts AS frame_ts, 'https://store.example/radar.zarr/RR/' || idx || '.0.0' AS url, 'in' || store_id || '_' || strftime(axis_ts, '%Y%m%d%H%M%S') || '.h5' AS filename FROM ax JOIN fr USING (store_id) WHERE idx <= frontier_idx AND idx > frontier_idx - 12),
    u AS (SELECT * FROM lf UNION ALL SELECT * FROM sf) SELECT * FROM u WHERE input_id <> 'error' QUALIFY row_number() OVER (PARTITION BY input_id ORDER BY frame_ts DESC, url) <= 10""",
)
def discovery_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of listings and stores together: enabled inputs, newest ten each."""
    from .views import catalog_inputs

    config = catalog_inputs(spark).withColumn("enabled", F.col("input_id") != "error")
    listed = listing.listed_files(listing_pages(spark, sf_dir), config)
    source = stores(spark, sf_dir)
    stored = chunks.store_frames(store_axis(spark, sf_dir), source, F.lit(chunks.DEFAULT_WINDOW))
    ids = source.select("input_id", F.lit(True).alias("enabled"))
    both = config.select("input_id", "enabled").unionByName(ids)
    return discovery.discover([listed, stored], both, limit=10).drop("metadata")


@query(
    "bundle_backlog",
    """WITH m AS (SELECT o_orderkey, date_trunc('day', o_orderdate) + INTERVAL 1 MINUTE * (o_orderkey % 1440) AS bts, l_linenumber * 10 - 20 AS off, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    t AS (SELECT DISTINCT o_orderkey, bts, off, l_quantity >= 10 AS labelled FROM m),
    done AS (SELECT DISTINCT 'radar_' || strftime(bts, '%Y%m%d_%H%M') || '_forecast_fct' || lpad(CAST(off AS VARCHAR), 2, '0') || '_' || v AS name FROM t, (VALUES ('overlay.png', 3), ('overlay2x.png', 2)) x(v, d) WHERE o_orderkey % d = 0 AND off >= 0)
    SELECT DISTINCT o_orderkey, bts AS bundle_ts, bts + INTERVAL 1 MINUTE * off AS member_ts, CAST(off AS INTEGER) AS offset_min FROM t
    WHERE labelled AND off >= 0 AND EXISTS (SELECT 1 FROM (VALUES ('overlay.png'), ('overlay2x.png')) x(v) WHERE 'radar_' || strftime(bts, '%Y%m%d_%H%M') || '_forecast_fct' || lpad(CAST(off AS VARCHAR), 2, '0') || '_' || v NOT IN (SELECT name FROM done))""",
)
def bundle_backlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundle members (order lines) still lacking a rendered variant."""
    members, done = bundle_tables(spark, sf_dir)
    return bundles.bundle_backlog(members, done).select("o_orderkey", "bundle_ts", "member_ts", "offset_min")


def bundle_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Members of bundles, each once with the key that tells it apart and its number of lines, and the names of written overlays, repeats included."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    start = F.timestamp_add("MINUTE", (F.col("o_orderkey") % 1440).cast("int"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz"))
    offset = (F.col("l_linenumber") * 10 - 20).cast("int")
    base = orders.join(lines, "o_orderkey").select("o_orderkey", start.alias("bts"), offset.alias("off"), (F.col("l_quantity") >= 10).alias("labelled"))
    member_ts = F.timestamp_add("MINUTE", F.col("off"), F.col("bts"))
    label = F.when(F.col("labelled"), F.concat(F.lit("_ft"), F.abs("off").cast("string"))).otherwise("")
    members = base.groupBy(*base.columns).agg(F.count("*").alias("lines")).select(
        "*",
        F.concat(F.lit("T_PABV23_C_OKPR_"), F.date_format("bts", "yyyyMMdd.HHmm"), F.lit(".ft60s10.tar")).alias("bundle"),
        F.concat(F.lit("T_PABV23_C_OKPR_"), F.date_format(member_ts, "yyyyMMddHHmmss"), label, F.lit(".hdf")).alias("member"),
    )
    written = [F.when(F.col("o_orderkey") % every == 0, names.overlay_name(F.col("bts"), F.lit(variant), F.col("off"))) for variant, every in (("overlay", 3), ("overlay2x", 2))]
    return members, base.where("off >= 0").select(F.explode(F.array(*written)).alias("name")).where(F.col("name").isNotNull())
