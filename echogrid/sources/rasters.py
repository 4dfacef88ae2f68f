"""Raster files: dataset selection, and a decode job that yields frames and cells.

A file is a header and blocks of rows, each a row of its own table: neither a
file nor a raster is ever one row.  Headers become frame records, of which the
dataset to read is chosen as data; blocks are unpacked by a decoder named by how
their file packs them, and decoded into values with their frame's factors.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.projection import forward, parse_proj4
from ..functions.values import linear_decode
from ..operators.skew import attach_by_key
from ..operators.tiles import cogrouped, column_array, with_keys
from ..session import cut_lineage

# Dataset products that are two-dimensional composites.
COMPOSITE_PRODUCTS = ("MAX", "MAXZ", "COMP", "SURF")


def select_dataset(datasets: DataFrame, keys: Sequence[str], quantity: str) -> DataFrame:
    """The dataset to read of each file: wanted quantity, composites first, then by name.

    Names compare as text.  A file without the quantity is an error that lists
    what it has; :func:`dataset_choices` reports instead.
    """
    choice = dataset_choices(datasets, keys, quantity)
    message = F.concat(F.lit(f"no dataset with quantity {quantity}; available: "), F.col("available"))
    return choice.where(F.assert_true(F.col("dataset").isNotNull(), message).isNull()).drop("available")


def dataset_choices(datasets: DataFrame, keys: Sequence[str], quantity: str) -> DataFrame:
    """Chosen ``dataset`` per file (NULL if none) and the quantities it has."""
    wanted = F.col("quantity") == quantity
    rank = F.struct(F.when(F.col("product").isin(*COMPOSITE_PRODUCTS), 0).otherwise(1), F.col("dataset"))
    return datasets.groupBy(*keys).agg(
        F.min_by(F.when(wanted, F.col("dataset")), F.when(wanted, rank)).alias("dataset"),
        F.array_join(F.array_sort(F.collect_set("quantity")), ",").alias("available"),
    )


# A decoder turns the bytes of a block of rows into its flat raw counts; it raises on a bad block.
Decoder = Callable[[bytes, str], np.ndarray]


def raw_block(content: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(content, dtype=dtype)


def deflated_block(content: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(content), dtype=dtype)


# How a file packs its blocks, as its header names it.
DECODERS: dict[str, Decoder] = {"raw": raw_block, "deflate": deflated_block}

DATASET = "STRUCT<name: STRING, product: STRING, quantity: STRING, gain: DOUBLE, offset: DOUBLE, nodata: DOUBLE, undetect: DOUBLE, dtype: STRING>"
HEADER = (
    "STRUCT<date: STRING, time: STRING, projdef: STRING, xsize: INT, ysize: INT, xscale: DOUBLE, yscale: DOUBLE, UL_lon: DOUBLE, UL_lat: DOUBLE, "
    f"packing: STRING, datasets: ARRAY<{DATASET}>>"
)


class Decoded(NamedTuple):
    """``frames``: one row per file with its georeference, factors and ``error``; ``cells``: those of the files without one."""

    frames: DataFrame
    cells: DataFrame


def frame_records(parts: DataFrame, keys: Sequence[str], quantity: str, projdefs: Sequence[str]) -> DataFrame:
    """One row per file from its header: time, grid, anchor in its own projection, and the chosen dataset's factors.

    A header that does not parse, a quantity that the file lacks and a projection
    that is not among ``projdefs`` are an ``error`` of that file only.
    """
    headers = parts.where(F.col("part") == 0).select(*keys, F.from_json(F.col("content").cast("string"), HEADER).alias("_h"))
    datasets = headers.select(*keys, F.explode("_h.datasets").alias("_d")).select(*keys, F.col("_d.name").alias("dataset"), *[f"_d.{name}" for name in ("product", "quantity", "gain", "offset", "nodata", "undetect", "dtype")])
    chosen = dataset_choices(datasets, keys, quantity)
    picked = datasets.withColumnRenamed("dataset", "_name").join(chosen, list(keys)).where(F.col("_name") == F.col("dataset"))
    factors = picked.groupBy(*keys).agg(F.first(F.struct("product", "quantity", "gain", "offset", "nodata", "undetect", "dtype")).alias("_f"))
    joined = headers.join(chosen, list(keys), "left").join(factors, list(keys), "left")
    stamp = F.try_to_timestamp(F.concat("_h.date", "_h.time"), F.lit("yyyyMMddHHmmss")).cast("timestamp_ntz")
    lacking = F.concat(F.lit(f"no dataset with quantity {quantity}; available: "), F.coalesce("available", F.lit("none")))
    error = F.when(F.col("_h.xsize").isNull() | F.col("_h.ysize").isNull() | stamp.isNull(), "incomplete header").when(F.col("dataset").isNull(), lacking)
    flat = joined.select(
        *keys, stamp.alias("frame_ts"), *[F.col(f"_h.{name}").alias(name) for name in ("projdef", "xsize", "ysize", "xscale", "yscale", "UL_lon", "UL_lat", "packing")],
        "dataset", "_f.*", error.alias("error"),
    )
    known = [forward(flat.where(F.col("projdef") == text), F.col("UL_lon"), F.col("UL_lat"), parse_proj4(text), ("x_min", "y_max")) for text in projdefs]
    rest = flat.where(~F.coalesce(F.col("projdef").isin(list(projdefs)), F.lit(False))).withColumns({"x_min": F.lit(None).cast("double"), "y_max": F.lit(None).cast("double")})
    everything = rest
    for some in known:
        everything = everything.unionByName(some)
    unplaced = F.when(F.col("x_min").isNull(), F.concat(F.lit("no place for projection "), F.coalesce("projdef", F.lit("NULL"))))
    return everything.withColumn("error", F.coalesce("error", unplaced)).drop("UL_lon", "UL_lat")


def decode_rasters(parts: DataFrame, keys: Sequence[str], quantity: str, projdefs: Sequence[str], decoders: dict[str, Decoder] = DECODERS) -> Decoded:
    """Frames and cells of all files.

    ``parts`` has (keys, part, dataset, first_row, n_rows, content): part 0 is the
    header as JSON, the others are blocks of rows.  Blocks of datasets that are
    not read are dropped before they are unpacked.  Cells have ``raw`` and the
    decoded ``value``: missing is NULL, clear sky minus infinity.
    """
    records = cut_lineage(frame_records(parts, keys, quantity, projdefs))
    names = list(keys)
    wanted = records.where("error IS NULL").select(*names, F.col("dataset").alias("_dataset"), "xsize", "ysize", "dtype", "packing", "gain", "offset", "nodata", "undetect")
    blocks = parts.where(F.col("part") > 0).select(*names, "part", "dataset", "first_row", "n_rows", "content")
    placed = attach_by_key(blocks, wanted, names, ["part"]).where(F.col("dataset") == F.col("_dataset"))
    factors = ["gain", "offset", "nodata", "undetect"]
    schema = T.StructType(
        [*(placed.schema[name] for name in [*names, *factors]), T.StructField("row", T.IntegerType()), T.StructField("col", T.IntegerType()), T.StructField("raw", T.DoubleType()), T.StructField("error", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = {name: batch.column(name)[i] for name in batch.schema.names}
                width, height, first = one["xsize"].as_py(), one["n_rows"].as_py(), one["first_row"].as_py()
                try:
                    raw = decoders[one["packing"].as_py()](one["content"].as_py(), one["dtype"].as_py())
                    if raw.size != height * width or first + height > one["ysize"].as_py():
                        raise ValueError(f"expected {height}x{width} values, found {raw.size}")
                    row, col = np.divmod(np.arange(raw.size), width)
                    columns = {"row": row + first, "col": col, "raw": raw.astype(np.float64), "error": [None] * raw.size}
                except Exception as problem:  # a bad file must not stop the others
                    columns = {"row": [None], "col": [None], "raw": [None], "error": [f"{type(problem).__name__}: {problem}"]}
                kept = [*names, *factors]
                yield from with_keys(arrow, kept, [one[name] for name in kept], columns).to_batches()

    decoded = cut_lineage(placed.mapInArrow(run, schema))
    failed = decoded.where("error IS NOT NULL").groupBy(*names).agg(F.min("error").alias("_failed"))
    frames = records.join(failed, names, "left").withColumn("error", F.coalesce("error", "_failed")).drop("_failed")
    value = linear_decode(F.col("raw"), F.col("gain"), F.col("offset"), F.col("nodata"), F.col("undetect"))
    cells = decoded.where("error IS NULL").join(failed.select(*names), names, "left_anti").select(*names, "row", "col", "raw", value.alias("value"))
    return Decoded(frames, cells)


def hdf5_parts(content: bytes, block_rows: int = 64) -> Iterator[dict]:
    """The parts of an HDF5 raster file, where h5py is installed: its header, then each dataset by slabs of rows."""
    import io

    import h5py

    text = lambda value: value.decode() if isinstance(value, bytes) else str(value)
    with h5py.File(io.BytesIO(content), "r") as source:
        what, where = source["what"].attrs, source["where"].attrs
        names = sorted(name for name in source if name.startswith("dataset"))
        datasets = []
        for name in names:
            own, data = source[f"{name}/data1/what"].attrs, source[f"{name}/data1/data"]
            product = text(source[f"{name}/what"].attrs.get("product", b""))
            datasets.append({"name": name, "product": product, "quantity": text(own["quantity"]), "dtype": data.dtype.str} | {k: float(own[k]) for k in ("gain", "offset", "nodata", "undetect")})
        header = {"date": text(what["date"]), "time": text(what["time"]), "projdef": text(where["projdef"]), "packing": "raw", "datasets": datasets}
        header |= {k: int(where[k]) for k in ("xsize", "ysize")} | {k: float(where[k]) for k in ("xscale", "yscale", "UL_lon", "UL_lat")}
        part = 0
        yield {"part": 0, "dataset": None, "first_row": None, "n_rows": None, "content": json.dumps(header).encode()}
        for name in names:
            data = source[f"{name}/data1/data"]
            for first in range(0, data.shape[0], block_rows):
                part, slab = part + 1, data[first : first + block_rows]
                yield {"part": part, "dataset": name, "first_row": first, "n_rows": len(slab), "content": np.ascontiguousarray(slab).tobytes()}


PARTS = "part INT, dataset STRING, first_row INT, n_rows INT, content BINARY"


def split_files(files: DataFrame, keys: Sequence[str], splitter: Callable[[bytes], Iterator[dict]] = hdf5_parts) -> DataFrame:
    """Whole files (``content``) as parts, a batch a part; a file that cannot be split has an empty header, which the decode job reports."""
    names = list(keys)
    schema = T.StructType([*(files.schema[name] for name in names), *T.StructType.fromDDL(PARTS)])
    arrow = to_arrow_schema(schema)
    fields = [field.name for field in T.StructType.fromDDL(PARTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values, found = [batch.column(name)[i] for name in names], False
                try:
                    for part in splitter(batch.column("content")[i].as_py()):
                        found = True
                        yield from with_keys(arrow, names, values, {name: [part[name]] for name in fields}).to_batches()
                except Exception:
                    if not found:
                        yield from with_keys(arrow, names, values, {"part": [0], "dataset": [None], "first_row": [None], "n_rows": [None], "content": [b"{}"]}).to_batches()

    return files.select(*names, "content").mapInArrow(run, schema)


def pack_rasters(cells: DataFrame, frames: DataFrame, keys: Sequence[str], block_rows: int = 64) -> DataFrame:
    """Files as parts: the inverse of decoding.

    ``frames`` has the keys, ``header`` (JSON text) and, for its blocks, ``xsize,
    ysize`` and ``datasets`` (structs of name, dtype and nodata); ``cells`` has
    (keys, dataset, row, col, raw).  Absent cells hold nodata.  A group is one
    block of rows.  Blocks are deflated.
    """
    names = list(keys)
    header = frames.select(*names, F.lit(0).alias("part"), F.lit(None).cast("string").alias("dataset"), *[F.lit(None).cast("int").alias(n) for n in ("first_row", "n_rows")], F.col("header").cast("binary").alias("content"))
    per_file = frames.select(*names, "xsize", "ysize", F.posexplode("datasets").alias("_n", "_d"))
    last = F.floor((F.col("ysize") - 1) / block_rows).cast("int")
    blocks = per_file.select(*names, "xsize", "ysize", "_n", F.col("_d.name").alias("dataset"), "_d.dtype", "_d.nodata", (last + 1).alias("_per"), F.explode(F.sequence(F.lit(0), last)).alias("_block"))
    tiled = cells.select(*names, "dataset", F.floor(F.col("row") / block_rows).cast("int").alias("_block"), "row", "col", "raw")
    schema = T.StructType([*(cells.schema[name] for name in names), *T.StructType.fromDDL(PARTS)])
    arrow = to_arrow_schema(schema)

    def run(group_key: tuple[pa.Scalar, ...], table: pa.Table, side: pa.Table) -> pa.Table:
        if not side.num_rows:
            return arrow.empty_table()
        own = {name: side.column(name)[0].as_py() for name in ("xsize", "ysize", "dtype", "nodata", "_n", "_per", "_side_dataset", "_side__block")}
        first = own["_side__block"] * block_rows
        rows = min(block_rows, own["ysize"] - first)
        data = np.full((rows, own["xsize"]), own["nodata"], dtype=own["dtype"])
        if table.num_rows:
            data[column_array(table, "row") - first, column_array(table, "col")] = column_array(table, "raw")
        part = 1 + own["_n"] * own["_per"] + own["_side__block"]
        return with_keys(arrow, names, group_key, {"part": [part], "dataset": [own["_side_dataset"]], "first_row": [first], "n_rows": [rows], "content": [zlib.compress(data.tobytes())]})

    packed = cogrouped(tiled, blocks, [*names, "dataset", "_block"]).applyInArrow(run, schema)
    return header.unionByName(packed)
