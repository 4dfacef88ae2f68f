"""Classified cells as paletted PNG tiles, and such tiles read back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.grid import tile_of
from ..operators.tiles import column_array, with_keys

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
MAX_TILE = 256


def geobox_text(west: Column, south: Column, east: Column, north: Column) -> Column:
    """The bounds comment written into each image."""
    return F.concat(F.lit("GeoBox="), F.concat_ws(",", *[part.cast("string") for part in (west, south, east, north)]))


def paletted_png(
    indices: np.ndarray, colors: Sequence[tuple[int, int, int]], alphas: Sequence[int], comment: str | None = None
) -> bytes:
    """An 8-bit paletted PNG; ``alphas`` covers the leading palette entries."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        tagged = kind + body
        return len(body).to_bytes(4, "big") + tagged + zlib.crc32(tagged).to_bytes(4, "big")

    height, width = indices.shape
    # Each scanline starts with filter type 0.
    lines = np.zeros((height, width + 1), dtype=np.uint8)
    lines[:, 1:] = indices
    parts = [
        PNG_MAGIC,
        chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 3, 0, 0, 0)),
        chunk(b"PLTE", bytes(channel for color in colors for channel in color)),
        chunk(b"tRNS", bytes(alphas)),
    ]
    if comment is not None:
        parts.append(chunk(b"tEXt", b"Comment\x00" + comment.encode("latin-1")))
    parts += [chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)), chunk(b"IEND", b"")]
    return b"".join(parts)


class Image(NamedTuple):
    """What a paletted PNG holds."""

    indices: np.ndarray
    palette: list[tuple[int, int, int]]
    alphas: list[int]
    comments: dict[str, str]


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk; a wrong signature, checksum or end is an error."""
    if not data.startswith(PNG_MAGIC):
        raise ValueError("not a PNG")
    at, kind = len(PNG_MAGIC), b""
    while kind != b"IEND":
        size = int.from_bytes(data[at : at + 4], "big")
        tagged, check = data[at + 4 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4:
            raise ValueError("the PNG ends within a chunk")
        if zlib.crc32(tagged).to_bytes(4, "big") != check:
            raise ValueError(f"checksum of chunk {tagged[:4]!r}")
        kind, at = tagged[:4], at + 12 + size
        yield kind, tagged[4:]


def unfiltered(lines: np.ndarray) -> np.ndarray:
    """Scanlines of one byte a pixel, each behind its filter type, as the bytes before filtering."""
    height, width = lines.shape[0], lines.shape[1] - 1
    out = np.zeros((height + 1, width + 1), np.int64)  # a row above and a column before, all zero
    for y in range(1, height + 1):
        kind, line = int(lines[y - 1, 0]), lines[y - 1, 1:].astype(np.int64)
        if kind == 0:
            out[y, 1:] = line
        elif kind == 1:
            out[y, 1:] = np.cumsum(line) & 255
        elif kind == 2:
            out[y, 1:] = (line + out[y - 1, 1:]) & 255
        elif kind in (3, 4):
            for x in range(1, width + 1):
                left, above, corner = int(out[y, x - 1]), int(out[y - 1, x]), int(out[y - 1, x - 1])
                if kind == 3:
                    guess = (left + above) // 2
                else:
                    near = left + above - corner
                    guess = min((left, above, corner), key=lambda value: abs(near - value))
                out[y, x] = (line[x - 1] + guess) & 255
        else:
            raise ValueError(f"filter type {kind}")
    return out[1:, 1:].astype(np.uint8)


def read_png(data: bytes) -> Image:
    """An 8-bit paletted PNG without interlacing; text chunks by keyword."""
    parts: dict[bytes, list[bytes]] = {}
    for kind, body in png_chunks(data):
        parts.setdefault(kind, []).append(body)
    width, height, depth, color, _, _, interlaced = struct.unpack(">IIBBBBB", parts[b"IHDR"][0])
    if (depth, color, interlaced) != (8, 3, 0):
        raise ValueError(f"bit depth {depth}, color type {color}, interlacing {interlaced}")
    lines = np.frombuffer(zlib.decompress(b"".join(parts[b"IDAT"])), np.uint8).reshape(height, width + 1)
    palette = np.frombuffer(parts[b"PLTE"][0], np.uint8).reshape(-1, 3)
    comments = dict(body.decode("latin-1").split("\0", 1) for body in parts.get(b"tEXt", ()))
    return Image(unfiltered(lines), [tuple(rgb) for rgb in palette.tolist()], list(b"".join(parts.get(b"tRNS", ()))), comments)


def read_tiles(tiles: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What each tile shows: keys, ``idx, rgba, n`` for every index that it uses, ``height, width``, ``comment`` and ``error``.

    A tile that cannot be read is one row with its error.
    """
    names = list(keys)
    fields = "height INT, width INT, comment STRING, idx INT, rgba STRING, n BIGINT, error STRING"
    schema = T.StructType([*(tiles.schema[key] for key in names), *T.StructType.fromDDL(fields)])
    arrow = to_arrow_schema(schema)

    def shown(data: bytes) -> dict[str, list]:
        image = read_png(data)
        idx, n = np.unique(image.indices, return_counts=True)
        color = lambda i: "#" + bytes([*image.palette[i], image.alphas[i] if i < len(image.alphas) else 255]).hex()
        height, width = image.indices.shape
        same = {"height": height, "width": width, "comment": image.comments.get("Comment"), "error": None}
        return {name: [value] * len(idx) for name, value in same.items()} | {"idx": idx.tolist(), "rgba": [color(i) for i in idx.tolist()], "n": n.tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                try:
                    columns = shown(batch.column("png")[i].as_py())
                except Exception as problem:  # a bad tile must not stop the others
                    columns = {name: [None] for name in ("height", "width", "comment", "idx", "rgba", "n")} | {"error": [f"{type(problem).__name__}: {problem}"]}
                yield from with_keys(arrow, names, [batch.column(name)[i] for name in names], columns).to_batches()

    return tiles.select(*names, "png").mapInArrow(run, schema)


def geobox_numbers(comment: Column) -> dict[str, Column]:
    """West, south, east and north out of a bounds comment; NULL where it is none."""
    parts = F.split(F.regexp_extract(comment, "^GeoBox=([^,]+,[^,]+,[^,]+,[^,]+)$", 1), ",")
    return {name: F.try_element_at(parts, F.lit(k + 1)).try_cast("double") for k, name in enumerate(("west", "south", "east", "north"))}


def hex_rgb(color: str) -> tuple[int, int, int]:
    bare = color.lstrip("#")
    if len(bare) != 6:
        raise ValueError(f"expected #RRGGBB, got {color!r}")
    red, green, blue = bytes.fromhex(bare)
    return red, green, blue


def encode_tiles(
    classes: DataFrame,
    keys: Sequence[str],
    colors: Sequence[str],
    nodata_rgba: tuple[int, int, int, float] | None = None,
    tile: int = MAX_TILE,
    comment: str = "geobox",
) -> DataFrame:
    """One PNG per (keys, tile): ``tile_r, tile_c, height, width, png``.

    ``classes`` holds ``row, col, idx, out_height, out_width`` and optionally a
    comment column.  A group holds at most one tile of cells.  Cells absent from
    the table get the missing-data slot.
    """
    if tile > MAX_TILE:
        raise ValueError(f"tiles are at most {MAX_TILE} cells wide")
    names = list(keys)
    palette = [hex_rgb(color) for color in colors] + [(0, 0, 0)]
    alphas = [255] * len(colors) + [0]
    missing = len(colors)
    if nodata_rgba is not None:
        palette.append(nodata_rgba[:3])
        alphas.append(round(nodata_rgba[3] * 255))
        missing = len(colors) + 1
    has_comment = comment in classes.columns
    schema = T.StructType(
        [*(classes.schema[key] for key in names), *[T.StructField(n, T.IntegerType()) for n in ("tile_r", "tile_c", "height", "width")],
         T.StructField("png", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def run(group_key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tile_r, tile_c = group_key[len(names)].as_py(), group_key[len(names) + 1].as_py()
        h = min(tile, int(table.column("out_height")[0].as_py()) - tile_r * tile)
        w = min(tile, int(table.column("out_width")[0].as_py()) - tile_c * tile)
        indices = np.full((h, w), missing, dtype=np.uint8)
        indices[column_array(table, "row") - tile_r * tile, column_array(table, "col") - tile_c * tile] = column_array(table, "idx")
        text = table.column(comment)[0].as_py() if has_comment else None
        png = paletted_png(indices, palette, alphas, text)
        return with_keys(arrow, names, group_key, {"tile_r": [tile_r], "tile_c": [tile_c], "height": [h], "width": [w], "png": [png]})

    tiled = classes.withColumns({"tile_r": tile_of(F.col("row"), tile), "tile_c": tile_of(F.col("col"), tile)})
    return tiled.groupBy(*names, "tile_r", "tile_c").applyInArrow(run, schema)


def write_tiles(tiles: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    writer = tiles.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
