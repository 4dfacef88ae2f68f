"""Word splitting on flat byte buffers, shared by the operators that read whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20

# Byte tables: ASCII capitals become small, separators become a blank.
_SMALL = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SMALL = np.frombuffer(_SMALL, np.uint8)
SPACED = np.frombuffer(bytes(32 if b == 32 or 9 <= b <= 13 else _SMALL[b] for b in range(256)), np.uint8)
ALPHANUMERIC = np.frombuffer(bytes(_SMALL[b] if 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)), np.uint8)
CASED = np.frombuffer(bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256)), np.uint8)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of whole rows of about ``limit`` text bytes; a longer text stands alone."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, and the offsets of the rows; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def blocks(column: pa.Array, limit: int) -> Iterator[pa.Array]:
    """The text of a column of one row, cut in front of white space that follows a visible ASCII character into blocks of about ``limit`` bytes.

    An empty text is one empty block; a stretch without such a place stays whole.
    """
    data, _ = buffer(column)
    if len(data) <= limit:
        yield pa.array([data.tobytes()], pa.large_binary())
        return
    visible = (data > 32) & (data < 127)
    cuts = np.flatnonzero((SPACED[data[1:]] == 32) & visible[:-1]) + 1
    start = 0
    while start < len(data):
        if len(data) - start <= limit:
            stop = len(data)
        else:
            fit = int(np.searchsorted(cuts, start + limit, "right"))
            stop = int(cuts[fit - 1]) if fit and cuts[fit - 1] > start else int(cuts[fit]) if fit < len(cuts) else len(data)
        yield pa.array([data[start:stop].tobytes()], pa.large_binary())
        start = stop


def lengths(column: pa.Array) -> np.ndarray:
    return np.diff(buffer(column)[1])


class Words:
    """Words of a run of rows: packed bytes, offsets of words, and where each row's words start."""

    def __init__(self, column: pa.Array, table: np.ndarray):
        data, rows = buffer(column)
        data = table[data]
        held = data != 32
        fresh = held.copy()
        fresh[1:] &= ~held[:-1]
        edges = rows[:-1][np.diff(rows) > 0]
        fresh[edges] = held[edges]  # a word never runs on into the next row
        starts = np.flatnonzero(fresh)
        # the last byte of a word is held, and what follows it is not or begins anew
        final = held
        final[:-1] &= ~held[1:] | fresh[1:]
        self.packed = data[data != 32]
        self.offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(np.flatnonzero(final) + 1 - starts, out=self.offsets[1:])
        self.rows = np.searchsorted(starts, rows)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def array(self) -> pa.Array:
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(self.offsets), pa.py_buffer(self.packed)])

    def coded(self) -> tuple[np.ndarray, list[bytes]]:
        """A number per word, and the distinct words by number."""
        if not len(self):
            return np.zeros(0, np.int64), []
        found = self.array().dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()


def varint_sizes(values: np.ndarray) -> np.ndarray:
    """Bytes that each number takes in ``varints``."""
    sizes = np.ones(len(values), np.int64)
    for k in range(1, 10):
        more = values >= np.uint64(1) << np.uint64(7 * k)
        if not more.any():
            break
        sizes += more
    return sizes


def varints(values: np.ndarray) -> bytes:
    """Seven bits a byte, lowest first, the top bit set on all bytes but a number's last."""
    values = values.astype(np.uint64)
    sizes = varint_sizes(values)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    some = np.arange(len(values))
    while len(some):
        left = values[some]
        more = left >= 128
        out[starts[some]] = (left & np.uint64(127)) | (more.astype(np.uint64) << np.uint64(7))
        some = some[more]
        values[some] >>= np.uint64(7)
        starts[some] += 1
    return out.tobytes()


def read_varints(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    ends = np.flatnonzero(data < 128)
    if len(ends) == len(data):
        return data.astype(np.uint64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(data)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((data & 127).astype(np.uint64) << (7 * place).astype(np.uint64), starts)


def row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of each row's values; ``starts`` has one entry more than there are rows."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[starts[1:]] - total[starts[:-1]]


def segment_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``row_sums`` of floats, each row's summed by itself, so it does not depend on the rows beside it."""
    out = np.zeros(len(starts) - 1, values.dtype)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        out[full] = np.add.reduceat(values, starts[full])
    return out


def carried(docs: DataFrame, text_col: str, carry: list[str]) -> tuple[DataFrame, dict[str, str], list[str]]:
    """The text as ``body`` and the ``carry`` columns under names that cannot clash; those names, and their types for a schema.

    A carried text column is ``body`` itself, so that a text travels once.
    """
    names = {c: "body" if c == text_col else f"c{i}" for i, c in enumerate(carry)}
    rows = docs.select(F.col(f"`{text_col}`").alias("body"), *[F.col(f"`{c}`").alias(n) for c, n in names.items() if n != "body"])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows, names, [f"{n} {kinds[n]}" for n in names.values()]


def uncarried(rows: DataFrame, names: dict[str, str], *more: str) -> DataFrame:
    """The carried columns under their own names again, then ``more``."""
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()], *more)
