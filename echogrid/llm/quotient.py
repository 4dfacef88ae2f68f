"""Counting quotient filters: compact counters of wide integer keys that lose nothing.

A key of two halves is permuted by a Feistel network, which spreads any keys
evenly and can be undone.  The top bits of a permuted key name its shard, the
next ones are its quotient, the rest its remainder, which is kept in full: the
key can be read back and no two keys are ever taken for one.  A filter holds its
remainders in the order of the permuted keys, one bit a quotient that says
whether it occurs, one bit an entry that ends the run of a quotient, and the
counts as variable-length integers.  As filters are sorted, those of several
shards of the input merge in one pass.
"""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from .text import read_varints, varints

# Fixed odd multipliers and round keys; any others would do.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
BLEND = np.uint64(0xBF58476D1CE4E5B9)
ROUNDS = tuple(np.uint64(k) for k in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89))
WIDEST = 60  # bits of a half
_HEAD = "<BBBQQ"


def _mix(values: np.ndarray, key: np.uint64, half: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (values + key) * SPREAD
        out = (out ^ (out >> np.uint64(32))) * BLEND
    return out >> np.uint64(64 - half)


def permute(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for key in ROUNDS:
        left, right = right, left ^ _mix(right, key, half)
    return left, right


def restore(left: np.ndarray, right: np.ndarray, half: int) -> tuple[np.ndarray, np.ndarray]:
    for key in reversed(ROUNDS):
        left, right = right ^ _mix(left, key, half), left
    return left, right


def half_width(bits: int, length: int) -> int:
    """Bits of each half of a key that packs ``length`` numbers of ``bits`` bits."""
    half = max(1, -(-bits * length // 2))
    if half > WIDEST:
        raise ValueError(f"{length} numbers of {bits} bits are more than {2 * WIDEST} bits")
    return half


def pack(columns: list[np.ndarray], bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of keys that hold one number of each column, the first in the lowest bits."""
    left, right = (np.zeros(len(columns[0]), np.uint64) for _ in "lr")
    mask = np.uint64((1 << half) - 1)
    for k, column in enumerate(columns):
        at, value = k * bits, column.astype(np.uint64)
        if at < half:
            right |= value << np.uint64(at) & mask
            left |= value >> np.uint64(half - at) if at + bits > half else np.uint64(0)
        else:
            left |= value << np.uint64(at - half)
    return left, right


def unpack(left: np.ndarray, right: np.ndarray, bits: int, half: int, length: int) -> list[np.ndarray]:
    out, mask = [], np.uint64((1 << bits) - 1)
    for at in range(0, bits * length, bits):
        low = right >> np.uint64(at) if at < half else left >> np.uint64(at - half)
        out.append((low | left << np.uint64(half - at) if at < half < at + bits else low) & mask)
    return out


def _narrow(values: np.ndarray, bits: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-bits // 8)]).tobytes()


def _wide(raw: bytes, bits: int, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, : -(-bits // 8)] = np.frombuffer(raw, np.uint8).reshape(n, -(-bits // 8))
    return out.view("<u8").reshape(-1).astype(np.uint64)


class Filter(NamedTuple):
    """Entries in the order of their permuted keys."""

    half: int
    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray

    def split(self, bits: int) -> list[tuple[int, Filter]]:
        """The entries by the top ``bits`` bits of their keys; shards without entries are left out."""
        tops = (self.left >> np.uint64(self.half - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(tops, prepend=-1))
        ends = np.append(cuts[1:], len(tops))[: len(cuts)]
        return [(int(tops[a]), Filter(self.half, self.left[a:b], self.right[a:b], self.counts[a:b])) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]

    def to_bytes(self, bits: int = 0) -> bytes:
        """The filter of one shard, all of whose keys share their top ``bits`` bits."""
        n, shard = len(self.left), int(self.left[0]) >> (self.half - bits) if len(self.left) else 0
        quotient_bits = min(self.half - bits, max(0, n.bit_length() - 1))
        rest = self.half - bits - quotient_bits
        quotients = (self.left >> np.uint64(rest) & np.uint64((1 << quotient_bits) - 1)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        ends = np.append(np.diff(quotients) != 0, True)[:n]
        low = self.left & np.uint64((1 << rest) - 1)
        if rest + self.half <= 64:
            remainders = _narrow(low << np.uint64(self.half) | self.right, rest + self.half)
        else:
            remainders = _narrow(low, rest) + _narrow(self.right, self.half)
        return struct.pack(_HEAD, self.half, bits, quotient_bits, n, shard) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + remainders + varints(self.counts)


class Packed:
    """A serialised filter: its bitmaps, remainders and counts."""

    def __init__(self, raw: bytes):
        self.half, self.bits, self.quotient_bits, n, self.shard = struct.unpack_from(_HEAD, raw)
        self.rest = self.half - self.bits - self.quotient_bits
        at = struct.calcsize(_HEAD)

        def take(size: int) -> bytes:
            nonlocal at
            at += size
            return raw[at - size : at]

        self.occupied = np.unpackbits(np.frombuffer(take(-(-(1 << self.quotient_bits) // 8)), np.uint8), count=1 << self.quotient_bits).astype(bool)
        self.ends = np.unpackbits(np.frombuffer(take(-(-n // 8)), np.uint8), count=n).astype(bool)
        if self.rest + self.half <= 64:
            both = _wide(take(n * -(-(self.rest + self.half) // 8)), self.rest + self.half, n)
            self.low, self.right = both >> np.uint64(self.half), both & np.uint64((1 << self.half) - 1)
        else:
            self.low, self.right = (_wide(take(n * -(-bits // 8)), bits, n) for bits in (self.rest, self.half))
        self.counts = read_varints(raw[at:]).astype(np.int64)

    def filter(self) -> Filter:
        """All entries; the quotient of an entry is the occupied one whose run it stands in."""
        run = np.cumsum(self.ends) - self.ends
        quotients = np.flatnonzero(self.occupied).astype(np.uint64)[run]
        top = np.uint64(self.shard) << np.uint64(self.half - self.bits) if self.bits else np.uint64(0)
        return Filter(self.half, top | quotients << np.uint64(self.rest) | self.low, self.right, self.counts)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Counts of permuted keys, 0 where there is none: the run of the quotient is found by rank and select, then read through."""
        out = np.zeros(len(left), np.int64)
        quotients = (left >> np.uint64(self.rest) & np.uint64((1 << self.quotient_bits) - 1)).astype(np.int64)
        here = (left >> np.uint64(self.half - self.bits) == np.uint64(self.shard)) if self.bits else np.ones(len(left), bool)
        low, run = left & np.uint64((1 << self.rest) - 1), np.cumsum(self.occupied) - 1
        stops = np.flatnonzero(self.ends) + 1
        live = np.flatnonzero(here & self.occupied[quotients])
        at = np.concatenate([[0], stops])[run[quotients[live]]]
        stop = stops[run[quotients[live]]] if len(stops) else at
        while len(live):
            same = (self.low[at] == low[live]) & (self.right[at] == right[live])
            out[live[same]] = self.counts[at[same]]
            at = at + 1
            on = ~same & (at < stop)
            live, at, stop = live[on], at[on], stop[on]
        return out


def count(left: np.ndarray, right: np.ndarray, half: int) -> Filter:
    """The filter of permuted keys, each counted as often as it occurs."""
    if 2 * half <= 64:
        keys, counts = np.unique(left << np.uint64(half) | right, return_counts=True)
        return Filter(half, keys >> np.uint64(half), keys & np.uint64((1 << half) - 1), counts)
    return merge([Filter(half, left, right, np.ones(len(left), np.int64))])


def merge(filters: list[Filter]) -> Filter:
    """One filter with the summed counts; sorted runs that lie behind each other merge in a stable sort."""
    half = filters[0].half
    left, right, counts = (np.concatenate([f[k] for f in filters]) for k in (1, 2, 3))
    order = np.argsort(left << np.uint64(half) | right, kind="stable") if 2 * half <= 64 else np.lexsort((right, left))
    left, right, counts = left[order], right[order], counts[order]
    fresh = np.ones(len(left), bool)
    fresh[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
    first = np.flatnonzero(fresh)
    return Filter(half, left[first], right[first], np.add.reduceat(counts, first) if len(first) else counts)
