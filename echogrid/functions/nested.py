"""JSON texts parsed whole, to any depth."""

from __future__ import annotations

import json
import re

import numpy as np

LEVELS = 250  # nodes within nodes that one call of the parser gets
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, np.int8)
_STEP[list(b"{[")], _STEP[list(b"}]")] = 1, -1


def _cuts(raw: bytes) -> list[tuple[int, int, bool]]:
    """First and last byte of every node that opens a multiple of ``LEVELS`` deep, and (False) of every NaN, by where they end."""
    codes = np.frombuffer(_ESCAPE.sub(b"__", raw), np.uint8)
    outside = np.cumsum(codes == ord('"'), dtype=np.uint8) % 2 == 0
    at = np.flatnonzero((_STEP[codes] != 0) & outside)
    step = _STEP[codes[at]].astype(np.int64)
    depth = np.cumsum(step)  # of an opening mark, the node's own
    if len(depth) and (depth.min() < 0 or depth[-1] != 0):
        raise ValueError("brackets do not match")
    own = depth + (step < 0)
    edge = own % LEVELS == 0
    found, opened = [], []
    for place, sign in zip(at[edge].tolist(), step[edge].tolist(), strict=True):
        if sign > 0:
            opened.append(place)
        else:
            found.append((opened.pop(), place, True))
    unknown = np.flatnonzero((codes == ord("N")) & outside)
    found.extend((place, place + 2, False) for place in unknown.tolist() if raw[place : place + 3] == b"NaN")
    return sorted(found, key=lambda cut: cut[1])


def parse_deep(text: str) -> object:
    """What ``json.loads`` gives, with no nesting too deep.

    The text is cut at every ``LEVELS``-th level.  The inner pieces are parsed
    first; NaN stands for them in the piece around, whose parser asks for the
    value of each NaN in turn.
    """
    raw = text.encode("utf-8", "surrogatepass")
    wanted: list[object] = []

    def named(word: str) -> object:
        if word != "NaN":
            return float(word.replace("Infinity", "inf"))
        if not wanted:
            raise ValueError("a value within another token")
        return wanted.pop()

    decode = json.JSONDecoder(parse_constant=named).decode
    done: list[tuple[int, int, object]] = []  # values that no later piece holds yet
    for first, last, is_node in [*_cuts(raw), (0, len(raw) - 1, True)]:
        if not is_node:
            done.append((first, last, float("nan")))
            continue
        parts, end = [], last + 1
        while done and done[-1][0] >= first:
            begin, until, value = done.pop()
            parts += [raw[until + 1 : end], b"NaN"]
            wanted.append(value)
            end = begin
        parts.append(raw[first:end])
        value = decode(b"".join(reversed(parts)).decode("utf-8", "surrogatepass"))
        if wanted:
            raise ValueError("a value within another token")
        done.append((first, last, value))
    return done[-1][2]


def parsed(payload: str) -> object:
    """The payload's value; None if it is not JSON."""
    try:
        try:
            return json.loads(payload)
        except RecursionError:
            return parse_deep(payload)
    except ValueError:
        return None
