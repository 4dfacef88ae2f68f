"""Token counts by a finite-state tokenizer compiled from a byte-level BPE file.

Splitting into pieces is a deterministic transducer over character classes.  A
run of texts is cut into chunks; for each chunk the map from entry state to
exit state is found, the maps are composed by a parallel prefix scan, and each
chunk is then run once from its true state, emitting piece starts.  A distinct
piece is one transition, annotated with the number of tokens it emits; those
numbers are compiled from the merge table for all new pieces of a run at once,
those of long pieces in one sweep over the ranks.  A long text is cut in front
of white space, where a piece always begins.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

# Classes of characters.
LETTER, SUFFIX, R, V, L, E, NUMBER, BLANK, SPACE, APOSTROPHE, OTHER, RESET = range(12)
# States; those from PENDING_R on wait for the second letter of a contraction.
FRESH, LETTERS, NUMBERS, OTHERS, QUOTE, BLANK_ONE, BLANK_MORE, SPACE_ONE, SPACE_MORE, PENDING_R, PENDING_V, PENDING_L = range(12)
HERE, BEFORE = 1, 2  # a piece starts at this character, at the one before
LETTERLIKE = (LETTER, SUFFIX, R, V, L, E)
CHUNK = 64
LONG_PIECE = 64  # bytes; longer pieces are merged rank by rank, all of them together
RANK_STEP = 1024  # ranks that a sweep takes before it sorts what it has put off
NEVER = np.int32(2**31 - 1)  # the rank of a pair that has no merge


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and emission; the pieces are those of the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|spaces not before a non-space|spaces.
    """
    run = {NUMBER: NUMBERS, OTHER: OTHERS, APOSTROPHE: OTHERS} | dict.fromkeys(LETTERLIKE, LETTERS)
    if kind == RESET:
        return FRESH, BEFORE if state >= PENDING_R else 0
    if state >= PENDING_R:
        if (state, kind) in ((PENDING_R, E), (PENDING_V, E), (PENDING_L, L)):
            return FRESH, 0
        after, emitted = _step(LETTERS, kind)  # the letter before starts a piece after all
        return after, emitted | BEFORE
    if state == QUOTE:
        if kind == SUFFIX:
            return FRESH, 0
        if kind in (R, V, L):
            return {R: PENDING_R, V: PENDING_V, L: PENDING_L}[kind], 0
        return _step(OTHERS, kind)
    blank = state in (BLANK_ONE, BLANK_MORE)
    if blank or state in (SPACE_ONE, SPACE_MORE):
        if kind in (BLANK, SPACE):
            return (BLANK_MORE if kind == BLANK else SPACE_MORE), 0
        split = BEFORE if state in (BLANK_MORE, SPACE_MORE) else 0
        if blank:  # this blank is one plain space, which opens the piece
            return run[kind], split
        return (QUOTE if kind == APOSTROPHE else run[kind]), split | HERE
    if kind in (BLANK, SPACE):
        return (BLANK_ONE if kind == BLANK else SPACE_ONE), HERE
    if run[kind] == state:
        return state, 0
    return (QUOTE if kind == APOSTROPHE else run[kind]), HERE


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """Next states and emissions by [class, state]."""
    table = np.array([[_step(s, k) for s in range(12)] for k in range(12)], np.uint8)
    return np.ascontiguousarray(table[:, :, 0]), np.ascontiguousarray(table[:, :, 1])


def character_classes() -> np.ndarray:
    """Class of every code point: letters, numbers and white space by Unicode category."""
    out = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            out[point] = LETTER
        elif kind == "N":
            out[point] = NUMBER
        elif kind == "Z":
            out[point] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    out[32], out[39] = BLANK, APOSTROPHE
    for letters, kind in (("stmd", SUFFIX), ("r", R), ("v", V), ("l", L), ("e", E)):
        out[[ord(c) for c in letters]] = kind
    return out


def emissions(kinds: np.ndarray, after: np.ndarray, emits: np.ndarray) -> np.ndarray:
    """What the transducer emits at each character, entered in FRESH.

    Chunks are columns; all of them advance together, first from all states at
    once to get their maps, then from the states that the scan gives.
    """
    n = len(kinds)
    columns = -(-n // CHUNK)
    padded = np.full(columns * CHUNK, RESET, np.uint8)
    padded[:n] = kinds
    lanes = np.ascontiguousarray(padded.reshape(columns, CHUNK).T)
    flat_after, flat_emits = after.reshape(-1), emits.reshape(-1)
    maps = np.broadcast_to(np.arange(12, dtype=np.uint8)[:, None], (12, columns))
    for row in lanes:
        maps = flat_after.take(row.astype(np.int16)[None, :] * 12 + maps)
    reach = 1
    while reach < columns:  # prefix scan: maps of runs of chunks, doubled each time
        later = np.take_along_axis(maps[:, reach:], maps[:, :-reach].astype(np.intp), axis=0)
        maps = np.concatenate([maps[:, :reach], later], axis=1)
        reach *= 2
    state = np.concatenate([[FRESH], maps[FRESH, :-1]]).astype(np.uint8)
    out = np.empty_like(lanes)
    for k, row in enumerate(lanes):
        at = row.astype(np.int16) * 12 + state
        out[k] = flat_emits.take(at)
        state = flat_after.take(at)
    return out.T.reshape(-1)[:n]


class Merges:
    """Ranks of a byte-level BPE and the token counts of pieces."""

    def __init__(self, ranked: list[tuple[bytes, bytes]]):
        ids = {bytes([b]): b for b in range(256)}
        keys, made = [], []
        self.ordered, last = True, dict.fromkeys(range(256), -1)  # whether no merge comes before those that make its sides
        for rank, (a, b) in enumerate(ranked):
            self.ordered &= max(last[ids[a]], last[ids[b]]) < rank
            keys.append(ids[a] << 32 | ids[b])
            made.append(ids.setdefault(a + b, len(ids)))
            last.setdefault(made[-1], rank)
        keys = np.array(keys, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), np.array(made, np.int64)
        self.twice = np.array([a == b for a, b in ranked], bool)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each neighbouring pair; NEVER where there is no merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def counts(self, packed: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each piece, of all short ones together and of all long ones together."""
        sizes = np.diff(offsets)
        out = sizes.copy()
        long = (sizes > LONG_PIECE) & self.ordered
        for which, merged in ((np.flatnonzero((sizes > 1) & ~long), self.rounds), (np.flatnonzero(long), self.sweep)):
            if len(which):
                pick = np.zeros(len(sizes), bool)
                pick[which] = True
                out[which] = merged(packed[np.repeat(pick, sizes)], sizes[which])
        return out

    def rounds(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of short pieces: in every round each merges its best pair, the leftmost of equals, until none can."""
        symbols, owner, out = data.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), sizes.copy()
        ranks = self._at(symbols, owner, np.arange(len(symbols)))
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(ranks, starts)
            group = np.cumsum(np.diff(owner, prepend=-1) != 0) - 1
            hit = np.flatnonzero((ranks == best[group]) & (ranks < NEVER))
            hit = hit[np.diff(group[hit], prepend=-1) != 0]
            out[owner[hit]] -= 1
            symbols[hit] = self.made[ranks[hit]]
            stay = np.ones(len(symbols), bool)
            stay[hit + 1] = False
            live = np.zeros(len(starts), bool)
            live[group[hit]] = True  # a piece without a merge is done
            stay &= live[group]
            new = np.cumsum(stay) - 1
            touched = new[hit]
            symbols, owner, ranks = symbols[stay], owner[stay], ranks[stay]
            for at in (touched, touched - 1):
                at = at[(at >= 0)]
                ranks[at] = self._at(symbols, owner, at)
        return out

    def _at(self, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        after = np.minimum(at + 1, len(symbols) - 1)
        found = self.rank(symbols[at], symbols[after])
        return np.where((owner[at] == owner[after]) & (at < after), found, NEVER)

    def sweep(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Tokens of long pieces: symbols are linked lists, and the ranks are taken in order.

        A merge makes pairs of later ranks only, so all pairs of a rank merge in
        one step, from the left where they overlap, and a position is looked at
        as often as its pair changes.  New pairs wait: those that come up within
        RANK_STEP by rank, the others together until the next sort.
        """
        n = len(data)
        ends = np.cumsum(sizes)
        symbols = data.astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[ends - 1], before[ends - sizes] = -1, -1
        ranks = np.full(n, NEVER)
        linked = np.flatnonzero(after >= 0)
        ranks[linked] = self.rank(symbols[linked], symbols[linked + 1])
        del linked
        alive = np.ones(n, bool)
        pending = [self._keys(ranks, np.flatnonzero(ranks < NEVER))]
        queue, at, limit = np.zeros(0, np.int64), 0, -1
        soon: list[int] = []
        near: dict[int, list[np.ndarray]] = {}
        while True:
            head = int(queue[at] >> 32) if at < len(queue) else int(NEVER)
            rank = min(head, soon[0]) if soon else head
            if rank > limit:
                queue, at = np.concatenate([queue[at:], *pending]), 0
                pending.clear()
                if not len(queue):
                    return np.add.reduceat(alive.astype(np.int64), ends - sizes)
                queue.sort(kind="stable")
                limit = int(queue[0] >> 32) + RANK_STEP
                continue
            stop = at + int(np.searchsorted(queue[at:], (rank + 1) << 32))
            spots, at = queue[at:stop] & 0xFFFFFFFF, stop
            if soon and soon[0] == rank:
                heapq.heappop(soon)
                spots = np.concatenate([spots, *near.pop(rank)])
            spots = np.unique(spots[ranks[spots] == rank])
            if not len(spots):
                continue
            if self.twice[rank] and len(spots) > 1:  # of pairs that overlap in a chain, every other one
                chain = np.flatnonzero(np.append(True, after[spots[:-1]] != spots[1:]))
                place = np.arange(len(spots)) - np.repeat(chain, np.diff(np.append(chain, len(spots))))
                spots = spots[place % 2 == 0]
            gone = after[spots]
            far = after[gone]
            symbols[spots], after[spots] = self.made[rank], far
            held = far >= 0
            before[far[held]] = spots[held]
            ranks[gone], alive[gone] = NEVER, False
            left = before[spots]
            touched = np.concatenate([spots, left[left >= 0]])
            right = after[touched]
            ranks[touched] = np.where(right >= 0, self.rank(symbols[touched], symbols[np.maximum(right, 0)]), NEVER)
            keys = np.unique(self._keys(ranks, touched[ranks[touched] < NEVER]))
            cut = int(np.searchsorted(keys, (limit + 1) << 32))
            if cut < len(keys):
                pending.append(keys[cut:])
            if cut:
                own = (keys[:cut] >> 32).astype(np.int64)
                edges = np.flatnonzero(np.diff(own, prepend=-1))
                for first, spot in zip(own[edges].tolist(), np.split(keys[:cut] & 0xFFFFFFFF, edges[1:]), strict=True):
                    if first not in near:
                        near[first] = []
                        heapq.heappush(soon, first)
                    near[first].append(spot)

    @staticmethod
    def _keys(ranks: np.ndarray, spots: np.ndarray) -> np.ndarray:
        return ranks[spots].astype(np.int64) << 32 | spots


def read_tokenizer(path: str) -> tuple[list[tuple[bytes, bytes]], list[str]]:
    """Merges as byte strings in rank order, and the special strings, from a tokenizer file."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    decode = lambda token: bytes(letters[c] for c in token)
    return [(decode(a), decode(b)) for a, b in held["model"]["merges"]], [t["content"] for t in held["added_tokens"] if t["special"]]


class Counter:
    """The compiled tokenizer."""

    def __init__(self, merges: list[tuple[bytes, bytes]], special: list[str]):
        self.merges = Merges(merges)
        self.special = [s.encode() for s in special]
        self.after, self.emits = transducer()
        self.classes = character_classes()

    def __call__(self, column: pa.Array) -> np.ndarray:
        """Tokens of every row; null counts as empty."""
        data, rows = text.buffer(column)
        cuts, tokens = self._special(data, rows)
        if len(cuts):  # a special string is one token, and the text goes on afresh behind it
            inside = np.zeros(len(data) + 1, np.int8)
            np.add.at(inside, cuts[:, 0], 1)
            np.add.at(inside, cuts[:, 1], -1)
            plain = np.cumsum(inside[:-1]) == 0
            moved = np.append(np.cumsum(plain) - plain, plain.sum())
            pieces = self._pieces(data[plain], np.unique(np.concatenate([moved[rows], moved[cuts[:, 0]]])))
            return tokens + self._sums(*pieces, moved[rows])
        return self._sums(*self._pieces(data, rows), rows)

    def _special(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of special strings, leftmost first, within a row each; and their number by row."""
        raw, spans = data.tobytes(), []
        for mark in self.special:
            at = raw.find(mark)
            while at >= 0:
                row = np.searchsorted(rows, at, "right") - 1
                if at + len(mark) <= rows[row + 1]:
                    spans.append((at, -len(mark), row))
                at = raw.find(mark, at + 1)
        counts, kept, end = np.zeros(len(rows) - 1, np.int64), [], 0
        for at, size, row in sorted(spans):
            if at >= end:
                end = at - size
                kept.append((at, end))
                counts[row] += 1
        return np.array(kept, np.int64).reshape(-1, 2), counts

    def _pieces(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start of every piece, and its number of tokens; the text starts afresh at ``cuts``."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = self._points(data, lead)
        kinds = self.classes[points]
        # one RESET before each cut
        at = np.searchsorted(lead, cuts[(cuts >= 0) & (cuts < len(data))])
        at = np.unique(at)
        spots = np.insert(np.arange(len(lead)), at, -1)
        emitted = emissions(np.insert(kinds, at, RESET), self.after, self.emits)
        before = np.flatnonzero(emitted & BEFORE) - 1
        starts = np.unique(np.concatenate([spots[np.flatnonzero(emitted & HERE)], spots[before]]))
        starts = lead[starts]
        return starts, self._tokens(data, starts)

    def _points(self, data: np.ndarray, lead: np.ndarray) -> np.ndarray:
        points = data[lead].astype(np.int32)
        wide = np.flatnonzero(points >= 0x80)
        first, at = points[wide], lead[wide]
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        value = np.where(size == 2, first & 0x1F, np.where(size == 3, first & 0x0F, first & 0x07))
        for k in (1, 2, 3):
            more = size > k
            value[more] = value[more] << 6 | (data[np.minimum(at[more] + k, len(data) - 1)] & 0x3F)
        points[wide] = value
        return points

    def _tokens(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        offsets = np.append(starts, len(data)).astype(np.int64)
        held = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])
        found = held.dictionary_encode()
        packed, ends = text.buffer(found.dictionary)
        return self.merges.counts(packed, ends)[found.indices.to_numpy()]

    @staticmethod
    def _sums(starts: np.ndarray, tokens: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return text.row_sums(tokens, np.searchsorted(starts, rows))


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes`` and ``n_tokens`` of every row's whole text, in time linear in it.

    The merge table is read on the driver and travels with the task (its size
    is that of the tokenizer, not of the data).  Special strings in a text are
    one token each, no token is added at either end.

    A null text counts as empty, with no tokens.  Rows that repeat are counted
    each; an empty table gives no rows.  A text over a slice is counted block
    by block, and one piece of any length is merged in one sweep.  Other
    columns are not read.
    """
    merges, special = read_tokenizer(tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter(merges, special)
        limit = 1 << 62 if any(c.isspace() for mark in special for c in mark) else text.SLICE_BYTES  # no cut within a special string
        for part in text.slices(batches, "body"):
            body = part.column("body")
            tokens = count(body) if part.num_rows > 1 else np.array([sum(int(count(block)[0]) for block in text.blocks(body, limit))])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(text.lengths(body), pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, n_bytes long, n_tokens long")
