"""SentencePiece encoding and decoding with the N best segmentations.

A text's piece lattice has a node between characters and an edge for each piece.
The text is cut before blanks and around control characters wherever no piece
runs over the cut, so the lattice is a series of short ones, one per chunk (mostly
a word with the blanks before it), and only distinct chunks are searched, as many
together as a lattice of bounded size holds.  Forward Viterbi scores of all its
chunks are found at once; they are the exact heuristic of a backward A-star search, which hands out a chunk's segmentations best first.  The N
best of a whole text change the chunks that lose least.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text

SCALE = 1 << 20  # scores are whole multiples of 1 / SCALE, so sums and ties are exact
UNKNOWN_GAP = 10.0  # how far below the worst piece a character without a piece stands
BEST = 4
SLICE_BYTES = 1 << 20  # of text that is encoded together, and of distinct chunks per lattice, whose edges take some hundred times that
REMEMBERED = 5_000  # chunks whose segmentations a task keeps between runs of rows, while they have SLICE_BYTES at most
MARK = "▁".encode()
_NONE = -(1 << 62)


class Pieces(NamedTuple):
    """A vocabulary: bytes and score of each piece (blank for the word mark), and the id of byte zero."""

    names: list[bytes]
    scores: np.ndarray
    usable: np.ndarray
    zero: int


def read_model(path: str) -> Pieces:
    """Pieces of a model file.  Merge-based models have ranks, not probabilities: by score, then id, the
    piece of rank r gets the log-probability of a Zipf law, -ln(r + 1) - ln(sum of 1 / (k + 1)).
    """
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.vocab_size())
    usable = np.array([not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in ids])
    zero = next(i for i in ids if model.is_byte(i))
    names = [bytes([i - zero]) if model.is_byte(i) else model.id_to_piece(i).encode().replace(MARK, b" ") for i in ids]
    worth = np.array([model.get_score(i) if usable[i] else -math.inf for i in ids])
    rank = np.empty(len(worth), np.int64)
    rank[np.argsort(-worth, kind="stable")] = np.arange(len(worth))
    total = math.log(sum(1 / (k + 1) for k in range(int(usable.sum()))))
    scores = np.where(usable, -np.log(rank + 1.0) - total, 0.0)
    return Pieces(names, np.rint(scores * SCALE).astype(np.int64), usable, zero)


class Trie:
    """Byte trie of the usable pieces as a sorted transition table."""

    def __init__(self, pieces: Pieces):
        moves: dict[int, int] = {}
        ends = {}
        for number, name in enumerate(pieces.names):
            if not pieces.usable[number]:
                continue
            node = 0
            for byte in name:
                node = moves.setdefault(node << 8 | byte, len(moves) + 1)
            ends[node] = number
        keys = np.array(sorted(moves), np.int64)
        self.keys, self.targets = keys, np.array([moves[k] for k in keys.tolist()], np.int64)
        self.piece = np.full(len(moves) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        # the first two bytes are looked up without a search
        self.one = np.array([moves.get(b, -1) for b in range(256)], np.int64)
        self.two = np.array([-1 if a < 0 else moves.get(a << 8 | b, -1) for a in self.one.tolist() for b in range(256)], np.int64)
        # pairs of bytes that some piece holds side by side
        self.joined = np.zeros(1 << 16, bool)
        self.joined[[a << 8 | b for name in itertools.compress(pieces.names, pieces.usable) for a, b in itertools.pairwise(name)]] = True

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.targets[at], -1)


class Lattice:
    """Lattices of many chunks at once.  Node ``p + c`` stands before byte ``p`` of chunk ``c``."""

    def __init__(self, packed: np.ndarray, offsets: np.ndarray, trie: Trie, pieces: Pieces):
        self.offsets, self.pieces, self.packed = offsets, pieces, packed
        sizes = np.diff(offsets)
        n = len(sizes)
        owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
        lead = np.flatnonzero((packed & 0xC0) != 0x80).astype(np.int32)
        end_of = offsets[1:][owner]
        starts, ends, ids = [], [], []
        at, node = lead, np.zeros(len(lead), np.int64)
        depth = 0
        while len(at):
            byte = packed[at + depth].astype(np.int64)
            node = trie.one[byte] if depth == 0 else trie.two[packed[at].astype(np.int64) << 8 | byte] if depth == 1 else trie.step(node, byte)
            alive = node >= 0
            at, node = at[alive], node[alive]
            hit = trie.piece[node] >= 0
            starts.append(at[hit].astype(np.int32))
            ends.append((at[hit] + depth + 1).astype(np.int32))
            ids.append(trie.piece[node[hit]])
            depth += 1
            inside = at + depth < end_of[at]
            at, node = at[inside], node[inside]
        start, end, piece = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (starts, ends, ids))
        after = np.append(lead[1:], np.int32(len(packed)))
        place = np.full(len(packed) + 1, -1, np.int32)
        place[lead] = np.arange(len(lead))
        single = np.zeros(len(lead), bool)
        single[place[start[after[place[start]] == end]]] = True
        bare = np.flatnonzero(~single)
        worst = int(pieces.scores[pieces.usable].min()) if pieces.usable.any() else 0
        weight = np.concatenate([pieces.scores[piece], np.full(len(bare), worst - int(UNKNOWN_GAP * SCALE))]).astype(np.int32)
        start, end, piece = np.concatenate([start, lead[bare]]), np.concatenate([end, after[bare]]), np.concatenate([piece, np.full(len(bare), -1, np.int32)])
        chunk = owner[start]
        local = (end - offsets[:-1][chunk]).astype(np.int32)
        # by end within the chunk, then end, then the longest first; no two are equal
        order = np.argsort((local.astype(np.int64) << 40) + ((end + chunk).astype(np.int64) << 6) - np.minimum(end - start, 63))
        self.start, self.end, self.piece, self.weight, self.chunk = (x[order] for x in (start + chunk, end + chunk, piece, weight, chunk))
        self.sources = offsets[:-1] + np.arange(n)
        self.sinks = offsets[1:] + np.arange(n)
        self._forward(local[order], len(packed) + n)

    def _forward(self, level: np.ndarray, nodes: int) -> None:
        """Viterbi scores of all nodes; the longest piece wins a tie."""
        self.score = np.full(nodes, _NONE, np.int64)
        self.score[self.sources] = 0
        self.back = np.full(nodes, -1, np.int32)
        self.first = np.zeros(nodes, np.int32)
        self.count = np.zeros(nodes, np.int32)
        heads = np.flatnonzero(np.diff(self.end, prepend=-1)) if len(self.end) else np.zeros(0, np.int64)
        spans = np.diff(np.append(heads, len(self.end)))
        self.first[self.end[heads]] = heads
        self.count[self.end[heads]] = spans
        edges = np.flatnonzero(np.diff(level, prepend=-1))
        cuts = np.searchsorted(heads, edges)
        for k, low in enumerate(edges):
            high = edges[k + 1] if k + 1 < len(edges) else len(level)
            own = heads[cuts[k] : cuts[k + 1] if k + 1 < len(edges) else len(heads)]
            through = self.score[self.start[low:high]] + self.weight[low:high]
            best = np.maximum.reduceat(through, own - low)
            width = np.diff(np.append(own, high))
            equal = np.flatnonzero(through == np.repeat(best, width))
            group = np.repeat(np.arange(len(own)), width)[equal]
            pick = equal[np.diff(group, prepend=-1) != 0] + low
            self.score[self.end[own]] = best
            self.back[self.end[own]] = pick

    def best_paths(self) -> tuple[np.ndarray, np.ndarray]:
        """Edges of the best path of every chunk in reading order, and where each chunk's begin."""
        live, node = np.arange(len(self.sources)), self.sinks.copy()
        moved = node > self.sources
        live, node = live[moved], node[moved]
        rows, edges = [], []
        while len(live):
            edge = self.back[node]
            rows.append(live)
            edges.append(edge)
            node = self.start[edge]
            on = node > self.sources[live]
            live, node = live[on], node[on]
        if not rows:
            return np.zeros(0, np.int64), np.zeros(len(self.sources) + 1, np.int64)
        row = np.concatenate(rows)[::-1]
        order = np.argsort(row, kind="stable")
        return np.concatenate(edges)[::-1][order], np.searchsorted(row[order], np.arange(len(self.sources) + 1))

    def losses(self, best: np.ndarray) -> np.ndarray:
        """What the second best segmentation of each chunk loses against the best; a large number if there is none.

        Another segmentation has an edge off the best path; its score is at most
        the best through that edge, forward plus backward.
        """
        ahead = np.full(len(self.score), _NONE, np.int64)
        ahead[self.sinks] = 0
        local = self.start - self.sources[self.chunk]
        order = np.argsort((local.astype(np.int64) << 40) + (self.start.astype(np.int64) << 6) + np.minimum(self.end - self.start, 63))[::-1]
        start, end, weight, level = self.start[order], self.end[order], self.weight[order], local[order]
        heads = np.flatnonzero(np.diff(start, prepend=-1)) if len(start) else np.zeros(0, np.int64)
        edges = np.flatnonzero(np.diff(level, prepend=-1))
        cuts = np.searchsorted(heads, edges)
        for k, low in enumerate(edges):
            high = edges[k + 1] if k + 1 < len(edges) else len(level)
            own = heads[cuts[k] : cuts[k + 1] if k + 1 < len(edges) else len(heads)]
            ahead[start[own]] = np.maximum.reduceat(weight[low:high] + ahead[end[low:high]], own - low)
        off = np.ones(len(self.start), bool)
        off[best] = False
        other = np.full(len(self.sources), _NONE, np.int64)
        np.maximum.at(other, self.chunk[off], (self.score[self.start] + self.weight + ahead[self.end])[off])
        return np.where(other > _NONE // 2, self.score[self.sinks] - other, 1 << 60)

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of edges, a character without a piece as its bytes; and how many ids each edge has."""
        bare = self.piece[edges] < 0
        width = np.where(bare, self.end[edges] - self.start[edges], 1)
        out = np.repeat(self.piece[edges], width)
        spot = np.flatnonzero(np.repeat(bare, width))
        at = (np.arange(len(out)) - np.repeat(np.cumsum(width) - width, width))[spot] + np.repeat(self.start[edges] - self.chunk[edges], width)[spot]
        out[spot] = self.packed[at] + self.pieces.zero
        return out, width

    def ids_of(self, edges: list[int]) -> list[int]:
        """Piece ids of a few edges."""
        out: list[int] = []
        for edge in edges:
            piece = int(self.piece[edge])
            if piece >= 0:
                out.append(piece)
            else:
                at = int(self.start[edge] - self.chunk[edge])
                out += [b + self.pieces.zero for b in self.packed[at : at + int(self.end[edge] - self.start[edge])].tolist()]
        return out

    def n_best(self, chunk: int, n: int) -> list[tuple[int, list[int]]]:
        """Score and edges of the ``n`` best segmentations by backward A-star, ties by the longest last pieces.

        The heuristic is exact, so from an entry the search runs straight down the
        back edges to the source.  That way is taken at once, and of the edges that
        turn off it only as many are kept as segmentations are still wanted.
        """
        source, sink = int(self.sources[chunk]), int(self.sinks[chunk])
        heap: list[tuple[int, bytes, list[int], int]] = []

        def push(cost: int, edges: list[int], node: int) -> None:
            fixed = len(edges)
            while node != source:
                edges.append(int(self.back[node]))
                node = int(self.start[edges[-1]])
            # big-endian nodes compare as bytes like the nodes themselves
            heapq.heappush(heap, (cost, self.start[edges].astype(">u4").tobytes() if edges else b"", edges, fixed))

        push(-int(self.score[sink]), [], sink)
        found = []
        while heap and len(found) < n:
            cost, _, edges, fixed = heapq.heappop(heap)
            found.append((-cost, edges[::-1]))
            if len(found) < n:
                for loss, _, at, edge in heapq.nsmallest(n - len(found), self._turns(edges, fixed)):
                    at = abs(at)
                    push(cost + loss, [*edges[:at], edge], int(self.start[edge]))
        return found

    def _turns(self, edges: list[int], fixed: int) -> Iterator[tuple[int, bool, int, int]]:
        """Edges that turn off a path behind its first ``fixed`` ones: what they lose, then how such paths are ordered.

        A longer piece than the path's comes before all that follow the path on, the
        earliest turn first; a shorter one after them, the latest turn first.
        """
        for at in range(fixed, len(edges)):
            own = edges[at]
            node = int(self.end[own])
            low, score = int(self.first[node]), int(self.score[node])
            for edge in range(low, low + int(self.count[node])):
                if edge != own:
                    yield score - int(self.score[self.start[edge]]) - int(self.weight[edge]), edge > own, -at if edge > own else at, edge


def _chunks(data: np.ndarray, rows: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A blank before every text that is not empty, then the start of each chunk: at a blank after a non-blank, and
    around control characters, but never between two bytes that a piece has ``joined``.
    """
    sizes = np.diff(rows)
    full = sizes > 0
    moved = np.empty(len(data) + int(full.sum()), np.uint8)
    begins = rows[:-1][full] + np.arange(full.sum())
    spot = np.ones(len(moved), bool)
    spot[begins] = False
    moved[spot], moved[begins] = data, 32
    fresh = np.zeros(len(moved), bool)
    if len(moved):
        blank, odd = moved == 32, moved < 32
        fresh[1:] = (blank[1:] & ~blank[:-1]) | odd[1:] | odd[:-1]
        cuts = np.flatnonzero(fresh)
        fresh[cuts[joined[moved[cuts - 1].astype(np.int64) << 8 | moved[cuts]]]] = False
        fresh[begins] = True
    return moved, np.flatnonzero(fresh)


class Searched(NamedTuple):
    """Distinct chunks with the ids of their best segmentations, its score, and what the second best loses; their lattice, if it is one."""

    packed: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    starts: np.ndarray
    scores: np.ndarray
    losses: np.ndarray
    lattice: Lattice | None


class Encoder:
    def __init__(self, pieces: Pieces, best: int = BEST):
        self.pieces, self.best = pieces, best
        self.trie = Trie(pieces)
        self.memo: dict[bytes, list[tuple[int, list[int]]]] = {}

    def __call__(self, column: pa.Array) -> dict[str, pa.Array]:
        """Columns for every row: ids of the best segmentation, the N best scores, the changes of the others, round trip."""
        data, rows = text.buffer(column)
        raw = data.tobytes()
        plain = data
        if MARK in raw:  # the word mark itself reads as a blank, as in the library
            cleaned = [b.replace(MARK, b" ") for b in (raw[a:b] for a, b in itertools.pairwise(rows.tolist()))]
            plain = np.frombuffer(b"".join(cleaned), np.uint8)
            lengths = np.array([len(b) for b in cleaned], np.int64)
        else:
            lengths = np.diff(rows)
        spaced, starts = _chunks(plain, np.concatenate([[0], np.cumsum(lengths)]), self.trie.joined)
        owned = np.concatenate([[0], np.cumsum(lengths + (lengths > 0))])
        of_row = np.searchsorted(starts, owned)
        n = len(lengths)
        if not len(starts):
            return self._columns(np.zeros(0, np.int64), np.zeros(n + 1, np.int64), [[0.0]] * n, [[[]]] * n, lengths == np.diff(rows))
        ends = np.append(starts, len(spaced)).astype(np.int64)
        found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(spaced))]).dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        packed, offsets = text.buffer(found.dictionary)
        found = self._search(packed, offsets)
        count = np.diff(found.starts)
        size = count[codes]
        flat = found.ids[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - found.starts[:-1][codes], size)]
        chunk_at = np.concatenate([[0], np.cumsum(size)])
        totals = text.row_sums(found.scores[codes], of_row)
        if len(self.memo) > REMEMBERED or sum(map(len, self.memo)) > SLICE_BYTES:
            self.memo.clear()
        scores, changes = [], []
        for r in range(n):
            low, high = int(of_row[r]), int(of_row[r + 1])
            s, c = self._n_best(found, codes[low:high], chunk_at[low:high] - chunk_at[low] if high > low else None, count)
            scores.append([(int(totals[r]) - x) / SCALE for x in s])
            changes.append(c)
        row_ids = chunk_at[of_row]
        return self._columns(flat, row_ids, scores, changes, self._same(flat, row_ids, data, rows))

    def _search(self, packed: np.ndarray, offsets: np.ndarray) -> Searched:
        """Best segmentations of all chunks, from one lattice for every SLICE_BYTES of them; a longer chunk has its own."""
        ids, widths, scores, losses, lattice, start = [], [], [], [], None, 0
        while start < len(offsets) - 1:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + SLICE_BYTES, "right")) - 1)
            low, high = int(offsets[start]), int(offsets[stop])
            lattice = Lattice(packed[low:high], offsets[start : stop + 1] - low, self.trie, self.pieces)
            edges, edge_starts = lattice.best_paths()
            own, width = lattice.ids(edges)
            ids.append(own)
            widths.append(np.diff(np.concatenate([[0], np.cumsum(width)])[edge_starts]))
            scores.append(lattice.score[lattice.sinks])
            losses.append(lattice.losses(edges))
            start = stop
        starts = np.concatenate([[0], np.cumsum(np.concatenate(widths))])
        return Searched(packed, offsets, np.concatenate(ids), starts, np.concatenate(scores), np.concatenate(losses), lattice if len(ids) == 1 else None)

    def _n_best(self, found: Searched, codes, at, count) -> tuple[list[int], list[list[dict]]]:
        """Losses of the N best segmentations of a row, the best first, and the changes that make each from the best."""
        k = min(self.best - 1, len(codes))
        if k == 0:
            return [0], [[]]
        losses = found.losses[codes]
        edge = np.partition(losses, k - 1)[k - 1]
        chosen = np.concatenate([np.flatnonzero(losses < edge), np.flatnonzero(losses == edge)[:k]])[:k]
        chosen = np.sort(chosen[losses[chosen] < 1 << 59])
        options = [self._options(found, int(codes[c])) for c in chosen]
        first = (0,) * len(options)
        heap, seen, picks = [(0, first)], {first}, []
        while heap and len(picks) < self.best:
            loss, pick = heapq.heappop(heap)
            picks.append((loss, pick))
            for i, listed in enumerate(options):
                if pick[i] + 1 < len(listed):
                    after = (*pick[:i], pick[i] + 1, *pick[i + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (loss + listed[pick[i]][0] - listed[pick[i] + 1][0], after))
        changes = [
            [
                {"at": int(at[c]), "drop": int(count[codes[c]]), "ids": options[i][p][1]}
                for i, (c, p) in enumerate(zip(chosen, pick, strict=True)) if p
            ]
            for _, pick in picks
        ]
        return [loss for loss, _ in picks], changes

    def _options(self, found: Searched, code: int) -> list[tuple[int, list[int]]]:
        """Score and ids of the N best segmentations of a chunk, from its lattice or, where that is gone, one of its own."""
        own = found.packed[found.offsets[code] : found.offsets[code + 1]]
        name = own.tobytes()
        if name not in self.memo:
            lattice, chunk = (found.lattice, code) if found.lattice else (Lattice(own, np.array([0, len(own)], np.int64), self.trie, self.pieces), 0)
            self.memo[name] = [(score, lattice.ids_of(edges)) for score, edges in lattice.n_best(chunk, self.best)]
        return self.memo[name]

    def _same(self, flat: np.ndarray, row_ids: np.ndarray, data: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Whether decoding each row's ids gives its bytes again."""
        back = decode_flat(self.pieces, flat, row_ids)
        raw = data.tobytes()
        return np.array([x == raw[a:b] for x, (a, b) in zip(back, itertools.pairwise(rows.tolist()), strict=True)], bool)

    @staticmethod
    def _columns(flat, row_ids, scores, changes, same) -> dict[str, pa.Array]:
        change = pa.list_(pa.list_(pa.struct([("at", pa.int32()), ("drop", pa.int32()), ("ids", pa.list_(pa.int32()))])))
        return {
            "ids": pa.ListArray.from_arrays(pa.array(row_ids, pa.int32()), pa.array(flat, pa.int32())), "scores": pa.array(scores, pa.list_(pa.float64())),
            "changes": pa.array(changes, change), "round_trip": pa.array(same, pa.bool_()),
        }


def decode_flat(pieces: Pieces, flat: np.ndarray, row_ids: np.ndarray) -> list[bytes]:
    """Bytes of each row of ids; the blank that encoding put first is taken off."""
    names = pieces.names
    out = []
    for low, high in itertools.pairwise(row_ids.tolist()):
        joined = b"".join(b"".join([names[i] for i in flat[k : min(k + 65_536, high)].tolist()]) for k in range(low, high, 65_536))
        out.append(joined[1:] if joined[:1] == b" " else joined)
    return out


SCHEMA = "ids array<int>, scores array<double>, changes array<array<struct<at:int,drop:int,ids:array<int>>>>, round_trip boolean"


def encode(docs: DataFrame, pieces: Pieces, carry: list[str], text_col: str = "text", best: int = BEST) -> DataFrame:
    """``carry`` columns of every row, then the ``best`` best segmentations of its whole text.

    ``ids`` is the best one, ``scores`` has the log-probabilities of all that
    were found (fewer than ``best`` if there are no more), ``changes`` says
    for each what to replace in ``ids``: from ``at``, ``drop`` ids by others.
    ``round_trip`` tells whether decoding gives the text again.

    Null counts as empty: no ids, one segmentation of score 0.  Rows that repeat
    are encoded each, equal scores go by the order of ``Lattice.n_best``; an
    empty table gives no rows.  A long text takes memory by its distinct chunks,
    of which one without a place to cut has a lattice of some 200 times its bytes.
    """
    rows, names, fields = text.carried(docs, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(pieces, best)
        for part in text.slices(batches, "body", SLICE_BYTES):
            found = encoder(part.column("body"))
            yield pa.RecordBatch.from_arrays([*(part.column(names[c]) for c in carry), *found.values()], [*names.values(), *found])

    found = rows.mapInArrow(run, ", ".join([*fields, SCHEMA]))
    return text.uncarried(found, names, "ids", "scores", "changes", "round_trip")


def decode(rows: DataFrame, pieces: Pieces, carry: list[str], ids_col: str = "ids") -> DataFrame:
    """``carry`` columns and the ``text`` of every row's ids; null ids give an empty text."""
    names = {c: f"c{i}" for i, c in enumerate(carry)}
    held = rows.select(F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"), *[F.col(f"`{c}`").alias(names[c]) for c in carry])
    fields = [f"{names[c]} {f.dataType.simpleString()}" for c, f in zip(carry, held.schema.fields[1:], strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ids = part.column("ids")
            back = decode_flat(pieces, ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]))
            yield pa.RecordBatch.from_arrays([*(part.column(names[c]) for c in carry), pa.array([b.decode("utf-8", "replace") for b in back], pa.string())], [*names.values(), "text"])

    found = held.mapInArrow(run, ", ".join([*fields, "text string"]))
    return text.uncarried(found, names, "text")
