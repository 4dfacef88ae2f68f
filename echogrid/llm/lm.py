"""Language-model scoring by a weighted backoff automaton.

Smoothed n-grams are arcs between states; a state is a context of up to two
words and has a failure arc, weighted with its backoff, to the context without
its first word.  A text is read once from left to right: the state is carried,
failure arcs are followed until an arc takes the word, log-probabilities add up.

The automaton of the whole corpus never meets in one place.  Documents are
dealt into blocks.  A block asks for the n-grams that its texts hold; counts are
kept in buckets of n-gram hashes, which add up the counts of all blocks and
answer each block in the order of its question; a block then compiles the part
of the automaton that its texts can reach, which scores them exactly.  From
three words on it asks for open n-grams alone: if no other block holds an
n-gram's first words, or its last, none holds the n-gram.
Contexts back off with weight k / (c + k): hierarchical Dirichlet smoothing,
which needs counts only.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text

ORDER = 3
STRENGTH = (10_000.0, 20.0)  # k of contexts of one and of two words
FLOOR = 0.1  # added to every word's count
BLOCK_BYTES = 6 << 20
KEY_BITS = 56
LANE = 64
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = b"\n"  # no word holds a line end


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _A + b
        x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


class Tokens:
    """Words of a run of rows, an end after each row's last; numbers, hashes and n-gram hashes by position."""

    def __init__(self, column: pa.Array):
        words = text.Words(column, text.SPACED)
        codes, vocabulary = words.coded()
        rows = len(words.rows) - 1
        self.rows = words.rows + np.arange(rows + 1)
        self.codes = np.full(len(codes) + rows, len(vocabulary))
        plain = np.ones(len(self.codes), bool)
        plain[self.rows[1:] - 1] = False
        self.codes[plain] = codes
        digest = xxhash.xxh64_intdigest
        self.hashes = np.array([digest(w, 1) for w in [*vocabulary, END]], np.uint64)
        self.place = (np.arange(len(self.codes)) - np.repeat(self.rows[:-1], np.diff(self.rows))).astype(np.int32)

    def __len__(self) -> int:
        return len(self.codes)

    def keys(self, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, n-gram hashes) of order 1, 2, ... ; an n-gram lies within one row and is named by its last position."""
        single = held = self.hashes[self.codes]
        cut = np.uint64(64 - KEY_BITS)
        yield np.arange(len(self)), held >> cut
        for n in range(1, order):
            # the n-gram that ends one word earlier, then this word
            held = np.concatenate([held[:1], _mix(held[:-1], single[1:])])
            spot = np.flatnonzero(self.place >= n)
            yield spot, held[spot] >> cut


def _heads(ordered: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(ordered)), bool), ordered[1:] != ordered[:-1]]))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and how often each occurs."""
    values = np.sort(values)
    heads = _heads(values)
    return values[heads], np.diff(np.append(heads, len(values)))


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each value among the distinct ones, and a place where each distinct one stands."""
    order = np.argsort(values)
    heads = _heads(values[order])
    rank = np.empty(len(values), np.int32)
    rank[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(values))))
    return rank, order[heads]


def _planes(values: np.ndarray) -> bytes:
    """Numbers by byte planes, compressed: equal high bytes lie together."""
    raw = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unplanes(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    plain = pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(plain, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins in sorted keys; buckets are equal ranges of the hashes' upper 32 bits."""
    limits = (np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(buckets)
    inner = limits[1:-1] << np.uint64(KEY_BITS - 32)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])


class Level(NamedTuple):
    """N-grams of one order in a block, numbered by hash."""

    slot: np.ndarray  # number of the n-gram that ends at each position, -1 without one
    example: np.ndarray  # a position where each n-gram ends
    keys: np.ndarray
    local: np.ndarray  # occurrences in the block's training rows
    open: np.ndarray  # whether other blocks may hold it
    shared: np.ndarray | None  # whether other blocks do hold it, if that is known yet
    counts: np.ndarray | None  # occurrences in all training rows, if they are known yet


def _levels(tokens: Tokens, learn: np.ndarray, answers: list[np.ndarray], order: int) -> Iterator[Level]:
    """Levels of order 1 to ``order``; the answers to the open n-grams of an order, where there are any, complete its counts."""
    before: Level | None = None
    for n, (spot, held) in enumerate(tokens.keys(order)):
        rank, at = _numbered(held)
        example = spot[at].astype(np.int32)
        local = np.bincount(rank[learn[spot]], minlength=len(at))
        slot = np.full(len(tokens), -1, np.int32)
        slot[spot] = rank
        free = np.ones(len(at), bool)
        if n > 1:
            free = before.shared[before.slot[example - 1]] & before.shared[before.slot[example]]
        counts = shared = None
        if n < len(answers):
            counts, shared = local.copy(), np.zeros(len(at), bool)
            counts[free], shared[free] = answers[n] >> 1, answers[n] & 1
        before = Level(slot, example, held[at], local, free, shared, counts)
        yield before


def _block(docs: pa.Table) -> tuple[Tokens, np.ndarray]:
    tokens = Tokens(docs["body"])
    return tokens, np.repeat(~docs["held_out"].to_numpy(), np.diff(tokens.rows))


def _read(answers: pa.Table, orders: int) -> list[np.ndarray]:
    """Counts by order from the buckets' answers."""
    answers = answers.sort_by([("round", "ascending"), ("bucket", "ascending")])
    rounds, held = answers["round"].to_pylist(), answers["held"]
    out: list[list[np.ndarray]] = [[] for _ in range(orders)]
    for which, row in zip(rounds, held, strict=True):
        for n, raw in enumerate(row):
            out[which + n].append(_unplanes(raw.as_py(), np.uint64).astype(np.int64))
    return [np.concatenate(x) for x in out]


def _asked(block: int, buckets: int, levels: list[Level]) -> pa.Table:
    """One row per bucket: for each level the keys of open n-grams and their counts in the block's training rows."""
    per_bucket: list[list[bytes]] = [[] for _ in range(buckets)]
    for level in levels:
        keys, counts = level.keys[level.open], level.local[level.open].astype(np.uint32)
        cut = _edges(keys, buckets)
        for b, (low, high) in enumerate(itertools.pairwise(cut)):
            per_bucket[b] += [_planes(np.diff(keys[low:high], prepend=np.uint64(0))), _planes(counts[low:high])]
    return pa.table({"bucket": pa.array(range(buckets), pa.int64()), "block": pa.array([block] * buckets, pa.int64()), "held": pa.array(per_bucket, pa.list_(pa.binary()))})


def _first_questions(docs: pa.Table, buckets: int, order: int) -> pa.Table:
    """Words and pairs of words, all of them."""
    tokens, learn = _block(docs)
    return _asked(docs["block"][0].as_py(), buckets, list(_levels(tokens, learn, [], min(order, 2))))


def _next_questions(docs: pa.Table, answers: pa.Table, buckets: int, order: int) -> pa.Table:
    """The open n-grams of ``order`` words, once those of fewer words are known."""
    tokens, learn = _block(docs)
    for level in _levels(tokens, learn, _read(answers, order - 1), order):
        last = level
    return _asked(docs["block"][0].as_py(), buckets, [last])


def _answers(asked: pa.Table, first: int) -> pa.Table:
    """Twice the count over all blocks, one more if several blocks asked, for each block in the order it asked.

    The words' answer also has the bucket's numbers of words and tokens.
    """
    held = asked["held"]
    out: list[list[bytes]] = [[] for _ in range(len(held))]
    words = tokens = 0
    for n in range(len(held[0]) // 2):
        keys = [np.cumsum(_unplanes(row[2 * n].as_py(), np.uint64), dtype=np.uint64) for row in held]
        known, _ = _distinct(np.concatenate(keys))
        total, askers = np.zeros(len(known), np.int64), np.zeros(len(known), np.int64)
        places = [np.searchsorted(known, k) for k in keys]
        for at, row in zip(places, held, strict=True):
            total[at] += _unplanes(row[2 * n + 1].as_py(), np.uint32)
            askers[at] += 1
        if n == first == 0:
            words, tokens = int((total > 0).sum()), int(total.sum())
        told = (2 * total + (askers > 1)).astype(np.uint64)
        for at, one in zip(places, out, strict=True):
            one.append(_planes(told[at]))
    size = len(held)
    return pa.table({
        "block": asked["block"], "bucket": asked["bucket"], "round": pa.array([first] * size, pa.int32()), "held": pa.array(out, pa.list_(pa.binary())),
        "words": pa.array([words] * size, pa.int64()), "tokens": pa.array([tokens] * size, pa.int64()),
    })


ASKED = "bucket long, block long, held array<binary>"
ANSWERS = "block long, bucket long, round int, held array<binary>, words long, tokens long"


class Automaton:
    """What a block's texts can reach of the automaton.

    State 0 is the root, then come words, then pairs of words, and so on;
    ``fail`` and ``backoff`` are the failure arcs.  Arcs of order n lead from
    contexts of n - 1 words and are found by n-gram number.
    """

    def __init__(self, levels: Iterator[Level], words: int, total: int, strength: tuple[float, ...] = STRENGTH):
        self.arcs = []  # by order: number of each position's n-gram, source, target, log-probability, liveness
        states = 1
        fails, backs = [np.zeros(1, np.int32)], [np.zeros(1)]
        below = lower_p = lower_state = None
        for n, level in enumerate(levels):
            c = level.counts.astype(np.float64)
            if n == 0:
                p = (c + FLOOR) / (total + FLOOR * (words + 1))
                source = shorter = np.zeros(len(c), np.int32)
                live = np.ones(len(c), bool)
                self.known, self.base = c > 0, np.log10(p)
            else:
                context, suffix = below.slot[level.example - 1], below.slot[level.example]
                k = strength[n - 1]
                p = (c + k * lower_p[suffix]) / (below.counts[context] + k)
                source, shorter, live = lower_state[context], lower_state[suffix], c > 0
            # a context is a state if it was seen; its failure leads to its last words
            state = np.where(c > 0, states + np.arange(len(c), dtype=np.int32), shorter)
            last = n == len(strength)
            self.arcs.append((level.slot, source, shorter if last else state, np.log10(p), live))
            if not last:
                fails.append(shorter)
                backs.append(np.log10(strength[n] / (c + strength[n])))
                states += len(c)
            below, lower_p, lower_state = level, p, state
        self.fail, self.backoff = np.concatenate(fails), np.concatenate(backs)
        ends = np.cumsum([len(f) for f in fails])
        self.depth = np.searchsorted(ends, np.arange(len(self.fail)), "right").astype(np.int8)

    def read(self, tokens: Tokens) -> np.ndarray:
        """Log-probability of every token.

        Rows end to end are cut into lanes that are read side by side, each from
        left to right.  A state holds at most as many words as the order less
        one, so a lane that starts that much earlier at the root has the true
        state where its own tokens begin.
        """
        n, run_in = len(tokens), len(self.arcs) - 1
        out = np.zeros(n)
        starts = np.arange(0, n, LANE)
        state = np.zeros(len(starts), np.int64)
        first = tokens.place == 0
        for step in range(-run_in, LANE):
            at = starts + step
            lanes = np.flatnonzero((at >= 0) & (at < n))
            at = at[lanes]
            now = np.where(first[at], 0, state[lanes])
            gained = np.zeros(len(at))
            waiting = np.arange(len(at))
            while len(waiting):
                left = []
                depths = self.depth[now[waiting]]
                for depth, (slot, source, target, weight, live) in enumerate(self.arcs):
                    mine = waiting[depths == depth]
                    arc = slot[at[mine]]
                    taken = (arc >= 0) & live[arc] & (source[arc] == now[mine])
                    go, arc = mine[taken], arc[taken]
                    gained[go] += weight[arc]
                    now[go] = target[arc]
                    stuck = mine[~taken]
                    gained[stuck] += self.backoff[now[stuck]]
                    now[stuck] = self.fail[now[stuck]]
                    left.append(stuck)
                waiting = np.concatenate(left)
            state[lanes] = now
            if step >= 0:
                out[at] = gained
        return out


def _score(docs: pa.Table, answers: pa.Table, order: int, strength: tuple[float, ...]) -> pa.Table:
    tokens, learn = _block(docs)
    words, total = sum(answers["words"].to_pylist()), sum(answers["tokens"].to_pylist())
    model = Automaton(_levels(tokens, learn, _read(answers, order), order), words, total, strength[: order - 1])
    one = model.arcs[0][0]
    size = np.diff(tokens.rows)
    return pa.table({
        "id": docs["id"], "held_out": docs["held_out"], "n_tokens": pa.array(size, pa.int64()),
        "n_known": pa.array(text.row_sums(model.known[one].astype(np.int64), tokens.rows), pa.int64()), "train_tokens": pa.array(np.full(len(size), total), pa.int64()),
        "base_score": _sums(model.base[one], tokens.rows), "score": _sums(model.read(tokens), tokens.rows),
    })


def _sums(values: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Sums by row, each summed by itself so that a row's neighbours do not touch its last digits."""
    return pa.array(np.add.reduceat(values, rows[:-1]) if len(rows) > 1 else np.zeros(0))


def _round(dealt: DataFrame, answered: DataFrame, blocks: int, order: int) -> DataFrame:
    """Answers to the open n-grams of ``order`` words."""
    ask = lambda d, a: _next_questions(d, a, blocks, order)
    asked = dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(ask, ASKED)
    return asked.groupBy("bucket").applyInArrow(lambda t: _answers(t, order - 1), ANSWERS)


def held_out(id_column: Column, folds: int = 10) -> Column:
    """Whether the CRC-32 of the id's text (null: empty) is divisible by ``folds``."""
    return F.crc32(F.encode(F.coalesce(id_column.cast("string"), F.lit("")), "UTF-8")) % folds == 0


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, strength: tuple[float, ...] = STRENGTH, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row.

    Nothing is capped: every n-gram of every training text counts.  Null and
    empty texts are the end token alone.  Rows that repeat id and text share a
    block.  N-grams are told apart by hashes of ``KEY_BITS``.  The number of questions is
    the square of the number of blocks, so give larger blocks to larger
    corpora: a task needs some 30 times ``block_bytes``.
    """
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    size = rows.agg(F.sum(F.octet_length("body").cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks)))
    kind = dict(rows.dtypes)["id"]
    asked = dealt.groupBy("block").applyInArrow(lambda t: _first_questions(t, blocks, order), ASKED)
    answered = asked.groupBy("bucket").applyInArrow(lambda t: _answers(t, 0), ANSWERS)
    for n in range(3, order + 1):
        answered = answered.unionByName(_round(dealt, answered, blocks, n))
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        lambda d, a: _score(d, a, order, strength),
        f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
    )
