"""Trigram language model in Elias-Fano tries, sharded by middle word.

Documents are packed into blocks of word ids. One shuffle gathers what training documents hold:
each block sends its distinct (u, v, w) to the shard of v, which has all that a prediction of w
after u v needs, and the answers return to the block; so neither the model nor the vocabulary has
to fit anywhere as a whole. Of frequent middle words, the trigrams are dealt by (v, u) and the
bigrams by (v, w). A shard is a trie of compact levels in one memory map: middle words, (v, w) and
(v, u) pairs, and the w of each (v, u). A level is an Elias-Fano coded monotone sequence, read in
place, of pointers to the context and words below it; an element is found by a successor search
within the range of its context, and holds a probability quantised to 16 bits.

Probabilities are Dirichlet-smoothed: p(w | v) = (c(v w) + K u(w)) / (c(v) + K) and p(w | u v) =
(c(u v w) + K p(w | v)) / (c(u v) + K), with u the add-0.1 unigram estimate. Before its first word
a document has two starts. The trie holds c(v w) / (c(v) + K) and c(u v w) / (c(u v) + K) for each
gram and K / (c(u v) + K) for each context.
"""

from __future__ import annotations

import mmap
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, materialize, shuffle_partitions, text_of
from .words import mix, pack, pack_all, slices, unpack, unpack_all

FOLDS = 10
#: Hashes that stand for the end and the start of a document.
END, START = np.uint64(1), np.uint64(2)
#: Bits by which words are known within a context, and steps of a quantised log probability.
INNER_BITS, STEP = 32, 2.0**-11
_INNER = np.uint64(INNER_BITS)
_SALT = np.uint64(0x5851F42D4C957F2D)


@dataclass(frozen=True)
class Settings:
    prior: float = 20.0
    add: float = 0.1
    block_tokens: int = 900_000
    #: Tokens that a shard is meant to hold: there are more shards than shuffle partitions if these are too few.
    shard_tokens: int = 2_000_000
    #: Middle words with more than 1 / (spread * shards) of all tokens are dealt over shards.
    spread: int = 4
    #: Words of a block among which frequent ones are sought.
    top: int = 1024


# ---------------------------------------------------------------- Elias-Fano

_U = np.uint64
_CHUNK = 1 << 15
#: Place of the r-th one of each byte, at r * 256 + byte.
_IN_BYTE = np.array([[([i for i in range(8) if byte >> i & 1] + [8] * 8)[r] for byte in range(256)] for r in range(8)], dtype=np.int64).ravel()


def _select_in(word: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The place of the one of each rank in each 64-bit word, by sums over its bytes."""
    pairs = word - ((word >> _U(1)) & _U(0x5555555555555555))
    fours = (pairs & _U(0x3333333333333333)) + ((pairs >> _U(2)) & _U(0x3333333333333333))
    upto = ((fours + (fours >> _U(4))) & _U(0x0F0F0F0F0F0F0F0F)) * _U(0x0101010101010101)
    r = rank.astype(np.uint64)
    below = ((r * _U(0x0101010101010101) | _U(0x8080808080808080)) - upto) & _U(0x8080808080808080)
    shift = np.bitwise_count(below).astype(np.uint64) * _U(8)
    before = np.where(shift > 0, (upto >> (np.maximum(shift, _U(8)) - _U(8))) & _U(255), _U(0))
    byte = (word >> np.minimum(shift, _U(56))) & _U(255)
    return shift.astype(np.int64) + _IN_BYTE[((r - before) * _U(256) + byte).astype(np.int64)]


class EliasFano:
    """A non-decreasing sequence: low bits in a plain array, high bits in unary with a count for each 64 of them; element and successor access, in place."""

    def __init__(self, low: np.ndarray, high: np.ndarray, ones: np.ndarray, bits: int, size: int):
        self.low, self.high, self.ones, self.bits, self.size = low, high, ones, bits, size

    @staticmethod
    def of(values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        bits = max(0, int(universe // max(n, 1)).bit_length() - 1)
        low = values & np.uint64((1 << bits) - 1)
        places = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(-(-((int(places[-1]) if n else 0) + 2) // 64) * 64, dtype=np.uint8)
        flags[places] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)])
        width = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if bits <= np.dtype(t).itemsize * 8)
        return EliasFano(low.astype(width), high, ones.astype(np.uint32 if n < 2**32 else np.int64), bits, n)

    def _select(self, at: np.ndarray, zeros: bool) -> np.ndarray:
        """Bit positions of the ones (or zeros) of the given ranks: the counts pick the word, sums of bytes the place in it."""
        out = np.empty(len(at), dtype=np.int64)
        counts = np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones if zeros else self.ones
        for first in range(0, len(at), _CHUNK):
            rank = at[first : first + _CHUNK]
            k = np.searchsorted(counts, rank.astype(counts.dtype), side="right") - 1
            word = self.high[k]
            out[first : first + _CHUNK] = k * 64 + _select_in(~word if zeros else word, rank - counts[k])
        return out

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64)
        return ((self._select(at, False) - at).astype(np.uint64) << np.uint64(self.bits)) | self.low[at].astype(np.uint64)

    def _search(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the place of the first element >= each value, whether it is equal): the high part picks a run, a binary search within it the element."""
        head = (values >> np.uint64(self.bits)).astype(np.int64)
        want = values & np.uint64((1 << self.bits) - 1)
        lo = np.full(len(values), self.size, dtype=np.int64)
        equal = np.zeros(len(values), bool)
        inside = np.flatnonzero(head < len(self.high) * 64 - self.size)
        later = inside[head[inside] > 0]
        lo[inside] = 0
        lo[later] = self._select(head[later] - 1, True) - (head[later] - 1)
        # where the run's first low part is greater, or the sequence ends, that is the place
        q = inside[lo[inside] < self.size]
        q = q[self.low[lo[q]] <= want[q]]
        end = self._select(head[q], True) - head[q]
        at, need, hi = lo[q], want[q], end.copy()
        while (open_ := np.flatnonzero(at < hi)).size:
            mid = (at[open_] + hi[open_]) >> 1
            less = self.low[mid] < need[open_]
            at[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
        equal[q] = (at < end) & (self.low[np.minimum(at, self.size - 1)] == need)
        lo[q] = at
        return lo, equal

    def successor(self, values: np.ndarray) -> np.ndarray:
        """The place of the first element >= each value (size if none)."""
        values = np.asarray(values, dtype=np.uint64)
        return self._search(values)[0] if self.size else np.zeros(len(values), dtype=np.int64)

    def find(self, values: np.ndarray) -> np.ndarray:
        """The place of each value, -1 if the sequence has it not."""
        if not self.size:
            return np.full(len(values), -1, dtype=np.int64)
        at, equal = self._search(np.asarray(values, dtype=np.uint64))
        return np.where(equal, at, -1)


class Level:
    """The elements below each context of the level above: one monotone sequence of (place of the context, word), in which the places are the pointers to a context's range."""

    def __init__(self, context: np.ndarray, word: np.ndarray, contexts: int):
        """From words of INNER_BITS, sorted by context (0 to contexts - 1) and word."""
        self.values = EliasFano.of((context.astype(np.uint64) << _INNER) | word.astype(np.uint64), max(contexts, 1) << INNER_BITS)

    def find(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The place of each word within the range of its context, -1 if it is not there or there is no context."""
        out = np.full(len(context), -1, dtype=np.int64)
        q = np.flatnonzero(context >= 0)
        out[q] = self.values.find((context[q].astype(np.uint64) << _INNER) | word[q].astype(np.uint64))
        return out


class Trie:
    """Middle words v with their counts; below them w with p(w | v) and u with its back-off weight; below (v, u) w with p(w | u v)."""

    def __init__(self, grams: tuple[np.ndarray, ...], pairs: tuple[np.ndarray, ...], frequent: np.ndarray, frequent_counts: np.ndarray, prior: float):
        """From distinct sorted (v, u, w, count), and distinct sorted (v, w, count) of frequent v."""
        v, u, w, c = grams
        fv, fw, fc = pairs
        own = np.unique(np.concatenate([v, fv]))
        at = np.searchsorted(own, v)
        total = np.bincount(at, weights=c, minlength=len(own)).astype(np.int64)
        hot = np.zeros(len(own), bool)
        if len(frequent) and len(own):
            place = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
            hot = frequent[place] == own
            total = np.where(hot, frequent_counts[place], total)
        self.counts = total
        vu = (at.astype(np.uint64) << _INNER) | u
        new = _heads(vu)
        rank = np.cumsum(new) - 1
        seen = np.bincount(rank, weights=c, minlength=int(new.sum()))
        self.words = EliasFano.of(own >> np.uint64(1), 1 << 63)
        self.before = Level(at[new], u[new], len(own))
        self.backoff = quantise(prior / (seen + prior))
        self.third = Level(rank, w, len(seen))
        self.p3 = quantise(c / (seen[rank] + prior))
        # bigrams: sums over u, and the frequent ones as they came
        plain = ~hot[at]
        key, place = np.unique((at[plain].astype(np.uint64) << _INNER) | w[plain], return_inverse=True)
        count = np.bincount(place, weights=c[plain], minlength=len(key))
        key = np.concatenate([key, (np.searchsorted(own, fv).astype(np.uint64) << _INNER) | fw])
        count = np.concatenate([count, fc])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        context = (key >> _INNER).astype(np.int64)
        self.after = Level(context, key & np.uint64((1 << INNER_BITS) - 1), len(own))
        self.p2 = quantise(count / (total[context] + prior))
        self._map()

    def _map(self) -> None:
        """Move all arrays into one memory map."""
        holders = [(self, n) for n in ("counts", "backoff", "p2", "p3")]
        for seq in (self.words, self.before.values, self.after.values, self.third.values):
            holders += [(seq, n) for n in ("low", "high", "ones")]
        size = sum(-(-getattr(h, n).nbytes // 8) * 8 for h, n in holders)
        self.memory, at = mmap.mmap(-1, max(size, 8)), 0
        for holder, name in holders:
            values = getattr(holder, name)
            copy = np.frombuffer(self.memory, dtype=values.dtype, count=len(values), offset=at)
            copy[:] = values
            setattr(holder, name, copy)
            at += -(-values.nbytes // 8) * 8

    def find(self, names: np.ndarray, v_runs: np.ndarray, u: np.ndarray, u_runs: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For middle words, their runs of u, and the runs of w of each: (p(w | u v), back-off of each (v, u), place of each v). A probability of 0 stands for no such gram, a place of -1 for no such word."""
        place = self.words.find(names >> np.uint64(1))
        context = self.before.find(np.repeat(place, v_runs), u)
        return _taken(self.p3, self.third.find(np.repeat(context, u_runs), w)), _taken(self.backoff, context), place

    def find_pairs(self, place: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p(w | v) for the places of middle words."""
        return _taken(self.p2, self.after.find(place, w))


def _taken(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.zeros(len(at), values.dtype)
    out[at >= 0] = values[at[at >= 0]]
    return out


def _heads(values: np.ndarray) -> np.ndarray:
    """Where sorted values differ from the one before."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return new


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities in (0, 1] as 16-bit steps of their natural logarithm, 1 upwards; 0 is free."""
    return np.clip(np.rint(-np.log(np.maximum(p, 1e-300)) / STEP) + 1, 1, 65535).astype(np.uint16)


def restore(q: np.ndarray) -> np.ndarray:
    return np.where(q > 0, np.exp(-(q.astype(np.float64) - 1) * STEP), 0.0)


def relative(q: np.ndarray, single: np.ndarray) -> np.ndarray:
    """Quantised probabilities as steps above that of a single occurrence in their context (few values, so they compress); 0 stays 0."""
    return np.where(q > 0, single.astype(np.int64) - q + 2, 0).astype(np.uint16)


def absolute(steps: np.ndarray, single: np.ndarray) -> np.ndarray:
    return np.where(steps > 0, single.astype(np.int64) - steps + 2, 0).astype(np.uint16)


# ---------------------------------------------------------------- blocks

BLOCK = "block long, tokens long, ids binary, held binary, lengths binary, words binary, seq binary, top binary, top_counts binary"


def _blocks(s: Settings):
    """Rows of documents to blocks: ids, folds, lengths, the sorted distinct words, each token's place among them, and the block's most frequent training words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        count, serial, task = 0, 0, None

        def flush() -> pa.RecordBatch:
            words = np.concatenate([p[3] for p in parts])
            held, lengths = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            distinct, seq = np.unique(words, return_inverse=True)
            times = np.bincount(seq[_trained(held, lengths)], minlength=len(distinct))
            most = np.argsort(-times, kind="stable")[: s.top]
            row = [
                (task << 24) + serial, len(seq), pack(np.concatenate([p[0] for p in parts])), pack(held), pack(lengths), pack(distinct, delta=True),
                pack(seq.astype(np.uint32)), distinct[most].tobytes(), times[most].tobytes(),
            ]
            return pa.RecordBatch.from_arrays([pa.array([x]) if i > 1 else pa.array([x], pa.int64()) for i, x in enumerate(row)], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            rid, held = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.uint8)
            if task is None and batch.num_rows:
                task = batch.column(0)[0].as_py()
            for first, end, words, at in slices(batch.column(3)):
                lengths = np.diff(at)
                out = np.insert(words, at[1:], END)  # an end after each document
                parts.append((rid[first:end], held[first:end], (lengths + 1).astype(np.uint32), out))
                count += len(out)
                if count >= s.block_tokens:
                    yield flush()
                    parts, count, serial = [], 0, serial + 1
        if parts:
            yield flush()

    return run


def _trained(held: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.repeat(held == 0, lengths)


def _rows(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for i in range(batch.num_rows):
            yield next(batch.slice(i, 1).to_pandas().itertuples(index=False))


def _frequent_words(blocks: DataFrame, tokens: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Middle words with more than one in `most` training tokens, sorted, with their counts: fewer than `most` of them."""

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, counts = (np.frombuffer(batch.column(k)[i].as_py(), np.int64) for k in (0, 1))
                keep = counts > 0
                yield pa.RecordBatch.from_arrays([pa.array(words[keep]), pa.array(counts[keep])], names=["word", "n"])

    found = blocks.select("top", "top_counts").mapInArrow(tops, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    wanted = np.sort(found.filter(F.col("n") * most > tokens).toPandas()["word"].to_numpy(np.int64).view(np.uint64))
    if not len(wanted):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            words, seq = unpack(row.words, np.uint64, delta=True), unpack(row.seq, np.uint32)
            times = np.bincount(seq[_trained(unpack(row.held, np.uint8), unpack(row.lengths, np.uint32))], minlength=len(words))
            at = np.minimum(np.searchsorted(words, wanted), len(words) - 1)
            hit = words[at] == wanted
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit)), pa.array(times[at[hit]].astype(np.int64))], names=["i", "n"])

    sums = blocks.select("held", "lengths", "words", "seq").mapInArrow(exact, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(wanted), np.int64)
    counts[sums["i"].to_numpy(np.int64)] = sums["n"].to_numpy(np.int64)
    wanted = _middle(np.where(wanted == END, START, wanted))  # as many starts as ends
    order = np.argsort(wanted)
    return wanted[order], counts[order]


def _middle(words: np.ndarray) -> np.ndarray:
    return words & ~np.uint64(1)


@dataclass
class Grams:
    """The distinct grams of a block, in the order in which it asks for them; tokens know theirs by place."""

    tri: tuple[np.ndarray, ...]  # shard, v, u, w, training count; sorted by shard, then v and u
    pair: tuple[np.ndarray, ...]  # shard, whether v is frequent, v, w, training count; sorted by shard and frequency, then v and w
    own: tuple[np.ndarray, np.ndarray]  # shard and v of the words that are not frequent; sorted by shard
    tri_of: np.ndarray
    pair_of: np.ndarray
    own_of: np.ndarray  # of each middle word its place in own, -1 if it is frequent
    middle: np.ndarray  # of each pair its middle word
    next: np.ndarray  # of each pair a word w


def _grams(held: np.ndarray, lengths: np.ndarray, words: np.ndarray, seq: np.ndarray, shards: int, frequent: np.ndarray) -> Grams:
    named = np.concatenate([np.array([START]), words])
    inner = (named >> np.uint64(64 - INNER_BITS)).astype(np.uint64)
    distinct, code = np.unique(inner, return_inverse=True)  # words that look alike within a context are one there
    starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]]) if len(lengths) else np.zeros(0, np.int64)
    w = seq.astype(np.int64) + 1
    v = np.concatenate([[0], w[:-1]])
    v[starts] = 0
    u = np.concatenate([[0], v[:-1]])
    u[starts] = 0
    hashes = _middle(named)
    hot = np.zeros(len(named), bool)
    if len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)] == hashes
    shard_of = lambda key: (mix(key) % np.uint64(shards)).astype(np.int64)
    trained = _trained(held, lengths)

    bits = np.uint64(len(named).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    v64, w64 = v.astype(np.uint64), code[w].astype(np.uint64)
    if 3 * int(bits) <= 64:
        tri, tri_of = np.unique(((v64 << bits | code[u].astype(np.uint64)) << bits) | w64, return_inverse=True)
        vu, tw = tri >> bits, tri & low
    else:
        vu, vu_of = np.unique(v64 << bits | code[u].astype(np.uint64), return_inverse=True)
        tri, tri_of = np.unique(vu_of.astype(np.uint64) << bits | w64, return_inverse=True)
        vu, tw = vu[(tri >> bits).astype(np.int64)], tri & low
    del u, tri
    tv, tu, tw = (vu >> bits).astype(np.int64), distinct[(vu & low).astype(np.int64)], distinct[tw.astype(np.int64)].astype(np.uint32)
    count = np.bincount(tri_of[trained], minlength=len(tw)).astype(np.uint32)
    shard = shard_of(np.where(hot[tv], hashes[tv] ^ mix(tu ^ _SALT), hashes[tv])).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    found = (shard[order], hashes[tv][order], tu.astype(np.uint32)[order], tw[order], count[order])
    tri_of = rank[tri_of]
    del vu, tv, tu, tw, count, shard, order, rank
    pair, pair_of = np.unique(v64 << bits | w64, return_inverse=True)
    pv, pw = (pair >> bits).astype(np.int64), distinct[(pair & low).astype(np.int64)]
    times = np.bincount(pair_of[trained], minlength=len(pair)).astype(np.uint32)
    at = shard_of(np.where(hot[pv], hashes[pv] ^ mix(pw), hashes[pv]))
    by = np.argsort(at * 2 + hot[pv], kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    example = np.zeros(len(pair), np.int64)
    example[pair_of] = w
    plain = np.flatnonzero(~hot)
    plain = plain[np.isin(plain, pv)]
    own_shard = shard_of(hashes[plain])
    first = np.argsort(own_shard, kind="stable")
    own_of = np.full(len(named), -1, np.int64)
    own_of[plain[first]] = np.arange(len(first))
    return Grams(
        found, (at[by], hot[pv][by], hashes[pv][by], pw[by], times[by]), (own_shard[first], hashes[plain][first]),
        tri_of, place[pair_of], own_of, pv[by], example[by],
    )


def _cut(shard: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(shard, np.arange(shards + 1))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the value of each run of equal neighbours, its length)."""
    at = np.flatnonzero(_heads(values))
    return values[at], np.diff(np.append(at, len(values))).astype(np.uint32)


REQUEST = "shard int, block long, grams binary"
#: Arrays of a request: differences of v, their runs of (v, u), u and their runs of w, w, counts; v, runs, w and counts of
#: the pairs of frequent v; and differences of the words that u and w are places of.
ASKED = [np.uint64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint32, np.uint64, np.uint32, np.uint32, np.uint32, np.uint32]


def _pack_request(names, v_runs, u, u_runs, w, c, pair_names, pair_runs, pw, pc) -> bytes:
    words, place = np.unique(np.concatenate([u, w, pw]).astype(np.uint32), return_inverse=True)
    u, w, pw = np.split(place, [len(u), len(u) + len(w)])
    parts = (np.diff(names, prepend=np.uint64(0)), v_runs, u, u_runs, w, c, pair_names, pair_runs, pw, pc, np.diff(words, prepend=np.uint32(0)))
    return pack_all([x.astype(k) for x, k in zip(parts, ASKED, strict=True)])


def _unpack_request(blob: bytes) -> list[np.ndarray]:
    names, v_runs, u, u_runs, w, c, pair_names, pair_runs, pw, pc, words = unpack_all(blob, ASKED)
    words = np.cumsum(words, dtype=np.uint32)
    return [np.cumsum(names, dtype=np.uint64), v_runs, words[u], u_runs, words[w], c, pair_names, pair_runs, words[pw], pc]


def _requests(shards: int, known):
    """Per block and shard: the distinct grams with their training counts, v and u once a run; the pairs of frequent v."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            g = _grams(*_read(row)[1:], shards, known.value[0])
            cut, pair_cut = _cut(g.tri[0], shards), _cut(g.pair[0], shards)
            shard, held = [], []
            for i in range(shards):
                v, u, w, c = (x[cut[i] : cut[i + 1]] for x in g.tri[1:])
                hot, pv, pw, pc = (x[pair_cut[i] : pair_cut[i + 1]] for x in g.pair[1:])
                pv, pw, pc = pv[hot], pw[hot], pc[hot]
                if not len(v) and not len(pv):
                    continue
                at = np.flatnonzero(_heads(v) | _heads(u))
                names, runs = _runs(v[at])
                pair_names, pair_runs = _runs(pv)
                ends = np.diff(np.append(at, len(v)))
                shard.append(i)
                held.append(_pack_request(names, runs, u[at], ends, w, c, pair_names, pair_runs, pw, pc))
            del g
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array([row.block] * len(shard), pa.int64()), pa.array(held, pa.binary())], names=["shard", "block", "grams"])

    return run


def _read(row) -> tuple[np.ndarray, ...]:
    return (
        unpack(row.ids, np.int64), unpack(row.held, np.uint8), unpack(row.lengths, np.uint32),
        unpack(row.words, np.uint64, delta=True), unpack(row.seq, np.uint32),
    )


ANSWER = "shard int, block long, answer binary, types long, tokens long"
#: Arrays of an answer: p(w | u v) of the trigrams (relative to the back-off), back-offs of (v, u), p(w | v) of the pairs (relative to the count of v), counts of v.
ANSWERED = [np.uint16, np.uint16, np.uint16, np.int64]


def _asked(blob: bytes) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """((v, u, w, count), (v, w, count) of frequent v) of a request."""
    names, v_runs, u, u_runs, w, c, pair_names, pair_runs, pw, pc = _unpack_request(blob)
    v = np.repeat(np.repeat(names, v_runs), u_runs)
    return (v, np.repeat(u, u_runs), w, c), (np.repeat(pair_names, pair_runs), pw, pc)


def _summed(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Columns of grams (v, then words known by INNER_BITS, then a count), sorted and summed."""
    *keys, count = (np.concatenate([p[k] for p in parts]) for k in range(len(parts[0])))
    parts.clear()
    names, rank = np.unique(keys[0], return_inverse=True)
    columns = []
    for k in keys[1:]:  # each step ranks the grams by one word more
        key, rank = np.unique((rank.astype(np.uint64) << _INNER) | k, return_inverse=True)
        columns = [c[(key >> _INNER).astype(np.int64)] for c in columns] if columns else [names[(key >> _INNER).astype(np.int64)]]
        columns.append(key & np.uint64((1 << INNER_BITS) - 1))
    return *columns, np.bincount(rank, weights=count, minlength=len(columns[0])).astype(np.int64)


def _answers(s: Settings, known):
    """Of a shard: build its trie from the training counts, then look up what each block asks."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        frequent, frequent_counts = known.value
        shift = np.int64(round(np.log(s.prior) / STEP))
        pdf = pdf.sort_values("block")
        seen: list[list] = [[], []]
        for blob in pdf["grams"]:
            for held, (*keys, count) in zip(seen, _asked(blob), strict=True):
                held.append(tuple(x[count > 0] for x in (*keys, count)))
        trie = Trie(_summed(seen.pop(0)), _summed(seen.pop(0)), frequent, frequent_counts, s.prior)
        out = []
        for block, blob in zip(pdf["block"], pdf["grams"], strict=True):
            names, v_runs, u, u_runs, w, _, pair_names, pair_runs, pw, _ = _unpack_request(blob)
            p3, backoff, place = trie.find(names, v_runs, u, u_runs, w)
            plain = np.ones(len(names), bool)
            if len(frequent):
                plain = frequent[np.minimum(np.searchsorted(frequent, names), len(frequent) - 1)] != names
            # number the runs of v, so that pairs come in the order of the block
            run = np.repeat(np.repeat(np.arange(len(names), dtype=np.uint64), v_runs), u_runs)
            here = np.repeat(np.repeat(plain, v_runs), u_runs)
            pairs = np.unique((run[here] << _INNER) | w[here])
            of = (pairs >> _INNER).astype(np.int64)
            p2 = trie.find_pairs(place[of], (pairs & np.uint64((1 << INNER_BITS) - 1)).astype(np.uint32))
            counts = _taken(trie.counts, place)
            p2 = relative(p2, quantise(1 / (counts[of] + s.prior)))
            hot_place = trie.words.find(pair_names >> np.uint64(1))
            hot2 = trie.find_pairs(np.repeat(hot_place, pair_runs), pw)
            hot2 = relative(hot2, np.repeat(quantise(1 / (_taken(trie.counts, hot_place) + s.prior)), pair_runs))
            p3 = relative(p3, np.repeat(backoff + shift, u_runs))
            out.append((block, pack_all([p3, backoff, np.concatenate([p2, hot2]), counts[plain]])))
        hot = np.zeros(len(trie.counts), bool)
        if len(frequent) and len(hot):
            own = (trie.words[np.arange(trie.words.size)]) << np.uint64(1)
            hot = frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
        frame = pd.DataFrame({"shard": pdf["shard"].iloc[0], "block": [o[0] for o in out], "answer": [o[1] for o in out]})
        frame["types"], frame["tokens"] = 0, 0
        frame.loc[0, ["types", "tokens"]] = int((~hot & (trie.counts > 0)).sum()), int(trie.counts[~hot].sum())
        return frame

    return run


SCORED = "rid long, held_out boolean, n_tokens long, n_known long, base_sum double, score double"


def _scores(s: Settings, shards: int, known, tokens: int, types: int):
    def run(key, blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        frequent, frequent_counts = known.value
        ids, held, lengths, words, seq = _read(next(blocks.itertuples(index=False)))
        g = _grams(held, lengths, words, seq, shards, frequent)
        found = [unpack_all(b, ANSWERED) for b in answers.sort_values("shard")["answer"]]
        p3, backoffs, p2, own = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, kind) for k, kind in enumerate(ANSWERED))
        # counts of words: of the frequent ones, and of those that the block has as middle words; ends are as many as starts
        hashes = _middle(np.concatenate([np.array([START]), words]))
        counts = np.zeros(len(hashes), np.int64)
        counts[g.own_of >= 0] = own[g.own_of[g.own_of >= 0]]
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
            counts = np.where(frequent[at] == hashes, frequent_counts[at], counts)
        counts[np.concatenate([[False], words == END])] = counts[0]
        unigram = (counts + s.add) / (tokens + s.add * (types + 1))
        weight = s.prior / (counts[g.middle] + s.prior)
        two = restore(absolute(p2, quantise(1 / (counts[g.middle] + s.prior)))) + weight * unigram[g.next]
        _, v, u, _, _ = g.tri
        new = _heads(g.tri[0]) | _heads(v) | _heads(u)
        backoff = backoffs[np.cumsum(new) - 1]
        p3 = absolute(p3, backoff + np.int64(round(np.log(s.prior) / STEP)))
        backoff = np.where(backoff > 0, restore(backoff), 1.0)
        three = restore(p3)[g.tri_of] + backoff[g.tri_of] * two[g.pair_of]
        starts = np.concatenate([[0], np.cumsum(lengths.astype(np.int64))[:-1]])
        each = lambda x: np.add.reduceat(x, starts) if len(x) else np.zeros(0)
        word = seq.astype(np.int64) + 1
        return pd.DataFrame(
            {
                "rid": ids, "held_out": held.astype(bool), "n_tokens": lengths.astype(np.int64), "n_known": each((counts[word] > 0).astype(np.int64)),
                "base_sum": each(np.log10(unigram)[word]), "score": each(np.log10(three)),
            }
        )

    return run


def score_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all documents of folds other than 0 and scores every text whole; scores are sums
    of log10 probabilities over words and one end. A null, empty or blank text has the end alone.
    Rows without doc_id are in the fold of an empty one. Repeated rows each count in training.
    Other columns are ignored. An empty table gives an empty result.
    """
    s, spark = settings or Settings(), docs.sparkSession
    rows = docs.select(
        F.spark_partition_id().cast("long").alias("task"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("rid"),
        (crc_mod("doc_id", FOLDS) == 0).alias("held"), text_of().alias("text"),
    )
    blocks = materialize(rows.mapInArrow(_blocks(s), BLOCK), "blocks", compression="none")
    total = int(blocks.agg(F.sum("tokens")).first()[0] or 0)
    shards = max(shuffle_partitions(spark), -(-total // s.shard_tokens))
    known = spark.sparkContext.broadcast(_frequent_words(blocks, total, s.spread * shards))
    asked = blocks.select("block", "ids", "held", "lengths", "words", "seq").mapInArrow(_requests(shards, known), REQUEST)
    answers = materialize(asked.groupBy("shard").applyInPandas(_answers(s, known), ANSWER), "answers", compression="none")
    size = answers.agg(F.sum("types").alias("v"), F.sum("tokens").alias("n")).first()
    # starts count as ends, so middle words are tokens
    tokens, types = (int(size[k] or 0) + int(extra) for k, extra in (("n", known.value[1].sum()), ("v", (known.value[1] > 0).sum())))
    scored = blocks.drop("top", "top_counts", "tokens").groupBy("block").cogroup(answers.drop("types", "tokens").groupBy("block")).applyInPandas(_scores(s, shards, known, tokens, types), SCORED)
    return scored.select(
        F.nullif("rid", F.lit(-(1 << 63))).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"),
        F.col("base_sum").alias("base_score"), "score",
    )
