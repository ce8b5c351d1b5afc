"""Vectorised words of Arrow text columns, and compact blobs of sorted integers.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased; each is
known by a 64-bit hash. All work is done on whole batches with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

#: Text bytes handled at once; a longer text is a slice of its own.
SLICE_BYTES = 2_000_000
_MASK = (1 << 64) - 1
_POWER = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    lower[[9, 10, 11, 12, 13, 32]] = 0
    value = mix(np.arange(1, 257, dtype=np.uint64) * _POWER)
    value = value[lower]  # upper and lower case share a value
    space = np.zeros(256, dtype=bool)
    space[[9, 10, 11, 12, 13, 32]] = True
    return value, space


_VALUE, _SPACE = _tables()
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 64), _POWER, dtype=np.uint64)
        grown[0] = 1
        _POWERS = np.multiply.accumulate(grown)
    return _POWERS


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each text): data are the bytes of texts that begin at starts (last: the end)."""
    n = len(data)
    counts = np.zeros(len(starts), dtype=np.int64)
    if n == 0:
        return np.zeros(0, dtype=np.uint64), counts
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = starts[:-1]
    edges = edges[edges < n]
    first[edges] = inside[edges]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.zeros(0, dtype=np.uint64), counts
    word_of = np.cumsum(first) - 1
    at = np.flatnonzero(inside)
    word = word_of[at]
    place = at - begin[word]
    powers = _powers(int(place.max()) + 1)
    terms = _VALUE[data[at]] * powers[place]
    heads = np.flatnonzero(first[at])
    sums = np.add.reduceat(terms, heads)
    lengths = np.diff(np.append(heads, len(at))).astype(np.uint64)
    return mix(sums + lengths * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(begin, starts)


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes, first word of each row and the end) over slices of a text column; nulls have no words."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), len(column))
        lo, hi = int(offsets[row]), int(offsets[end])
        words, firsts = hash_words(data[lo:hi], offsets[row : end + 1] - lo)
        yield row, end, words, firsts
        row = end


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Distinct shingle hashes of one text, sorted; fewer words than size count as one shingle, none as none."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0xFF51AFD7ED558CCD | 1) + words[k : k + n]
    return np.unique(mix(h))


_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Integers as zstd-compressed byte planes; delta first takes differences (for sorted values)."""
    values = np.ascontiguousarray(values)
    if delta and len(values):
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T
    return _COMPRESS.compress(np.ascontiguousarray(planes).tobytes())


def unpack(blob: bytes, dtype, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(_EXPAND.decompress(blob), dtype=np.uint8)
    size = np.dtype(dtype).itemsize
    values = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(values, dtype=dtype) if delta else values


def pack_all(columns: list[np.ndarray]) -> bytes:
    """Several arrays of integers in one compressed blob: their lengths, then the byte planes of each."""
    sizes = np.array([len(c) for c in columns], dtype=np.uint32)
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return _COMPRESS.compress(sizes.tobytes() + b"".join(planes))


def unpack_all(blob: bytes, kinds: list) -> list[np.ndarray]:
    raw = np.frombuffer(_EXPAND.decompress(blob), dtype=np.uint8)
    sizes, at, out = raw[: 4 * len(kinds)].view(np.uint32), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).reshape(-1).view(kind))
        at += n * width
    return out
