"""Vectorised helpers over the raw UTF-8 buffers of an Arrow text column.

Everything here works on one bounded block of rows inside a task; Spark does
the distribution.  Hashes are polynomial over Z/2^64 with a random byte table
and a finaliser, derived from fixed seeds so every task agrees.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

U64 = np.uint64
#: Position bits kept below the hash when a sliding minimum must name its place; callers cut what they hash long before.
POS_BITS = 28
POS_MASK = U64((1 << POS_BITS) - 1)
BLOCK_BYTES = 1 << 21


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def _odd(seed: int) -> int:
    return int(mix64(np.array([seed + 1], U64))[0]) | 1


class Rolling:
    """Polynomial hashing with a cached table of powers of one odd base."""

    def __init__(self, seed: int):
        self.base = _odd(seed)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.table = mix64(np.arange(256, dtype=U64) + U64(1000 * (seed + 1)))
        self.powers = np.ones(1, U64)
        self.inverses = np.ones(1, U64)

    def _grow(self, n: int) -> None:
        size = max(1 << 16, len(self.powers))
        while size < n:
            size *= 2
        if size > len(self.powers):
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(size, U64(base), U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """C with C[j] - C[i] = base^i times the hash of values[i:j]."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, U64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of values[start:end] for each pair, length included."""
        raw = (prefix[ends] - prefix[starts]) * self.inverses[starts]
        return mix64(raw + (ends - starts).astype(U64) * U64(0xA24BAED4963EE407))

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        """Hashes of every run of `width` consecutive values."""
        n = len(prefix) - width
        if n <= 0:
            return np.zeros(0, U64)
        return mix64((prefix[width:] - prefix[:-width]) * self.inverses[:n])


#: For bytes of words, for sequences, and a second one that makes keys 128 bits.
BYTES, SEQ, SEQ2 = Rolling(11), Rolling(23), Rolling(37)


def release() -> None:
    """Give memory that a finished batch or group has freed back to the system.

    Python workers outlive their tasks; without this each keeps the most it ever used.
    """
    for rolling in (BYTES, SEQ, SEQ2):
        if len(rolling.powers) > 1 << 20:
            rolling.powers = rolling.inverses = np.ones(1, U64)
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of at most `limit` text bytes, or one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(sizes, dtype=np.int64)
    row = 0
    while row < batch.num_rows:
        before = total[row - 1] if row else 0
        end = max(row + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(row, end - row)
        row = end


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is the empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; every other byte stays."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs without bytes that are `between` words (ASCII white space), and word offsets per row."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    word = ~between[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    full = offsets[1:] > offsets[:-1]
    heads, tails = offsets[:-1][full], offsets[1:][full] - 1
    first[heads] = word[heads]
    last[tails] = word[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words of spans, which are in order and do not overlap, as one binary column."""
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    chars = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    offsets = np.append(0, np.cumsum(ends - starts))
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(chars)])


def hashes_of(words: pa.Array) -> np.ndarray:
    """XXH3 of each of a binary column's values."""
    return np.fromiter((xxh3_64_intdigest(w, 0x5EED) for w in words.to_pylist()), U64, len(words))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 18) -> np.ndarray:
    """One 64-bit XXH3 hash per word, each distinct one of some words hashed once.

    Not of the polynomial kind, under which two words can be made to collide whatever the constants.
    """
    out = np.empty(len(starts), U64)
    for a in range(0, len(starts), step):
        b = min(len(starts), a + step)
        low, high = starts[a], ends[b - 1]
        coded = word_array(data[low:high], starts[a:b] - low, ends[a:b] - low).dictionary_encode()
        out[a:b] = hashes_of(coded.dictionary)[coded.indices.to_numpy()]
    return out


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds): the words with one space behind each; word i is bytes[bounds[i] : bounds[i + 1] - 1]."""
    bounds = np.append(0, np.cumsum(ends - starts + 1))
    text = np.full(int(bounds[-1]), 0x20, np.uint8)
    inside = np.ones(len(text), bool)
    inside[bounds[1:] - 1] = False
    change = np.zeros(len(data) + 1, np.int8)
    change[starts] += 1
    change[ends] -= 1
    text[inside] = data[np.cumsum(change[:-1], dtype=np.int8).view(bool)]
    return text, bounds


def digests(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of a cryptographic 128-bit digest of each text[start:end]: equal ones are equal bytes."""
    view = memoryview(np.ascontiguousarray(text))
    made = b"".join([blake2b(view[a:b], digest_size=16).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    halves = np.frombuffer(made, U64).reshape(-1, 2)
    return halves[:, 0].copy(), halves[:, 1].copy()


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of `width` consecutive keys."""
    out, have = keys, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = np.minimum(out[:-rest], out[rest:])
    return out


class Runs:
    """Windows of `length` values of each row, grouped into runs that share an anchor.

    The anchor of a window is its smallest k-gram (by hash, the leftmost of
    equals), so equal windows have equal anchors at equal places.  A run is a
    maximal row of consecutive window starts with the same anchor.
    """

    def __init__(self, values: np.ndarray, offsets: np.ndarray, length: int, gram: int):
        self.length, self.gram = length, gram
        if len(values) > int(POS_MASK):
            raise ValueError("too many values for one search; cut them")
        self.prefix = SEQ.prefix(values)
        n = len(values) - length + 1
        none = np.zeros(0, np.int64)
        self.first, self.count, self.anchor, self.row = none, none, none, none
        self.key = self.context = np.zeros(0, U64)
        if n <= 0:
            return
        grams = SEQ.windows(self.prefix, gram)
        places = np.arange(len(grams), dtype=U64)
        ranked = (mix64(grams) & ~POS_MASK) | places
        anchors = (sliding_min(ranked, length - gram + 1) & POS_MASK).astype(np.int64)
        crossing = np.zeros(n + 1, np.int32)
        ends = offsets[1:]
        lows = np.clip(np.maximum(ends - length + 1, offsets[:-1]), 0, n)
        np.add.at(crossing, lows, 1)
        np.add.at(crossing, np.clip(ends, 0, n), -1)
        valid = np.flatnonzero(np.cumsum(crossing[:-1]) == 0)
        if len(valid) == 0:
            return
        own = anchors[valid]
        heads = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (valid[1:] != valid[:-1] + 1))))
        self.first = valid[heads]
        self.count = np.diff(np.concatenate((heads, [len(valid)])))
        self.anchor = own[heads]
        self.row = np.searchsorted(offsets, self.first, "right") - 1
        self.key = grams[self.anchor]
        stops = self.first + self.count - 1 + length
        shape = (self.anchor - self.first).astype(U64) << U64(32) | self.count.astype(U64)
        self.context = mix64(SEQ.spans(self.prefix, self.first, stops) ^ mix64(shape))
