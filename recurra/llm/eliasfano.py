"""Monotone integer sequences in about 3 + log2(universe/n) bits an entry, and an n-gram trie of them."""

from __future__ import annotations

import mmap
import tempfile

import numpy as np

#: Codes for probabilities: -log2 in steps of 1/2048, rounded towards smaller ones; the last code is zero.
STEP, ZERO = 2048, 65535

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
_COUNT = _BITS.sum(1).astype(np.int64)
#: Place of the k-th set bit of each byte.
_PLACE = np.zeros((256, 8), np.int64)
for _byte in range(256):
    _set = np.flatnonzero(_BITS[_byte])
    _PLACE[_byte, : len(_set)] = _set


def quantise(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        code = np.ceil(-np.log2(np.maximum(p, 0)) * STEP - 1e-9)
    return np.clip(np.where(p > 0, code, ZERO), 0, ZERO).astype(np.uint16)


def restore(code: np.ndarray) -> np.ndarray:
    return np.where(code == ZERO, 0.0, np.exp2(-code.astype(np.float64) / STEP))


def heads_of(key: np.ndarray) -> np.ndarray:
    """Where a sorted column has a new value."""
    return np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)


def context_codes(context: np.ndarray, n: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """(code of each triple, code of what each context leaves for the shorter one); triples of a context stand together.

    A triple that was not counted has probability zero, and a context that was not leaves everything.
    """
    heads = heads_of(context)
    if not len(n):
        return np.zeros(0, np.uint16), np.zeros(0, np.uint16)
    total = np.add.reduceat(n, heads)
    node = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(n))))
    p3 = quantise(np.where(n > 0, n - discount, 0) / np.maximum(total, 1)[node])
    return p3, quantise(1 - np.bincount(node, restore(p3), len(heads)))


class EliasFano:
    """A sorted sequence as packed low bits and unary high bits, read where they lie.

    Beside the bits there is a directory: how many of the high bits before each
    group of 64 are set.  Selecting a bit is a search in the directory and at
    most eight byte look-ups.
    """

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self.ones = before.view(np.uint32)
        self.zeros = np.arange(len(self.ones), dtype=np.uint32) * np.uint32(64) - self.ones

    @staticmethod
    def pack(values: np.ndarray) -> tuple[int, int, bytes, bytes, bytes]:
        n = len(values)
        values = values.astype(np.uint64)
        most = int(values[-1]) if n else 0
        bits = max(0, (most // max(n, 1)).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            low = np.concatenate([np.packbits((values[a : a + 4096, None] >> np.arange(bits, dtype=np.uint64) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for a in range(0, n, 4096)])
        tops = (values >> np.uint64(bits)).astype(np.int64)
        size = n + (int(tops[-1]) if n else 0) + 2
        high = np.zeros(-(-size // 64) * 64, np.uint8)
        high[tops + np.arange(n)] = 1
        packed = np.packbits(high, bitorder="little")
        before = np.append(0, np.cumsum(high.reshape(-1, 64).sum(1)))[:-1].astype(np.uint32)
        return n, bits, low.tobytes() + bytes(8), packed.tobytes(), before.tobytes()

    def low_bits(self, index: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(index), np.int64)
        at = index * self.bits
        byte = at >> 3
        word = np.zeros(len(index), np.uint64)
        for i in range((self.bits + 14) // 8):
            word |= self.low[byte + i].astype(np.uint64) << np.uint64(8 * i)
        return ((word >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def select(self, rank: np.ndarray, bit: bool) -> np.ndarray:
        """Places of the set (or unset) high bits of these ranks, from 0."""
        directory = self.ones if bit else self.zeros
        group = np.searchsorted(directory, rank.astype(np.uint32), "right") - 1
        rest = rank - directory[group].astype(np.int64)
        byte = group * 8
        value = self.high[byte] if bit else ~self.high[byte]
        for _ in range(7):
            count = _COUNT[value]
            on = rest >= count
            if not on.any():
                break
            rest = rest - np.where(on, count, 0)
            byte = byte + on
            value = self.high[np.minimum(byte, len(self.high) - 1)]
            value = value if bit else ~value
        return byte * 8 + _PLACE[value, np.clip(rest, 0, 7)]

    def __getitem__(self, index: np.ndarray) -> np.ndarray:
        return ((self.select(index, True) - index) << self.bits) | self.low_bits(index)

    def successor(self, value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the first entry that is not below `value` within [start, end), or end."""
        if not self.n:
            return np.array(end)
        top = value >> self.bits
        last = len(self.high) * 8 - self.n - 1  # rank of the last unset bit
        upto = lambda t: self.select(np.clip(t, 0, last), False) - np.clip(t, 0, last)  # noqa: E731  entries with at most this top
        lo = np.where(top > 0, upto(top - 1), 0)
        hi = np.where(top <= last, upto(top), self.n)
        lo, hi = np.clip(lo, start, end), np.clip(hi, start, end)
        low = value & ((1 << self.bits) - 1)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_bits(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)


class Trie:
    """Words after the one and the two before them, of one shard, from one packed buffer.

    Below each word b lie the words that follow it, and those before it; below
    each pair a b the words that follow both.  Pointers to a node's first child
    and the children themselves (node * words + word) are Elias-Fano sequences.
    Each child has a discounted probability, and each context the share that is
    left for the shorter one.
    """

    @staticmethod
    def build(words: int, unigram: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, discount: float) -> bytes:
        """a, b, c, n: distinct triples and their counts, sorted by b, a and c; unigram: probabilities of all words."""
        pair = b * words + c
        order = np.argsort(pair, kind="stable")
        heads = heads_of(pair[order])
        pair, n2 = pair[order][heads], (np.add.reduceat(n[order], heads) if len(n) else n)
        root = pair // words
        p2 = quantise((n2 - discount) / np.bincount(root, n2, words)[root])
        left1 = quantise(1 - np.bincount(root, restore(p2), words))
        p3, left2 = context_codes(b * words + a, n, discount)
        return Trie.pack(words, quantise(unigram), left1, pair, p2, a, b, c, left2, p3)

    @staticmethod
    def pack(words: int, p1: np.ndarray, left1: np.ndarray, pair: np.ndarray, p2: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, left2: np.ndarray, p3: np.ndarray) -> bytes:
        """Codes of words, of sorted pairs (b * words + c), of contexts (b, a) and of triples sorted by b, a and c."""
        heads = heads_of(b * words + a)
        context = (b * words + a)[heads]
        node = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(p3))))
        whole = np.arange(words + 1)
        first = (np.searchsorted(pair // max(words, 1), whole), np.searchsorted(context // max(words, 1), whole), np.append(heads, len(p3)))
        parts = [np.array([words], np.int64).tobytes(), *(x.tobytes() for x in (p1, left1, p2, left2, p3))]
        for values in (first[0], pair, first[1], context, first[2], node * words + c):
            size, bits, *packed = EliasFano.pack(values)
            parts += [np.array([size, bits], np.int64).tobytes(), *packed]
        # Every part begins at a multiple of eight, so that it can be read in place.
        return b"".join(len(p).to_bytes(8, "little") + p + bytes(-len(p) % 8) for p in parts)

    def __init__(self, blob: bytes):
        # A file without a name in the task's own folder: its pages are mapped for reading, and gone with the trie.
        with tempfile.TemporaryFile() as f:
            f.write(blob)
            f.flush()
            view = np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)
        parts, at = [], 0
        while at < len(view):
            size = int.from_bytes(view[at : at + 8].tobytes(), "little")
            parts.append(view[at + 8 : at + 8 + size])
            at += 8 + size + -size % 8
        self.words = int(parts[0].view(np.int64)[0])
        self.p1, self.left1, self.p2, self.left2, self.p3 = (p.view(np.uint16) for p in parts[1:6])
        made = []
        for i in range(6, len(parts), 4):
            n, bits = parts[i].view(np.int64).tolist()
            made.append(EliasFano(n, bits, *parts[i + 1 : i + 4]))
        self.first2, self.next2, self.first_before, self.before, self.first3, self.next3 = made

    def child(self, first: EliasFano, children: EliasFano, node: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, index) of a word among a node's children."""
        if not children.n:
            return np.zeros(len(node), bool), np.zeros(len(node), np.int64)
        start, end = first[node], first[node + 1]
        wanted = node * self.words + word
        at = children.successor(wanted, start, end)
        found = at < end
        found[found] = children[at[found]] == wanted[found]
        return found, at

    def probability(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Of word c after a and b."""
        met, at = self.child(self.first2, self.next2, b, c)
        p = np.where(met, restore(self.p2[np.where(met, at, 0)]) if len(self.p2) else 0, 0) + restore(self.left1[b]) * restore(self.p1[c])
        known, node = self.child(self.first_before, self.before, b, a)
        rows = np.flatnonzero(known)
        met, at = self.child(self.first3, self.next3, node[rows], c[rows])
        seen = np.where(met, restore(self.p3[np.where(met, at, 0)]), 0) if len(self.p3) else 0
        p[rows] = seen + restore(self.left2[node[rows]]) * p[rows]
        return p

    def rest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """What is left for the probability of a word by itself after a and b."""
        share = restore(self.left1[b])
        known, node = self.child(self.first_before, self.before, b, a)
        share[known] *= restore(self.left2[node[known]])
        return share
