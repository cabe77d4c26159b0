"""Elias-Fano sequences and n-gram tries over them.

``EliasFano`` holds a non-decreasing sequence: the low bits of each value
packed, the high bits in unary in one bit vector with a small directory.
``Trie`` holds a set of n-grams of word numbers as one such sequence per
level. The value of a node is ``parent * words + word``, so a level is
monotone as a whole and a word is found by successor search relative to its
context; monotone pointers give the range of a node's children. The last
level carries one quantised probability per n-gram. A trie is saved as flat
arrays and opened memory-mapped; all searches take arrays of queries.
"""

from __future__ import annotations

import json
import os

import numpy as np

U64 = np.uint64
BLOCK_WORDS = 8  # words of the bit vector per directory entry
MANY = 16  # bits of the vector per query, from which on it is searched query by query
STEPS_PER_BIT = 1600  # codes per factor 2 of a probability
TOP_CODE = 65535


def quantise(p: np.ndarray) -> np.ndarray:
    """16-bit codes of probabilities, rounded down; 0 stays for unseen."""
    code = np.floor(TOP_CODE + np.log2(p) * STEPS_PER_BIT)
    return np.clip(code, 1, TOP_CODE).astype(np.uint16)


def probability(code: np.ndarray) -> np.ndarray:
    p = np.exp2((code.astype(np.float64) - TOP_CODE) / STEPS_PER_BIT)
    return np.where(code > 0, p, 0.0)


_ONES, _HIGHS = U64(0x0101010101010101), U64(0x8080808080808080)
_IN_BYTE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def _select_in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th set bit (from 0) of each word, which has it: sums
    of the bytes' bits in one product, then a table for the byte."""
    x = word - ((word >> U64(1)) & U64(0x5555555555555555))
    x = (x & U64(0x3333333333333333)) + ((x >> U64(2)) & U64(0x3333333333333333))
    x = ((x + (x >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
    k = k.astype(U64)
    at = np.bitwise_count(((k * _ONES | _HIGHS) - x) & _HIGHS).astype(U64) * U64(8)
    rank = k - (((x << U64(8)) >> at) & U64(0xFF))
    return (at + _IN_BYTE[(word >> at) & U64(0xFF), rank]).astype(np.int64)


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits up to the highest set one; exact, by halves."""
    high = x >> U64(32)
    top = high > 0
    return np.frexp(np.where(top, high, x).astype(np.float64))[1] + np.where(top, 32, 0)


class EliasFano:
    """Arrays: low (packed low bits), high (bit vector), ones and zeros (set
    and unset bits before each block of the vector)."""

    FIELDS = ("low", "high", "ones", "zeros")

    def __init__(self, n: int, bits: int, arrays: dict[str, np.ndarray]):
        self.n, self.bits = n, bits
        self.low, self.high, self.ones, self.zeros = (arrays[f] for f in self.FIELDS)

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, U64)
        n = len(values)
        bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = np.zeros(n * bits // 64 + 2, U64)
        if bits and n:
            at = np.arange(n, dtype=np.int64) * bits
            part = values & U64((1 << bits) - 1)
            word, off = at >> 6, (at & 63).astype(U64)
            # bits of different values never overlap, so adding is joining
            np.add.at(low, word, part << off)
            over = off + U64(bits) > U64(64)
            np.add.at(low, word[over] + 1, part[over] >> (U64(64) - off[over]))
        top = (values >> U64(bits)).astype(np.int64)
        size = n + (int(top[-1]) if n else 0) + 2
        words = -(-size // (64 * BLOCK_WORDS)) * BLOCK_WORDS
        flags = np.zeros(words * 64, np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view(U64)
        per_block = np.bitwise_count(high).reshape(-1, BLOCK_WORDS).sum(axis=1, dtype=np.int64)
        ones = np.concatenate(([0], np.cumsum(per_block)))
        zeros = np.arange(len(ones)) * (64 * BLOCK_WORDS) - ones
        return cls(n, bits, {"low": low, "high": high, "ones": ones, "zeros": zeros})

    def _many(self, x: np.ndarray) -> bool:
        """Whether so much is asked for that the bit vector is read as a whole."""
        return len(x) * MANY >= len(self.high) * 64

    def _positions(self, ones: bool) -> np.ndarray:
        """Positions of all set or unset bits."""
        flags = np.unpackbits(self.high.view(np.uint8), bitorder="little")
        return np.flatnonzero(flags if ones else flags == 0)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """Position of the k-th set or unset bit."""
        if self._many(k):
            return self._positions(ones)[k]
        directory = self.ones if ones else self.zeros
        block = np.searchsorted(directory, k, side="right") - 1
        k, word = k - directory[block], block * BLOCK_WORDS
        on = np.arange(len(k))
        while len(on):  # words of the block, for those that are further on
            count = np.bitwise_count(self.high[word[on]]).astype(np.int64)
            count = count if ones else 64 - count
            more = k[on] >= count
            on = on[more]
            k[on] -= count[more]
            word[on] += 1
        bits = self.high[word] if ones else ~self.high[word]
        return word * 64 + _select_in_word(bits, k)

    def _ones_before(self, at: np.ndarray) -> np.ndarray:
        """Number of set bits right before the unset bits at ``at``, back to
        the unset bit before."""
        word, off = at >> 6, (at & 63).astype(U64)
        below = ~self.high[word] & ((U64(1) << off) - U64(1))  # unset bits of the word before it
        run = (at & 63) - _bit_length(below)
        far = np.flatnonzero((below == 0) & (word > 0))
        while len(far):  # the run began in a word before
            word[far] -= 1
            below = ~self.high[word[far]]
            run[far] += 64 - _bit_length(below)
            far = far[(below == 0) & (word[far] > 0)]
        return run

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(U64)
        value = self.low[word] >> off
        more = self.low[word + 1] << ((U64(64) - off) & U64(63))
        return (value | np.where(off > 0, more, U64(0))) & U64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values at positions."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, True) - i).astype(U64) << U64(self.bits)) | self._low(i)

    def successor(self, x: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within [first, end), the position of the first value >= x, and
        whether it equals x."""
        top = (x >> U64(self.bits)).astype(np.int64)
        last = int(self.zeros[-1]) - 1
        # values with this high part lie between two consecutive zeros of the unary code
        if self._many(x):
            below = np.concatenate(([0], self._positions(False) - np.arange(last + 1)))  # values below each high part
            b = below[np.minimum(top, last) + 1]
            a = below[np.minimum(top, last + 1)]
        else:
            zero = self._select(np.minimum(top, last), False)
            b = zero - np.minimum(top, last)
            a = np.where(top > last, b, b - self._ones_before(zero))
        a, b = np.clip(a, first, end), np.clip(b, first, end)
        want, stop = x & U64((1 << self.bits) - 1), b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < want[open_]
            a[open_] = np.where(less, mid + 1, a[open_])
            b[open_] = np.where(less, b[open_], mid)
            open_ = open_[a[open_] < b[open_]]
        same = np.zeros(len(x), bool)
        inside = np.flatnonzero(a < stop)
        same[inside] = self._low(a[inside]) == want[inside]
        return a, same


class Trie:
    """Distinct n-grams, sorted, with one code each."""

    def __init__(self, words: int, levels: list[EliasFano], pointers: list[EliasFano], codes: np.ndarray):
        self.words, self.levels, self.pointers, self.codes = words, levels, pointers, codes

    @classmethod
    def build(cls, grams: np.ndarray, codes: np.ndarray, words: int) -> Trie:
        """``grams``: rows of word numbers below ``words``, in order."""
        levels, pointers = [], []
        parent = np.zeros(len(grams), np.int64)
        for depth in range(grams.shape[1]):
            value = parent.astype(U64) * U64(words) + grams[:, depth].astype(U64)
            new = np.concatenate(([True], value[1:] != value[:-1])) if len(value) else np.zeros(0, bool)
            node = np.cumsum(new) - 1
            if levels:  # where the children of each node of the level above begin
                starts = np.searchsorted(parent[new], np.arange(levels[-1].n + 1))
                pointers.append(EliasFano.encode(starts, int(new.sum()) + 1))
            levels.append(EliasFano.encode(value[new], (levels[-1].n if levels else 1) * words))
            parent = node
        return cls(words, levels, pointers, codes)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Codes of n-grams; 0 if not held. Neighbours with a common prefix
        (sorted rows) search for it once, and for its children's range once."""
        out = np.zeros(len(grams), np.uint16)
        if not self.levels or not self.levels[0].n or not len(grams):
            return out
        first = np.ones(len(grams), bool)  # rows whose prefix differs from that of the row before
        first[1:] = False
        node = np.zeros(1, np.int64)  # of each distinct prefix; -1 if not held
        for depth, level in enumerate(self.levels):
            owner = np.cumsum(first) - 1  # each row's prefix so far
            first[1:] |= grams[1:, depth] != grams[:-1, depth]
            at = np.flatnonzero(first)
            held, above = node >= 0, owner[at]
            if depth:
                low, high = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
                low[held] = self.pointers[depth - 1].get(node[held]).astype(np.int64)
                high[held] = self.pointers[depth - 1].get(node[held] + 1).astype(np.int64)
            else:
                low, high = np.zeros(1, np.int64), np.full(1, level.n)
            on = np.flatnonzero(held[above])
            parent = above[on]
            x = node[parent].astype(U64) * U64(self.words) + grams[at[on], depth].astype(U64)
            place, same = level.successor(x, low[parent], high[parent])
            node = np.full(len(at), -1)
            node[on[same]] = place[same]
        found = node[np.cumsum(first) - 1]
        out[found >= 0] = self.codes[found[found >= 0]]
        return out

    def save(self, folder: str) -> None:
        parts = {"levels": self.levels, "pointers": self.pointers}
        index = {"words": self.words} | {k: [[s.n, s.bits] for s in v] for k, v in parts.items()}
        with open(os.path.join(folder, "index.json"), "w") as f:
            json.dump(index, f)
        np.save(os.path.join(folder, "codes.npy"), self.codes)
        for name, sequences in parts.items():
            for k, s in enumerate(sequences):
                for field in EliasFano.FIELDS:
                    np.save(os.path.join(folder, f"{name}-{k}-{field}.npy"), getattr(s, field))

    @classmethod
    def open(cls, folder: str) -> Trie:
        """Memory-mapped."""
        with open(os.path.join(folder, "index.json")) as f:
            index = json.load(f)

        def load(name):
            return np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")
        parts = [[EliasFano(n, bits, {x: np.asarray(load(f"{name}-{k}-{x}")) for x in EliasFano.FIELDS})
                  for k, (n, bits) in enumerate(index[name])] for name in ("levels", "pointers")]
        return cls(index["words"], *parts, load("codes"))
