"""FM-index of a sequence of symbols: backward search, counts and positions.

The sequence is a row of chunks, each followed by a terminator (symbol 0).
Terminators differ: they sort before every symbol and among themselves by
place. Suffixes are sorted by prefix doubling, which stops at a chunk's end,
so chunks of bounded length bound the rounds whatever repeats. The last column
(the symbol before each suffix) is kept as a wavelet tree; places of suffixes
are kept for every ``SAMPLE``-th symbol of a chunk and reached by stepping
back from any other.
"""

from __future__ import annotations

import numpy as np

#: Distance of the symbols of a chunk whose suffix keeps its place.
SAMPLE = 16
_ONE = np.uint64(1)


class Bits:
    """A bit vector that counts the ones before a place."""

    def __init__(self, bits: np.ndarray):
        raw = np.packbits(bits, bitorder="little")
        raw = np.concatenate([raw, np.zeros(8 + -len(raw) % 8, np.uint8)])
        self.words = raw.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words[:-1]), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & _ONE).astype(np.int64)


class WaveletTree:
    """Symbols below 2^depth; level l holds their bits in stable order of the first l bits."""

    def __init__(self, symbols: np.ndarray, below: np.ndarray):
        """``below[c]``: symbols smaller than c, for c up to 2^depth."""
        self.below, self.depth = below, (len(below) - 1).bit_length() - 1
        self.levels, row = [], symbols
        for level in range(self.depth):
            shift = self.depth - 1 - level
            self.levels.append(Bits((row >> shift & 1).astype(bool)))
            row = row[np.argsort(row >> shift, kind="stable")]

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Symbols equal to ``c`` among the first ``i``."""
        for level, bits in enumerate(self.levels):
            shift = self.depth - 1 - level
            start = self.below[c >> (shift + 1) << (shift + 1)]
            ones = bits.rank(start + i) - bits.rank(start)
            i = np.where(c >> shift & 1, ones, i - ones)
        return i

    def read(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place and the number of equal symbols before it."""
        c, start = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for level, bits in enumerate(self.levels):
            shift = self.depth - 1 - level
            bit = bits.get(start + i)
            ones = bits.rank(start + i) - bits.rank(start)
            i = np.where(bit, ones, i - ones)
            c = c << 1 | bit
            start = self.below[c << shift]
        return c, i


def suffix_order(symbols: np.ndarray, to_end: np.ndarray) -> np.ndarray:
    """Places of the suffixes in order; ``to_end``: distance to the chunk's terminator."""
    n = len(symbols)
    width = max(1, int(symbols.max(initial=0)).bit_length())
    h = min(8, 63 // width, max(1, n))
    key = np.zeros(n, np.int64)
    for j in range(h):
        # Behind its terminator a suffix holds nothing.
        ahead = np.zeros(n, np.int64)
        ahead[:n - j] = symbols[j:] if j else symbols
        key = key << width | np.where(to_end >= j, ahead, 0)
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    at, group = np.arange(n), key[order]
    while len(at):
        # ``at``: places in the order that are not settled; ``group``: their keys, ascending.
        place = order[at]
        new = np.ones(len(at), bool)
        new[1:] = group[1:] != group[:-1]
        lead = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        # Equal up to a terminator: their places decide, and a stable sort has kept these in order.
        ended = to_end[place] < h
        rank[place] = np.where(ended, at, lead)
        alone = new & np.append(new[1:], True)
        at = at[~(ended | alone)]
        if len(at):
            place = order[at]
            group = rank[place] * n + rank[place + h]
            by = np.argsort(group, kind="stable")
            order[at], group = place[by], group[by]
        h *= 2
    return order


class FmIndex:
    def __init__(self, symbols: np.ndarray, to_end: np.ndarray, from_start: np.ndarray):
        """``to_end``, ``from_start``: distances of each symbol within its chunk."""
        order = suffix_order(symbols, to_end)
        n, most = len(symbols), int(symbols.max(initial=0))
        size = 1 << max(1, most.bit_length())
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        narrow = np.uint16 if size <= 1 << 16 else np.int64
        self.tree = WaveletTree(symbols[order - 1].astype(narrow), self.below)
        kept = from_start[order] % SAMPLE == 0
        self.kept, self.places, self.n = Bits(kept), order[kept], n

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns that occur, and the range of their suffixes; rows of symbols (1 or more)."""
        which = np.arange(len(patterns))
        last = patterns[which, lengths - 1]
        low, high = self.below[last], self.below[last + 1]
        found = [(which[:0], low[:0], high[:0])]
        for step in range(1, int(lengths.max(initial=0)) + 1):
            some = low < high
            done = some & (lengths[which] == step)
            found.append((which[done], low[done], high[done]))
            on = some & ~done
            which, low, high = which[on], low[on], high[on]
            if not len(which):
                break
            c = patterns[which, lengths[which] - 1 - step]
            low, high = (self.below[c] + self.tree.rank(c, i) for i in (low, high))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes with these numbers."""
        out = np.empty(len(rows), np.int64)
        which, steps = np.arange(len(rows)), 0
        while len(which):
            here = self.kept.get(rows) == 1
            out[which[here]] = self.places[self.kept.rank(rows[here])] + steps
            which, rows = which[~here], rows[~here]
            c, before = self.tree.read(rows)
            rows, steps = self.below[c] + before, steps + 1
        return out
